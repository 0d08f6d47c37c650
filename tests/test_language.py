"""Tokenizer, parser, planner and ranking rules."""

import itertools

import pytest

from plover.functions import text as X
from plover.operators import index as I
from plover.plans import ir, plan
from plover.plans.parse import check_input, date_value, parse

NOW = 1788782400000  # 2026-09-07T12:00:00Z
DAY = 86400000


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("The Price of it ALL", ["price", "all"]),
        ("see https://x.example/a?b #Spark_Sql now", ["see", "#spark_sql", "spark_sql", "now"]),
        ("@ann pays $acme $50", ["@ann", "ann", "pays", "$acme", "acme", "50"]),
        ("ＡＢＣ ② ﬁx", ["abc", "2", "fix"]),
        ("東京都 run", ["東京", "京都", "run"]),
        ("日", ["日"]),
        ("hi 🎉🎉🚀", ["hi", "🎉", "🚀"]),
        ("can’t 'quoted'", ["can't", "quoted"]),
        ("well-known ##tag", ["well", "known", "#tag", "tag"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert X.tokenize(text) == tokens
    df = spark.createDataFrame([(text,)], "text string")
    assert X.tokenized(df).first().tokens == tokens
    from pyspark.sql import functions as F

    native = X.without_stopwords(X.expand(X.pieces(X.folded(F.col("text")))))
    assert df.select(native.alias("t")).first().t == tokens


def test_null_and_long_texts(spark):
    df = spark.createDataFrame([(None,), ("word " * 200000,)], "text string")
    assert [len(r.tokens) for r in X.tokenized(df).collect()] == [0, 200000]


def test_native_terms_equal_the_fused_pass(spark):
    from pyspark.sql import functions as F

    texts = ["hot take this cheap phone keeps crashing", "$5 coffee", "cheap", "how to install a tutorial", "build quality is great rock solid"]
    df = X.tokenized(spark.createDataFrame([(t,) for t in texts], "text string"))
    native = F.array_distinct(F.concat("tokens", X.adjacent_bigrams(F.col("tokens")), X.aspect_tags(F.col("tokens"), F.col("text"))))
    for r in df.withColumn("native", native).collect():
        assert r.present == r.native, r.text


def test_operators_in_any_order():
    parts = ["rust", "from:@ann", "since:7d", "has:image", "min_likes:3", "lang:en"]
    keys = {ir.query_key(parse(" ".join(p), NOW, lambda h: "7")) for p in itertools.permutations(parts)}
    assert len(keys) == 1
    q = parse(" ".join(parts), NOW, lambda h: "7")
    assert q.must == ["rust"] and q.filters == {"authorId": "7", "since": NOW - 7 * DAY, "until": None, "media": "image", "minLikes": 3, "lang": "en"}


def test_unknown_operator_stays_text():
    assert parse("foo:bar has:sound", NOW).must == ["foo", "bar", "sound"]


def test_phrases_negation_and_or():
    q = parse('"to be or not" -dog cat not about the bird', NOW)
    assert q.phrases == [["to", "be", "or", "not"]] and q.exclude == ["dog", "bird"] and q.must == ["cat"] and not q.union
    q = parse("apple OR what is tree", NOW)
    assert q.union and q.must == [] and q.should == ["apple", "tree"]
    assert ir.canonical_json(q).endswith(',"union":true}')


def test_dates():
    assert date_value("2026-02-30", NOW) is None and date_value("2024-02-29", NOW) == 1709164800000
    assert date_value("2w", NOW) == NOW - 14 * DAY
    q = parse("release in march", NOW)
    assert q.must == ["release"] and q.filters["since"] == 1772323200000 and q.filters["until"] == 1775001600000
    assert parse("long march", NOW).filters["since"] is None
    assert parse("snow this winter", NOW).filters["since"] == 1764547200000
    assert parse("x last summer", NOW).filters["since"] == 1748736000000


def test_intents_and_aspects():
    assert parse("who is ann?", NOW).intent == "question"
    assert parse("a vs b2", NOW).intent == "compare"
    q = parse("cheap laptop", NOW)
    assert (q.must, q.should, q.aspects) == (["laptop"], ["cheap"], ["~price"])
    assert parse("cheap", NOW).must == ["cheap"] and parse("cheap", NOW).aspects == []
    # phrases with a stopword never match the stopword-free stream
    assert parse("too expensive laptop", NOW).aspects == ["~price"] and X.aspects_of(X.tokenize("how to paint"), "") == []


def test_input_gate():
    assert check_input("x" * 513) and check_input(" ".join(["the"] * 13)) and check_input("a b c") is None


def test_refinement_fills_only_empty_slots():
    base, more = parse("rust since:7d", NOW), ir.Query(must=["go"], should=["fast"], filters={**ir.Query().filters, "since": 1, "lang": "en"})
    merged = ir.merge_refinement(base, more)
    assert merged.must == ["rust"] and merged.should == ["fast"] and merged.filters["since"] == NOW - 7 * DAY and merged.filters["lang"] == "en"


def test_plan_and_ladder():
    df = {"linux": 500, "box": 2000, "rare": 3}
    q = ir.Query(must=["linux", "box", "rare"])
    p = plan.first_plan(q, df)
    assert p.gates == ("rare", "linux", "box") and p.read == "impact"
    p1 = plan.wider(p, 0, q, df)
    p2 = plan.wider(p1, 0, q, df)
    p3 = plan.wider(p2, 0, q, df)
    assert [x.level for x in (p1, p2, p3)] == ["L1", "L1", "L2"] and p1.gates == ("rare", "linux") and p2.gates == ("rare",)
    assert plan.wider(p3, 0, q, df, ["new"]).unions[-1] in ("box", "new") and plan.wider(p3, 0, q, df, []) is None
    assert plan.wider(p, 10, q, df) is None
    assert plan.wider(plan.first_plan(ir.Query(must=["linux"]), df), 0, ir.Query(must=["linux"]), df) is None
    timed = ir.Query(must=["box"], filters={**ir.Query().filters, "since": 5, "media": "image"})
    assert plan.first_plan(timed, df).read == "time" and plan.wider(plan.first_plan(timed, df), 0, timed, df) is None


def test_repair():
    near = plan.repair_neighbours("serach")
    assert "search" in near and "erach" in near and len(near) == len(set(near))
    assert plan.repair_neighbours("abc") == [] and plan.repair_neighbours("~price") == []


def test_posting_cap(spark):
    df = spark.createDataFrame([("p", ["a", "b", "c"])], "post_id string, present array<string>")
    I.check_posting_cap(df, 3)
    with pytest.raises(ValueError, match="more than 2 postings"):
        I.check_posting_cap(df, 2)


def test_notes_tell_what_became_of_the_words():
    q = parse("cheap laptop vs tablet not mac last week from:ann", NOW, {"ann": "7"}.get)
    assert q.consumed["cheap"] == "soft" and q.consumed["vs"] == "glue" and q.consumed["not mac"] == "negation" and q.consumed["last week"] == "time"
    assert q.consumed["from:ann"] == "author" and parse("sort:latest x", NOW).consumed == {"sort:latest": "sort"}
    assert parse("sort:oddly x", NOW).consumed == {}
