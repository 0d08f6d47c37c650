"""The problems for training data against plain Python, their SQL twins, and their edge cases."""

import brute_llm as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from plover.llm import fusion, leaks, mixing, queries, ranking, spans

SF = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(40)]


@pytest.mark.parametrize("name", ["p1", "p5", "p8", "p9"])
def test_against_brute_force(spark, name):
    got = [tuple(r) for r in queries.QUERIES[f"{name}_found"](spark, SF).collect()]
    assert len(got) == len(set(got))
    assert set(got) == getattr(brute, name)(SF)


def test_shared_spans_against_brute_force(spark):
    got = {tuple(r) for r in queries.p10_found(spark, SF).collect()}
    by = {}
    for r in brute.rows(SF, "documents"):
        by.setdefault(r["text"], []).append(r["doc_id"])
    rep = {i: min(v) for v in by.values() for i in v}
    want = {tuple(sorted((rep[a], rep[b]))) if rep[a] != rep[b] else (rep[a], max(a, b)) for a, b in brute.p10(SF)}
    assert got == {p for p in want if p[0] != p[1]}


# ---- p1
def test_copied_votes_are_discounted():
    sets, pair = [["a", "b"], ["c"]], {("a", "b"): 1.0}
    free = fusion.Votes([]).posterior("f", sets)
    copied = fusion.Votes([], depends=pair).posterior("f", sets)
    assert free[0] > copied[0] > copied[1]


def test_accuracy_and_copying_decide_a_ladder():
    """One source's longer text against eight that agree on a shorter one: what is known of the sources decides."""
    many = list("abcdefgh")
    sets = [["z"], many]
    poor = {("t", s): 0.3 for s in many} | {("t", "z"): 0.9}
    good = {("t", s): 0.95 for s in many} | {("t", "z"): 0.3}
    copied = {(a, b): 1.0 for a in many for b in many if a < b}
    place = lambda *known: fusion.Votes(["t"], *known).chosen("t", sets)[0]
    assert place(poor) == [0] and place(good) == [1] and place(good, copied) == [0]
    worst = {("t", s): 0.95 for s in many} | {("t", "z"): 0.05}
    assert fusion.Votes(["t"], worst).chosen("t", [["z"], many[:4]])[0] == [0]  # few sources can't overrule


_CLAIM = "seq long, object string, source string, metrics long, text long, f string"


def test_votes_choose_the_row(spark):
    rows = [(0, "o", "z", 9, 9, "x")] + [(i + 1, "o", s, 5, 5, "y") for i, s in enumerate("abcdefgh")]
    df = spark.createDataFrame(rows, _CLAIM)
    known = lambda a, z: fusion.Votes(["metrics", "text"], {(f, s): v for f in ("metrics", "text", "f") for s, v in [(_who("z"), z)] + [(_who(s), a) for s in "abcdefgh"]})
    row = lambda votes: fusion.fuse(df, ["metrics", "text"], ["f"], votes=votes).first()
    assert (row(known(0.3, 0.9)).metrics_seq, row(known(0.95, 0.3)).text_seq, row(known(0.95, 0.3)).f_seq) == (0, 1, 1)
    assert fusion.fuse(df, ["metrics", "text"], ["f"]).first().n == 9


def _who(source):
    import base64

    return base64.b64encode(source.encode()).decode()


def test_fusion_finds_the_copier(spark):
    rows, seq = [], 0
    rng = np.random.default_rng(1)
    for o in range(300):
        truth = {s: "t" if rng.random() < 0.8 else f"x{rng.integers(10)}" for s in "0123456"[:3]}
        truth["3"] = truth["2"]  # source 3 copies source 2
        for s, v in truth.items():
            rows.append((seq, str(o), s, 10, 3, v))
            seq += 1
    rows += [(seq, None, "1", 10, 3, "x"), (seq + 1, "one", "1", 10, 3, "x"), (seq + 2, "null", None, None, 0, None), (seq + 3, "null", None, None, 0, None)]
    rows += [(seq + 4, "long", "1", 7, 10**6, "y" * 10**5), (seq + 5, "long", "1", 7, 10**6, "y" * 10**5)]
    df = spark.createDataFrame(rows, _CLAIM).withColumns({"n": F.lit("clash"), "who": F.lit(1), "pattern": F.lit(2)})
    claimed = fusion.claims(df, ["metrics", "text"], ["f"])
    votes = fusion.estimate(fusion.counted_patterns(claimed, ["metrics", "text", "f"]), ["metrics", "text"])
    pair = lambda a, b: votes.depends[min(_who(a), _who(b)), max(_who(a), _who(b))]
    assert pair("2", "3") > 0.9 > 0.5 > pair("0", "1") and min(votes.accuracy.values()) > 0.5
    out = {r.object: r for r in fusion.fuse(df, ["metrics", "text"], ["f"]).collect()}
    assert len(out) == 302 and np.mean([rows[r.f_seq][5] == "t" for o, r in out.items() if o not in ("null", "long")]) > 0.85
    assert out["null"].metrics_seq is None and out["null"].f_seq is None and out["null"].f_p is None and out["null"].text_seq == seq + 2
    assert out["0"].metrics_seq == 0 and out["0"].n == 4  # rows of one claim: the lowest seq
    assert out["long"].text_seq == out["long"].metrics_seq == seq + 4
    assert fusion.fuse(df.limit(0), ["metrics", "text"], ["f"]).count() == 0


# ---- p5
def test_ranks_with_nulls_ties_and_repeats(spark):
    rows = [("g", str(i), i, float(i) if i % 5 else None, float("nan") if i == 3 else i * 1000.0) for i in range(10)]
    rows += [("g", "9", 50, 0.0, 0.0), (None, "1", 60, 1.0, 1.0), ("h", None, 61, 1.0, None)]
    df = spark.createDataFrame(rows, "q string, c string, s long, a double, b double").withColumn("size", F.lit(1)).withColumn("rank", F.lit(1))
    fused, w = ranking.fuse_ranks(df, "q", "c", "s", {"a": 1, "b": 1})
    out = {(r.grp, r["item"]): r for r in fused.collect()}
    assert len(out) == 12 and (w > 0).all()
    assert out["g", "9"].r_a == 0.95 and out["g", "0"].r_a == out["g", "5"].r_a == 0.1 and out["g", "3"].r_b == 0.05
    top = {r["item"] for r in ranking.top_of_groups(fused, 2).filter("grp = 'g'").collect()}
    assert top == {"9", "8"}
    down, _ = ranking.fuse_ranks(df, "q", "c", "s", {"a": -1, "b": -1})
    assert {r["item"]: r.r_a for r in down.filter("grp = 'g'").collect()}["1"] == 0.95
    assert ranking.fuse_ranks(df.limit(0), "q", "c", "s", {"a": 1, "b": 1})[0].count() == 0


# ---- p8
def test_leaks(spark):
    item = " ".join(WORDS[:14])
    docs = [
        (1, "Intro, " + ", ".join(w.upper() for w in WORDS[:12]) + "! end"),
        (2, " ".join(WORDS[:11]) + " gap " + WORDS[11]),
        (3, None),
        (4, ""),
        (5, ("x " * 100000) + item),
        (6, item.replace("w", "ｗ").replace(" ", "​ ")),
    ]
    items = spark.createDataFrame([(7, item), (8, item), (9, "too short"), (10, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    want = {(d, i) for d in (1, 5, 6) for i in (7, 8)}
    for cap in (1000, 2):  # in one pass and in several
        got = leaks.leaked_items(df, items, max_patterns=cap)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert leaks.leaked_items(df.limit(0), items).count() == 0 and leaks.leaked_items(df, items.limit(0)).count() == 0


def test_passes_are_bounded_and_whole():
    items = [(i, " ".join(WORDS[i : i + 14])) for i in range(20)] + [(99, None), (98, "short")]
    every = {p for t in leaks.passes(items, 12, 10**6) for p in [x for b in t.bucket.values() for x in b]}
    for patterns, size in ((4, 10**9), (10**6, 120), (1, 1)):
        tables = list(leaks.passes(items, 12, patterns, size))
        assert len(tables) > 1 and {p for t in tables for b in t.bucket.values() for p in b} == every
        assert all(sum(map(len, t.bucket.values())) <= max(patterns, 3) for t in tables)
    assert len(list(leaks.passes([], 12, 5))) == 1


def test_wu_manber_equals_scan():
    rng = np.random.default_rng(3)
    text = [f"v{i}" for i in rng.integers(0, 3, 5000)]
    patterns = {tuple(text[i : i + 5]): frozenset({i}) for i in range(0, 200, 7)}
    got = [s for s, _ in leaks.WuManber(patterns, 5).search(text)]
    assert got == [i for i in range(len(text) - 4) if tuple(text[i : i + 5]) in patterns]


# ---- p9
def test_permutation_is_one():
    for n in (1, 2, 7, 100, 1000):
        out = mixing._feistel(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(out) == list(range(n))


def test_pieces_don_t_change_counts():
    enc = mixing.encoding(mixing.vocabulary(mixing.TOKENIZER))
    text = "Ein langer  Text, mit Worten and 123 numbers.\n\n日本語の文 " * 40
    assert sum(len(enc.encode_ordinary(s)) for s in mixing.stretches(text, 50)) == len(enc.encode_ordinary(text))
    assert "".join(mixing.stretches(text, 50)) == text


def test_mix(spark):
    rows = [(i, "big", "word " * 50) for i in range(200)] + [(1000 + i, "small", "term " * 50) for i in range(5)] + [(2000, None, "x"), (2001, "big", None), (2002, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n", F.lit(0))
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    slots, report = mixing.mix(docs, targets, block_tokens=16, shard_slots=32)
    r = {x.source: x for x in report.collect()}
    assert (r["big"].short, r["small"].short, r["none"].short) == (False, True, True)
    assert abs(r["big"].reached - 1) < 0.1 and r["small"].mixed_tokens <= 3 * r["small"].source_tokens
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9 and r["none"].filled_slots == 0 < r["none"].drawn_slots
    assert all(x.short == (x.filled_slots < x.drawn_slots) for x in r.values())
    used = slots.groupBy("source", "block").count().groupBy("source").agg(F.max("count")).collect()
    assert {x[0]: x[1] for x in used} == {"big": 1, "small": 3}
    packed = mixing.pack(mixing.count_tokens(docs), 7, 16).groupBy("doc_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("n"))
    assert packed.join(mixing.count_tokens(docs), "doc_id").filter("n != n_tokens").count() == 0
    assert mixing.mix(docs.limit(0), targets)[1].filter("short").count() == 0


def test_short_sources_come_from_the_walk(spark, monkeypatch):
    """A walk that fills every share leaves nothing short, whatever the capacities say."""
    docs = spark.createDataFrame([(i, "big", "word " * 50) for i in range(40)] + [(99, "small", "term " * 50)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 1)], "source string, target_share double, max_repeats int")
    short = lambda: {r.source for r in mixing.mix(docs, targets, block_tokens=8)[1].filter("short").collect()}
    assert short() == {"small"}
    whole = mixing.pack
    monkeypatch.setattr(mixing, "pack", lambda *a: whole(*a).withColumn("to_token", F.col("to_token") * 100))
    assert short() == set()


def test_mix_names_its_records(spark):
    out = queries.p9_mix(spark, SF)
    assert {"doc_id", "from_token", "to_token"} <= set(out.columns)
    rows, docs = out.collect(), brute.rows(SF, "documents")
    source = {r["doc_id"]: r["source"] for r in docs}
    most = {r["source"]: r["max_repeats"] for r in brute.rows(SF, "mix_targets")}
    sizes = {r.doc_id: r.n_tokens for r in mixing.count_tokens(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    slots, taken = {}, {}
    for r in rows:
        assert source[r.doc_id] == r.source and 0 <= r.from_token < r.to_token <= sizes[r.doc_id]
        slots.setdefault((r.source, r.slot, r.shard), []).append((r.at, r.to_token - r.from_token))
        taken.setdefault((r.source, r.doc_id), []).append((r.repeat, r.from_token, r.to_token))
    for parts in slots.values():  # without gap from the slot's first token on
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= mixing.BLOCK_TOKENS
    for (s, _), of in taken.items():  # no token more than once in a repeat, no more repeats than allowed
        of.sort()
        assert all(a[0] < b[0] or a[2] <= b[1] for a, b in zip(of, of[1:], strict=False)) and max(r for r, _, _ in of) < most[s]
    mixed = {r.source: r.mixed_tokens for r in queries.p9_report(spark, SF).collect()}
    for s, n in mixed.items():
        assert n == sum(b - a for (of, _), parts in taken.items() if of == s for _, a, b in parts)


# ---- p10
def test_spans(spark):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefghij klmnop日本"), n))
    shared, near, base = noise(200), noise(199), noise(500)
    docs = [
        (1, noise(90) + shared + noise(30)),
        (2, shared),
        (3, noise(400) + shared),
        (4, noise(100) + near + "1"),
        (5, near + "2" + noise(100)),
        (6, base),
        (7, base),
        (8, base),
        (9, base + "tail"),
        (10, None),
        (11, ""),
        (12, "z" * 3000),
        (13, "y" + "z" * 250),
        (14, "short"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("span", F.lit(1))
    got = [tuple(r) for r in spans.linked_pairs(df).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (2, 3), (6, 7), (6, 8), (6, 9), (12, 13)]
    assert spans.linked_pairs(df.limit(0)).count() == 0
    shares = {r.doc_id: r for r in spans.shared_shares(df).collect()}
    assert shares[6].later_chars == 0 and shares[7].later_chars == shares[7].shared_chars > 400 and 14 not in shares


def brute_shares(texts):
    """doc_id -> (n_chars, shared, later), from every window of 200 characters."""
    windows = {}
    for i, t in texts.items():
        for a in range(len(t or "") - 199):
            windows.setdefault(t[a : a + 200], set()).add(i)
    out = {}
    for i, t in texts.items():
        shared, later = set(), set()
        for a in range(len(t or "") - 199):
            ids = windows[t[a : a + 200]]
            if len(ids) > 1:
                shared.update(range(a, a + 200))
            if min(ids) < i:
                later.update(range(a, a + 200))
        if shared:
            out[i] = (len(t), len(shared), len(later))
    return out


def test_shares_against_brute_force(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(rng.choice(list("abcdefghij klmnop日本😀"), n))
    one, two, three, base = noise(200), noise(333), noise(199), noise(500)
    texts = [noise(90) + one + noise(30), one, noise(7) + two + noise(51) + one, two[40:] + noise(20), three + noise(80), noise(60) + three, noise(20) + base, base, base, base[:260] + noise(9)]
    texts += ["z" * 900, "y" + "z" * 250, one + "-" + one, None, "", "short", noise(900), two[:210] + two[100:]]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([*docs.items(), (7, base)], "doc_id long, text string").withColumn("pos", F.lit(1))  # one row repeated
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.later_chars) for r in spans.shared_shares(df).collect()}
    assert got == brute_shares(docs)
    assert got[8] == (500, 500, 500) and 4 not in got
    assert spans.shared_shares(df.limit(0)).count() == 0


def test_classes_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in brute.rows(SF, "documents")}
    root, owner = {i: i for i in texts}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in texts.items():
        for a in range(len(t or "") - 199):
            j = owner.setdefault(t[a : a + 200], i)
            a, b = sorted((find(i), find(j)))
            root[b] = a
    members = {}
    for i in texts:
        members.setdefault(find(i), set()).add(i)
    want = {(i, c, len(of)) for c, of in members.items() if len(of) > 1 for i in of}
    assert {tuple(r) for r in spans.shared_classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()} == want


def test_shares_of_the_tables(spark):
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.later_chars) for r in queries.p10_shares(spark, SF).collect()}
    assert got == brute_shares({r["doc_id"]: r["text"] for r in brute.rows(SF, "documents")})


def test_cuts_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    codes = rng.integers(97, 123, 5000).astype(np.uint32)
    whole = set(zip(*spans.cuts_and_spans(codes), strict=True))
    monkeypatch.setattr(spans, "PIECE", 700)
    parts = {(p + a, h) for a in range(0, 5000, 700) for p, h in zip(*spans.cuts_and_spans(codes[a : a + 700 + 2 * spans.LEAST]), strict=True)}
    assert whole <= parts


def test_equals_sql(spark):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        cur = con.execute(sql)
        at = [c[0] for c in cur.description]
        want = sorted(repr(tuple(r[at.index(c)] for c in df.columns)) for r in cur.fetchall())
        assert sorted(repr(tuple(r)) for r in df.collect()) == want, name
