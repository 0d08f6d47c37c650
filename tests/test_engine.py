"""The search driver, paging, streaming and files."""

import json

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from plover.operators import collect as C
from plover.operators import events, graph, ingest
from plover.operators import normalize as N
from plover.operators import rank as R
from plover import runtime
from plover.plans.engine import SearchEngine
from plover.queries import searching, store
from plover.sources import config, ingress, pages
from plover.streaming import live

NOW = 1788782400000


def post(i, text, **k):
    base = dict(post_id=str(i), ingress_seq=i, author_id="1", text=text, created_ms=NOW - i * 3600000, likes=i, replies=0, retweets=0, quotes=0, metrics_at=NOW, media_type="none", lang="en", quoted_id=None, retweet_of_id=None, reply_to_id=None)
    return {**base, **k}


SHAPE = "post_id string, ingress_seq long, author_id string, text string, created_ms long, likes long, replies long, retweets long, quotes long, metrics_at long, media_type string, lang string, quoted_id string, retweet_of_id string, reply_to_id string"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [post(i, f"apple pie number {i}") for i in range(1, 13)] + [post(20, "apple grows on tree"), post(21, "tree apple", lang="fr"), post(22, "pear tree", author_id="2"), post(23, "apple pie again", retweet_of_id="5")]
    posts = spark.createDataFrame([tuple(r[c.split()[0]] for c in SHAPE.split(", ")) for r in rows], SHAPE)
    authors = spark.createDataFrame([("1", "ann", 1.0), ("2", "bob", 2.0)], "author_id string, handle string, authority double")
    return SearchEngine(posts, authors=authors)


def ids(r):
    return [x["post_id"] for x in r.results]


def test_all_words_and_exclusion(engine):
    r = engine.search("apple tree -grows", now_ms=NOW)
    assert r.ladder[0] == "L0" and "20" not in ids(r) and ids(r)[0] == "21"


def test_phrase_is_adjacent(engine):
    assert set(ids(engine.search('"tree apple"', now_ms=NOW))) >= {"21"} and "20" not in ids(engine.search('"tree apple"', now_ms=NOW))


def test_filters_never_relax(engine):
    r = engine.search("apple tree from:bob", now_ms=NOW)
    assert set(ids(r)) <= {"22"} and len(r.ladder) > 1
    assert engine.search("apple from:nobody", now_ms=NOW).error == "unknown author"


def test_chain_has_one_row(engine):
    r = engine.search("apple pie", now_ms=NOW, limit=50)
    assert len({x["chain"] for x in r.results}) == len(r.results) and not {"23", "5"} <= set(ids(r))


def test_paging_keeps_shown_rows(engine):
    first = engine.search("apple pie", now_ms=NOW, limit=4)
    more = engine.search("apple pie", now_ms=NOW, limit=8, prefix=first.next_prefix[::-1], prefix_key=first.query_key)
    assert ids(more)[:4] == ids(first)[::-1] and len(set(ids(more))) == 8
    assert engine.search("apple pie", now_ms=NOW, prefix=["5"], prefix_key="0" * 16).prefix_dropped


def test_latest_union_suggestion_and_typeahead(engine):
    assert ids(engine.search("apple pie sort:latest", now_ms=NOW, limit=2)) == ["1", "2"]
    assert set(ids(engine.search("pear OR grows", now_ms=NOW))) == {"20", "22"}
    assert engine.search("appel", now_ms=NOW).did_you_mean == "apple"
    assert [s["term"] for s in engine.suggest("a")][:1] == ["apple"] and {"ann"} <= {s["term"] for s in engine.suggest("a")}
    assert engine.search("x" * 600, now_ms=NOW).error


def test_batch_equals_single_searches(engine):
    raws = ["apple tree -grows", '"tree apple"', "pear OR grows", "from:bob", "apple from:nobody", "apple pie sort:latest", "tree lang:fr", "quince", "x" * 600]
    results, pages = engine.search_many(raws, NOW)
    rows = {}
    for r in pages.collect():
        rows.setdefault(r.qid, []).append((r.rnk, r.post_id, r.matched_via))
    for i, raw in enumerate(raws):
        one = engine.search(raw, now_ms=NOW, limit=200)
        assert (results[i].error, results[i].ladder, results[i].did_you_mean) == (one.error, one.ladder, one.did_you_mean)
        assert [x for _, x, _ in sorted(rows.get(i, []))] == ids(one)
    assert ids(engine.search("from:bob", now_ms=NOW)) == ["22"]


def test_ladder_against_plain_python(engine):
    """Levels of a starving query, worked out by hand: all words, without the commonest, any, with the words of the best."""
    r = engine.search("tree grows number", now_ms=NOW, limit=200)
    via = {x["post_id"]: x["matched_via"] for x in r.results}
    assert r.ladder[:4] == ["L0", "L1", "L1", "L2"]
    assert via["20"] == "L1" and {via[i] for i in ("21", "22")} <= {"L1", "L2"} and set(via.values()) <= {"L1", "L2", "L3"}
    assert len(via) >= 10


def test_clock_and_pins(engine):
    assert (engine.snapshot(100, None), engine.snapshot(100, 50), engine.snapshot(100, 10**9), engine.snapshot(100, -1)) == (100, 50, 100, 100)
    assert engine.search("apple", now_ms=NOW, as_of=NOW - 5).as_of == NOW - 5
    key = engine.search("apple pie", now_ms=NOW).query_key
    more = engine.search("apple pie", now_ms=NOW, prefix=[("20", "L0"), ("21", "L1"), ("5", "L0")], prefix_key=key)
    assert ids(more)[:2] != ["20"] and "20" not in ids(more)[:1] and "5" in ids(more)  # 20 misses a gate of L0


def test_writing(spark):
    shape = SHAPE
    rows = [post(i, f"apple pie number {i}", metrics_at=NOW - 10) for i in range(1, 4)]
    frame = lambda rs: spark.createDataFrame([tuple(r[c.split()[0]] for c in shape.split(", ")) for r in rs], shape)
    e = SearchEngine(frame(rows))
    batch = frame([post(1, "apple pie number 1", likes=500, metrics_at=NOW), post(9, "plum pie", ingress_seq=9), post(9, "plum pie", ingress_seq=10, likes=7, metrics_at=NOW + 5), post(2, "late", metrics_at=0)])
    assert e.ingest(batch) == {"inserted": 1, "updated": 1, "skipped": 1}
    assert e.ingest(batch) == {"inserted": 0, "updated": 0, "skipped": 3}
    held = {r.post_id: r for r in e.posts.collect()}
    assert held["1"].likes == 500 and held["9"].likes == 7 and held["2"].text == "apple pie number 2" and e.total == 4
    assert ids(e.search("plum", now_ms=NOW)) == ["9"]
    df = {r.term: r.df for r in e.terms.collect()}
    assert df["pie"] == 4 and df["plum"] == 1
    buckets = {r.post_id: r.bucket for r in e.postings.filter("term = 'pie'").collect()}
    assert buckets["1"] > buckets["3"]
    quoting = frame([post(30, "look", quoted_id="3", likes=1000, ingress_seq=30)])
    e.ingest(quoting)
    assert e.refresh() >= 1 and {r.post_id: r.bucket for r in e.postings.filter("term = 'pie'").collect()}["3"] > buckets["3"]
    votes = spark.createDataFrame([(e.search("plum", now_ms=NOW).query_key, "9", 1, 7, 0, 1), ("k", "9", 1, 7, 0, 2), ("k", "9", 1, None, 0, 3)], "query_key string, post_id string, vote int, voter long, at_s long, seq long")
    assert e.vote(votes) == {"accepted": 2, "rejected": 0}
    assert e.search("plum", now_ms=NOW).results[0]["p_fb"] > 0
    with pytest.raises(ValueError):
        e.ingest(frame([post(40, " ".join(f"w{i}" for i in range(3000)))]))
    assert e.second_lane("pie", author="1", since=NOW - 3 * 3600000).count() == 3
    assert [r.total for r in e.second_lane(author="1", until=0).collect()] == []
    for bad in ({}, {"since": 5, "until": 4}):
        with pytest.raises(ValueError):
            e.second_lane(**bad)


def test_engine_against_plain_python(spark):
    """Every query of the batch, level by level: reads, caps, gates, filters, order and ranking worked out without Spark."""
    import brute_search

    held = [r.asDict() for r in store.analysed(spark, SMALL).collect()]
    people = {r.author_id: r.follower_count or 0 for r in store.latest_authors(spark, SMALL).collect()}
    want = {raw: brute_search.search(held, people, raw, NOW) for raw in searching.QUERIES_RAW}
    got = {}
    for r in entry.queries()["engine_search"](spark, SMALL).collect():
        got.setdefault(r.raw, []).append((r.rnk, r.post_id, r.level, r.score))
    assert {raw: [(i, lv) for _, i, lv, _ in sorted(rows)] for raw, rows in got.items()} == {raw: [(i, lv) for i, lv, _ in rows] for raw, rows in want.items() if rows}
    for raw, rows in got.items():
        assert all(abs(a[3] - b[2]) < 1e-5 for a, b in zip(sorted(rows), want[raw], strict=True))


def test_materialised_tables_go(spark, tmp_path):
    import os

    one = runtime.materialize(spark.range(3), "gone")
    path = one._materialized_at.removeprefix("file://")
    assert os.path.exists(path)
    runtime.discard(one)
    runtime.discard(one.filter("id = 1"))  # derived tables own nothing
    assert not os.path.exists(path)


def test_rank_ignores_row_order(spark):
    rows = [("q", str(i), i, 1, 0, 0, 0.5, float(i % 3), NOW - i, i - 5, 0.0, 1.0) for i in range(20)]
    shape = "query_key string, id string, like_count long, reply_count long, retweet_count long, quote_count long, propagated_boost double, author_authority double, created_at long, feedback_votes int, fit double, rel double"
    one = R.six_signals(spark.createDataFrame(rows, shape), NOW, "top", ["query_key"]).select("id", "score")
    two = R.six_signals(spark.createDataFrame(rows[::-1], shape), NOW, "top", ["query_key"]).select("id", "score")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_rate_limit_and_ledger(spark):
    votes = [(1, i, 1, i, i) for i in range(5)] + [(1, 0, 1, 5, 5), (1, 9, 1, 61, 6), (2, 1, 1, 0, 7)]
    out = {r.seq: r.accepted for r in ingest.rate_limited_votes(spark.createDataFrame(votes, "voter long, post_id long, vote int, at_s long, seq long"), limit=3).collect()}
    assert out == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}
    snaps = [("a", 1, 10, "x", "t"), ("a", 2, 5, "y", "t"), ("a", 3, 12, "x", "t"), ("a", 4, 12, "z", "t"), ("a", 5, 20, "z", "u"), ("a", 6, 21, "w", "t"), ("b", 7, 1, "q", "q")]
    got = {r.seq: r.outcome for r in ingest.ledger(spark.createDataFrame(snaps, "key string, seq long, at long, content string, text string")).collect()}
    assert got == {1: "new", 2: "duplicate", 3: "advanced", 4: "conflict", 5: "quarantined", 6: "updated", 7: "new"}


def test_pagerank_closed_form_and_dangling(spark):
    two = graph.pagerank(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double"))
    assert {r.node: round(r["rank"], 6) for r in two.collect()} == {"a": 0.5, "b": 0.5}
    dangling = graph.pagerank(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0)], "src string, dst string, w double"))
    assert abs(sum(r["rank"] for r in dangling.collect()) - 1) < 1e-9


def test_replaying_a_batch_changes_nothing(spark):
    rows = [("p", i, t, m) for i, (t, m) in enumerate([("x", 5), ("x", 7), ("x", 6)])]
    df = spark.createDataFrame(rows + [(k, s + 10, t, m) for k, s, t, m in rows], "key string, seq long, text string, at long")
    assert [r.action for r in ingest.upsert_actions(df, "key", "seq", "at").orderBy("seq").collect()] == ["inserted", "updated", "skipped", "skipped", "skipped", "skipped"]


def test_files(spark, tmp_path):
    counts = {"likes": 1, "retweets": 0, "quotes": 0, "replies": 0}
    good = {"kind": "tweet", "id": "1", "text": "hi", "authorId": "2", "createdAt": NOW, "metrics": counts, "metricsAt": NOW, "media": [], "quotedTweetId": None, "retweetOfTweetId": None, "inReplyToTweetId": None}
    ann = {"kind": "author", "id": "2", "handle": "ann", "displayName": "Ann", "followerCount": 1, "followingCount": 0, "verified": False, "createdAt": NOW}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps(ann) + "\n" + json.dumps({**good, "x": 1}) + "\n" + json.dumps({k: v for k, v in good.items() if k != "quotedTweetId"}) + "\n")
    posts, authors, bad = ingress.read_ingress(spark, str(tmp_path / "in"))
    assert posts.count() == 1 and authors.first().handle == "ann" and bad.filter("reason = 'broken'").count() == 1
    assert {r.reason for r in bad.collect()} == {"blank", "broken", "unknown_key", "bad_quotedTweetId"}
    ingress.write_quarantine(bad, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == bad.count()
    manifest = ingress.archive_manifest(spark, str(tmp_path / "in"))
    frozen = spark.createDataFrame(manifest.collect(), manifest.schema)
    (tmp_path / "in" / "a.jsonl").write_text("changed")
    assert [r.problem for r in ingress.verify_archive(frozen, ingress.archive_manifest(spark, str(tmp_path / "in"))).collect()] == ["changed"]


PERSON = {"id": "100", "screen_name": "@Seed", "name": "Seed", "followers": 3, "following": 2, "joined": "Mon Sep 01 05:05:29 -0700 2014", "verification": {"verified": False}}


def status(i, text="hello", **k):
    base = {"type": "status", "id": str(i), "text": text, "created_timestamp": 1700000000 + i, "likes": 1, "reposts": 0, "replies": 0, "quotes": 0, "author": PERSON, "media": {"all": [{"type": "photo", "url": "https://x.example/1"}] * 2}}
    return {key: v for key, v in {**base, **k}.items() if v != "gone"}


def by_code(run):
    return {(r.section, r.key): r.n for r in run.counts.collect()}


def test_a_run(spark, tmp_path):
    other = {**PERSON, "id": "300", "screen_name": "Quoted"}
    old, deep = 1500000000, status(31, author=other, quote=status(32, author={**PERSON, "id": "400"}))
    pages_ = {
        ("100", 1, 10): [
            status(1, quote=status(30, author=other)),
            status(2, likes="gone"),
            status(3, text=" ", author={k: v for k, v in PERSON.items() if k != "followers"} | {"verification": {}}),
            status(4, likes="1"),
            {"type": "tombstone", "id": "5"},
            status(6, quote={"type": "tombstone", "id": "60"}, replying_to={"screen_name": "x", "status": "61"}),
            status(7, created_timestamp=old),
            status(8, created_timestamp=old, reposted_by={"id": "1"}),
            status(9, quote=deep),
        ],
        ("100", 2, 20): [status(1, likes=9), status(2, text="late"), status(10, media={"all": [{"type": "odd", "url": "u"}]}), status(11, author=None), status(12, author={**PERSON, "joined": "never"})],
        ("200", 1, 15): [status(1, text="other words"), status(1), status(30, author=other, raw_text={"facets": [{"type": "hashtag", "original": "#a"}, {"type": "hashtag", "original": "#a"}, {"type": "url", "replacement": "r"}]})],
    }
    for n, ((account, page, at), results) in enumerate(pages_.items()):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"accountUserId": account, "page": page, "receivedAt": at, "results": results}))
    accounts = spark.createDataFrame([("100", 0), ("200", 1)], "account string, place int")
    run = N.normalise_run(pages.read_pages(spark, str(tmp_path)), accounts, cutoff_ms=1600000000000)
    n = by_code(run)
    assert (n["candidates", "timeline"], n["candidates", "embedded"]) == (17, 3)
    assert (n["accepted", "timeline"], n["accepted", "embedded"]) == (5, 3)
    reasons = {k[1]: v for k, v in n.items() if k[0] == "rejected_reason"}
    assert reasons == {"missing_metric": 1, "empty_text": 1, "missing_author_counts": 1, "missing_author_verification": 1, "invalid_response_shape": 2, "invalid_media": 1, "missing_author": 1, "missing_author_created_at": 1, "conflicting_tweet_text": 1}
    assert (n["skipped", ""], n["tombstone_quotes", ""], n["repeated_rows", ""]) == (1, 1, 2)
    assert (n["duplicates", "refreshed"], n["duplicates", "duplicate"]) == (2, 1)
    posts = {r.post_id: r for r in run.posts.collect()}
    assert (posts["1"].likes, posts["1"].metrics_at, posts["1"].origin, posts["1"].quoted_id) == (9, 20, "timeline", "30")
    assert posts["30"].origin == "embedded" and posts["32"].author_id == "400" and len(posts["1"].media) == 1 and posts["6"].reply_to_id == "61"
    assert {r.author_id: r.accepted for r in run.authors.collect()} == {"100": 5, "300": 2, "400": 1}
    order = [(r.kind, r.id) for r in N.emission(run).collect()]
    assert order[:4] == [("author", "100"), ("tweet", "1"), ("author", "300"), ("tweet", "30")]
    assert order.index(("author", "400")) + 1 == order.index(("tweet", "32"))
    assert run.rejections.filter("candidate_id = '1'").first().account == "200"
    empty = N.normalise_run(pages.read_pages(spark, str(tmp_path)).limit(0), accounts, cutoff_ms=0)
    assert empty.posts.count() == 0


def test_states_of_accounts(spark):
    rows = [
        ("null", 1, 5, None, 9, None),
        ("empty", 1, 0, "a", None, None), ("empty", 2, 0, "b", None, None), ("empty", 3, 0, "c", None, None), ("empty", 4, 3, "d", 9, None),
        ("broken run", 1, 0, "a", None, None), ("broken run", 2, 1, "b", 9, None), ("broken run", 3, 0, "c", None, None), ("broken run", 4, 0, "d", None, None),
        ("stalled", 1, 3, "a", 9, None), ("stalled", 2, 3, "a", 9, None),
        ("old", 1, 3, "a", 9, None), ("old", 2, 3, "a", 1, None),
        ("gone", 1, 3, "a", 9, None), ("gone", 2, 0, None, None, "profile_not_found"),
    ]
    pages_ = spark.createDataFrame(rows, "account string, page int, n_rows long, cursor string, authored_ms long, error string")
    accounts = spark.createDataFrame([(a, a == "stalled") for a in {r[0] for r in rows} | {"later"}], "account string, abandoned boolean")
    got = {r.account: (r.state, r.reason, r.pages) for r in C.acquisition_outcomes(pages_, cutoff_ms=5).collect()}
    assert got == {
        "null": ("completed", "cursor_exhausted", 1), "empty": ("completed", "cursor_exhausted", 3), "broken run": ("active", None, 4),
        "stalled": ("paused", "cursor_stalled", 2), "old": ("completed", "history_cutoff", 2), "gone": ("paused", "profile_not_found", 2),
    }
    whole = C.acquisition_outcomes(pages_, accounts, cutoff_ms=5)
    assert {r.account: r.state for r in whole.collect()}["stalled"] == "abandoned" and C.run_status(whole).first().status == "in_progress"


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"p{i % 5}", i, i * 2) for i in range(20)]
    src = str(tmp_path / "src")
    shape = "post_id string, metrics_at long, likes long"
    spark.createDataFrame(rows[:10], shape).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[10:] + [("p0", 3, 999)], shape).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.latest_metrics(stream).writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.post_id: r.likes for r in spark.sql("select post_id, max_by(likes, metrics_at) as likes from newest group by post_id").collect()}
    assert got == {f"p{i}": (15 + i) * 2 for i in range(5)}
    q = live.running_document_frequencies(stream.select(F.col("post_id").alias("term"))).writeStream.outputMode("complete").format("memory").queryName("dfs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.term: r.df for r in spark.table("dfs").collect()} == {"p0": 5, "p1": 4, "p2": 4, "p3": 4, "p4": 4}


def test_index_stream(spark, tmp_path):
    rows = [tuple(post(i, f"word{i} apple")[c.split()[0]] for c in SHAPE.split(", ")) for i in range(4)]
    spark.createDataFrame(rows, SHAPE).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "src"))
    q = live.index_stream(stream, str(tmp_path / "index"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "index")).filter("term = 'apple'").count() == 4
    spark.createDataFrame(rows[:2], SHAPE).write.mode("append").parquet(str(tmp_path / "src"))  # known posts again
    q = live.index_stream(stream, str(tmp_path / "index"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "index")).filter("term = 'apple'").count() == 4


def test_streams_of_votes_and_chunks(spark, tmp_path):
    votes = [(1, i % 4, 1, i // 3, i) for i in range(8)] + [(1, 9, 1, 70, 8), (2, 1, -1, 0, 9), (1, 0, -1, 71, 10)]
    shape = "voter long, post_id long, vote int, at_s long, seq long"
    chunks = [("r", 0, 3), ("r", 0, 3), ("r", 2, 3), ("s", 0, 1), ("t", 0, 2), ("t", 1, 3), ("r", 1, 3)]
    for name, rows, of in (("v", votes, shape), ("c", chunks, "request_id string, chunk_index long, chunk_count long")):
        for part in (rows[:6], rows[6:]):
            spark.createDataFrame(part, of).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name, of: spark.readStream.schema(of).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    run = lambda df, mode, name: df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}_c")).trigger(availableNow=True).start().awaitTermination(120)
    run(live.rate_limited_votes(read("v", shape), limit=3), "update", "limited")
    got = {r.voter: (r.a, r.r) for r in spark.sql("select voter, sum(accepted) a, sum(rejected) r from limited group by voter").collect()}
    batch = ingest.rate_limited_votes(spark.createDataFrame(votes, shape), limit=3).groupBy("voter").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    assert got == {r.voter: (r.a, r.r) for r in batch.collect()} and got[1][0] > 3
    run(live.chunk_progress(read("c", "request_id string, chunk_index long, chunk_count long")), "complete", "chunks")
    assert {r.request_id: (r.received, r.consistent, r.complete) for r in spark.table("chunks").collect()} == {"r": (3, True, True), "s": (1, True, True), "t": (2, False, False)}


def test_staged_events(spark):
    ann = {"id": "1", "screen_name": "ann", "name": "Ann", "followers": 1, "following": 1, "verification": {"verified": True}, "joined": "2020-01-01T00:00:00Z"}
    good = {"id": "5", "text": "hi", "author": ann, "created_timestamp": 1756700000, "likes": 1, "reposts": 1, "quotes": 0, "replies": 0}
    video = {**good, "id": "6", "media": {"videos": [{"variants": [{"url": "http://no"}, {"url": "https://v.example/a?b"}]}], "photos": [{"type": "photo", "url": "https://p.example/1"}]}}
    deep = good
    for i in range(40):
        deep = {"id": str(100 + i), "quote": deep}
    payload = {"posts": [{**good, "quote": video}, {**good, "media": {"all": [{"type": "odd", "url": "https://x.example/"}]}}, deep], "users": [ann, {**ann, "followers": -1}], "profile": {}}
    df = spark.createDataFrame([(1, json.dumps({"payload": payload}))], "seq long, line string").withColumn("o", F.expr("try_parse_json(line)"))
    got = {r.location: (r.kind, r.record_id, r.issue) for r in events.staged(df, "seq").collect()}
    assert got["posts[0]"] == ("tweet", "5", None) and got["posts[0].quote"] == ("tweet", "6", None) and got["posts[0].quote.author"] == ("author", "1", None)
    assert got["posts[1]"][2] == "media" and got["users[1]"][2] == "followers" and got["profile"][2] == "id" and got["users[0]"][2] is None
    assert got["posts[2]" + ".quote" * 32][2] == "text" and got["posts[2]" + ".quote" * 33][2] == "too_deep" and "posts[2]" + ".quote" * 34 not in got
    kinds = df.select(events.media_items("o").alias("m")).first().m
    assert kinds == []


def test_batches_on_disk(spark, tmp_path):
    rows = [tuple(post(i, f"word{i} apple")[c.split()[0]] for c in SHAPE.split(", ")) for i in range(5)]
    df = spark.createDataFrame(rows, SHAPE)
    assert ingress.stage_batches(df, str(tmp_path / "b"), 2) == 3
    with pytest.raises(Exception, match="exists"):
        ingress.stage_batches(df, str(tmp_path / "b"), 2)
    e = SearchEngine(df.limit(0))
    assert [r["inserted"] for r in ingress.replay_batches(spark, str(tmp_path / "b"), e)] == [2, 2, 1]
    assert {r["skipped"] for r in ingress.replay_batches(spark, str(tmp_path / "b"), e)} == {2, 1} and e.total == 5
    found = ingress.batch_hash(spark, str(tmp_path / "b"))
    for expected, waiting in (("x", df.limit(0)), (found, df)):
        with pytest.raises(ValueError):
            ingress.acknowledge(spark, str(tmp_path / "b"), expected, waiting)
    ingress.acknowledge(spark, str(tmp_path / "b"), found, df.limit(0))
    new = df.limit(1).withColumn("text", F.lit("new"))
    assert {r.text for r in ingress.replace_documents(df, new, "post_id", "ingress_seq").collect()} == {"new"} | {f"word{i} apple" for i in range(1, 5)}


def test_config(tmp_path):
    value = {"apiBaseUrl": "a", "apiVersion": "1", "specificationUrl": "s", "selectedOn": "d", "accounts": [{"handle": "@Ann", "expectedUserId": "1", "cohort": "x"}, {"handle": "bob", "expectedUserId": "2", "cohort": "y"}]}
    (tmp_path / "c.json").write_text(json.dumps(value))
    c = config.read_config(str(tmp_path / "c.json"))
    assert c.identity == config.parse_config(dict(reversed(value.items()))).identity and [a.handle for a in c.select(["ANN"])] == ["Ann"] and [a.handle for a in c.select(cohort="y")] == ["bob"]
    for bad in ({**value, "apiVersion": " "}, {**value, "accounts": []}, {**value, "accounts": value["accounts"][:1] * 2}, {**value, "accounts": [{"handle": "a b", "expectedUserId": "1"}]}, {**value, "accounts": [{"handle": "a", "expectedUserId": 1}]}):
        with pytest.raises(ValueError):
            config.parse_config(bad)
    with pytest.raises(ValueError):
        c.select(["zed"])


def test_pinned_rows_of_several_pages(spark):
    tail = [(q, f"{q}{i}", f"c{i // 2}", i) for q in ("a", "b", None) for i in range(1, 7)]
    pinned = [("a", "a5", "c2", 1), ("a", "a1", "c0", 2), ("a", "a5", "c2", 3), (None, "None3", "c1", 1)]
    tail, pinned = spark.createDataFrame(tail, "q string, post_id string, chain string, rnk int"), spark.createDataFrame(pinned, "q string, post_id string, chain string, shown int")
    pages = {}
    for r in R.merge_pinned(pinned, tail, by=["q"]).collect():
        pages.setdefault(r.q, []).append((r.pos, r.section[0] + r.post_id[-1]))
    assert {q: [x for _, x in sorted(p)] for q, p in pages.items()} == {"a": ["p5", "p1", "t2", "t3", "t6"], "b": ["t1", "t2", "t3", "t4", "t5", "t6"], None: ["p3", "t1", "t4", "t5", "t6"]}
    assert sorted(p for p, _ in pages["a"]) == [1, 2, 3, 4, 5]
    one = R.merge_pinned(pinned.filter("q = 'a'"), tail.filter("q = 'a'"), window=1)
    assert [r.post_id for r in one.orderBy("pos").collect()] == ["a5", "a1", "a2", "a3", "a6"]


def test_every_query_has_its_page(spark):
    queries = spark.read.parquet(f"{SMALL}/candidates.parquet").select("query_key").distinct().count()
    assert entry.queries()["pinned_paging"](spark, SMALL).select("query_key").distinct().count() == queries > 1


def test_pairs_of_one_post_stay(spark):
    n = {r.one: r.n for r in entry.queries()["adjacent_bigrams"](spark, SMALL).groupBy((F.col("df") == 1).alias("one")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[True] > 0 and n[True] + n[False] == entry.queries()["adjacent_bigrams"](spark, SMALL).count()


def test_cut_and_loose_lines(spark):
    line = '{"kind": "author", "id": "7", "handle": "a", "displayName": "A", "followerCount": 3, "followingCount": 0, "verified": true, "createdAt": 5}'
    cut = spark.createDataFrame([(1, line), (2, line[:20]), (3, line.replace("3", "-3")), (4, None)], "seq int, line string")
    assert {r.seq: r.reason for r in ingest.decode_ingress(cut).collect()} == {1: None, 2: "broken", 3: "bad_followerCount", 4: "broken"}
    full = {"id": "5", "text": " hi ", "author": {"id": "9", "screen_name": "Ann", "followers": 4, "verification": {"verified": True}}, "created_at": "Mon Sep 01", "created_timestamp": 1756700000, "reposts": 2, "metrics": {"likes": 7, "retweets": 3}}
    full |= {"media": {"all": [{"type": "Photo", "url": "u"}, {"type": "video"}, {"type": "odd", "url": "v"}]}, "quote": {"id": "6"}, "replying_to": {"status": "8"}}
    rows = [full, {**full, "likes": "7"}, {**full, "kind": "tweet"}, {**full, "type": "tombstone"}, {**full, "text": "  "}, {**full, "author": None}, {"id": "5", "text": "x", "author_id": "1"}]
    got = ingest.decode_loose(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, line string"), "line").orderBy("i").collect()
    assert [r.reason for r in got] == [None, "bad_type", "strict", "tombstone", "empty_text", "missing_author_id", "missing_created_ms"]
    r = got[0]
    assert (r.text, r.created_ms, r.metrics_at, r.likes, r.reposts, r.quoted_id, r.reply_to_id, r.media_type) == ("hi", 1756700000000, 1756700000000, 7, 2, "6", "8", "image")
    assert len(r.media) == 1 and (r.author.handle, r.author.display_name, r.author.follower_count, r.author.verified, r.author.created_ms) == ("Ann", "Ann", 4, True, 1756700000000)
