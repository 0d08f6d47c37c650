"""The general problems against plain Python, and their edge cases."""

import json

import brute
import pytest
from pyspark.sql import functions as F

from plover.operators import csvload, deliver_once, drift, orphans, timestamps
from plover.operators.components import connected_components
from plover.operators.prefix import prefix_sums
from plover.queries import problems

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["p2", "p3", "p4", "p6", "p7"])
def test_against_brute_force(spark, name):
    got = [tuple(r) for r in problems.QUERIES[f"{name}_found"](spark, SF).collect()]
    assert len(got) == len(set(got))
    assert set(got) == getattr(brute, name)(SF)


# ---- p2
def test_values():
    read = lambda v: timestamps.read_value(v)
    for bad in (None, "", "n/a", "25:61", "2026-02-30T10:00:00Z", "32/13/2025 10:00:00", "x" * 100000, "0", "-1", "2025-01-01 24:00", "01/02/2025 13:00 PM"):
        assert read(bad)[0] is None, bad
    assert read("03/04/2025 10:00:00")[0] == "dmy|mdy"
    assert read("13/04/2025 10:00:00")[0] == "dmy"
    assert read("1756871959162033")[0:2] == ("epoch_us", 1756871959162033)
    assert read("1.756794898504E12")[1] == 1756794898504000
    assert read("2025-01-01T00:00:00.1239+05:30")[4] == 330


def test_zones_and_orders(spark):
    rows = [
        (1, "2025-10-26 02:30:00", 1, "Europe/Berlin", "ymd"),  # shown twice: first showing
        (2, "2026-03-29 02:30:00", 1, "Europe/Berlin", "ymd"),  # skipped: offset before
        (3, "03/04/2025 10:00:00", 2, "UTC", "mdy"),
        (4, "03/04/2025 10:00:00", 3, None, None),  # nobody says
        (5, "13/04/2025 10:00:00", 4, "UTC", None),
        (6, "03/04/2025 10:00:00", 4, "UTC", None),  # the source's other value says dmy
        (7, None, 4, "UTC", None),
        (8, "2025-01-01T00:00:00[No/Where]", 4, "UTC", None),
    ]
    df = spark.createDataFrame(rows, "id int, value string, feed int, zone string, ord string").withColumn("format_x", F.lit(1))
    out = {r.id: r for r in timestamps.normalise(df, "value", "feed", "zone", "ord").collect()}
    at = lambda i: out[i].utc_ms // 1000
    assert (at(1), out[1].status) == (1761438600, "repeated_wall")
    assert (at(2), out[2].status) == (1774747800, "skipped_wall")
    assert at(3) == 1741082400 and out[3].format == "mdy"
    assert out[4].status == "no_zone" and out[4].utc_ms is None
    assert out[6].format == "dmy" and out[6].status == "resolved"
    assert out[7].status == "unreadable" and out[8].utc_ms is None
    assert timestamps.normalise(df.limit(0), "value", "feed", "zone", "ord").count() == 0


def test_values_overrule_a_wrong_declaration(spark):
    """Forty dates that can only be month first beat a declared day first; three don't."""
    schema = "id int, value string, feed int, zone string, ord string"
    rows = [(f * 100 + i, f"10/{13 + i % 15}/2025 10:00:00", f, "UTC", "dmy") for f, n in ((1, 40), (2, 3)) for i in range(n)]
    rows += [(f * 100 + 99, "03/04/2025 10:00:00", f, "UTC", "dmy") for f in (1, 2)]
    out = {r.id: r for r in timestamps.normalise(spark.createDataFrame(rows, schema), "value", "feed", "zone", "ord").collect()}
    assert (out[199].format, out[299].format) == ("mdy", "dmy")
    assert timestamps.fit([("dmy|mdy", None, 5)])["dmy|mdy"] == ("dmy", 0.5)


def test_abbreviations_mean_what_the_source_says(spark):
    rows = [
        (1, "2025-06-01 10:00:00 CST", 1, "Asia/Shanghai", "ymd"),
        (2, "2025-01-01 10:00:00 CST", 2, "America/Chicago", "ymd"),
        (3, "2025-01-01 10:00:00 IST", 3, "Asia/Kolkata", "ymd"),
        (4, "2025-07-01 10:00:00 IST", 4, "Europe/Dublin", "ymd"),
        (5, "2025-07-01 10:00:00 IST", 5, "No/Where", "ymd"),  # nobody says: the common meaning, marked
        (6, "2025-07-01 10:00:00 IST" + " " * 500, 5, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, value string, feed int, zone string, ord string")
    out = {r.id: r for r in timestamps.normalise(df, "value", "feed", "zone", "ord").collect()}
    hour = lambda i: out[i].utc_ms // 60000 % 1440
    assert [hour(i) for i in range(1, 7)] == [120, 960, 270, 540, 270, 270]
    assert {out[i].status for i in (1, 2, 3, 4)} == {"resolved"} and out[5].status == out[6].status == "ambiguous_zone"


def test_open_order_is_marked(spark):
    df = spark.createDataFrame([(1, "03/04/2025 10:00:00", 3, "UTC", None)], "id int, value string, feed int, zone string, ord string")
    assert timestamps.normalise(df, "value", "feed", "zone", "ord").first().status == "ambiguous_order"


# ---- p3
def test_drift(spark):
    rows = [("s", 1, "a", '{"x": 1, "y": "t", "z": null}'), ("s", 1, "a", "{broken"), ("s", 2, "b", None), ("s", 3, "c", '"{\\"x\\": \\"1\\"}"'), ("s", 5, "d", '{"w": "1"}'), ("s", 5, "d", "[1]")]
    lines = spark.createDataFrame(rows, "producer string, file_no int, source_file string, line string")
    got = {tuple(r)[:4] for r in drift.schema_changes(lines).select("source_file", "field_name", "change_kind", "new_name").collect()}
    assert got == {("b", "x", "removed", ""), ("b", "y", "removed", ""), ("c", "x", "added", ""), ("d", "x", "renamed", "w")}
    assert drift.schema_changes(lines.limit(0)).count() == 0
    table = drift.unified(lines, {"n": ("bigint", ["$.x"])}, ["file_no"])
    assert {(r.file_no, r.n) for r in table.collect()} == {(1, 1), (3, 1), (5, None)}


def test_unified_drops_no_value(spark):
    rows = [(1, '{"x": 12.7, "l": ["en"], "new": {"a": [1]}, "z": null}'), (2, '{"x": 3, "l": "de", "more": "m"}'), (3, '{"x": true, "l": ["fr", "en"], "j": [1, 2]}'), (4, "{broken")]
    lines = spark.createDataFrame(rows, "seq long, line string")
    out = drift.unified(lines, {"n": ("bigint", ["$.x"]), "lang": ("string", ["$.l", "$.l[0]"]), "j": ("json", ["$.j"])}, ["seq"])
    assert {r.seq: (r.lang, r.j, r.rest) for r in out.collect()} == {
        1: ("en", None, {"x": "12.7", "l": '["en"]', "new": '{"a":[1]}'}),
        2: ("de", None, {"more": '"m"'}),
        3: ("fr", "[1,2]", {"x": "true", "l": '["fr","en"]'}),
    }
    assert {r.seq: r.n for r in out.collect()}[2] == 3


def test_columns_come_from_the_catalogue(spark):
    rows = [("s", 1, "a", '{"id": "1", "likes": 1, "flag": true, "odd": "x", "a-b": 1}'), ("s", 2, "b", '{"id": "2", "faves": 2, "flag": false, "odd": 3, "a-b": 1, "tags": [1]}')]
    lines = spark.createDataFrame(rows, "producer string, file_no int, source_file string, line string")
    aliases = drift.generated_aliases(lines, {"like_count": ("bigint", ["$.likes"]), "flag": ("boolean", ["$.flag"])})
    assert aliases == {"like_count": ("bigint", ["$.likes", "$.faves"]), "flag": ("boolean", ["$.flag"]), "id": ("string", ["$.id"]), "odd": ("json", ["$.odd"]), "tags": ("json", ["$.tags"])}
    out = {r.file_no: r for r in drift.unified(lines, aliases, ["file_no"]).collect()}
    assert (out[1].like_count, out[2].like_count, out[1].odd, out[2].odd, out[2].tags, out[1].rest) == (1, 2, '"x"', "3", "[1]", {"a-b": "1"})
    assert drift.generated_aliases(lines.limit(0), {"flag": ("boolean", ["$.flag"])}) == {"flag": ("boolean", ["$.flag"])}


def test_unified_holds_every_field_of_both_tables(spark):
    out = {(r.record_table, r.record_seq): r.asDict() for r in problems.p3_unified(spark, SF).collect()}
    seen, paths = set(), {**problems.POST_ALIASES, **problems.EVENT_ALIASES}
    columns = {}
    for name, (_, of) in paths.items():
        for path in of:
            columns.setdefault(path[2:], set()).add(name)
    for name, seq, line in (("loose_posts", "loose_seq", "raw_line"), ("capture_events", "event_seq", "properties")):
        for r in spark.read.parquet(f"{SF}/{name}.parquet").select(seq, line).collect():
            try:
                object_ = json.loads(r[1])
                object_ = json.loads(object_) if isinstance(object_, str) else object_
            except (ValueError, TypeError):
                continue
            if not isinstance(object_, dict):
                continue
            seen.add((name, r[0]))
            row = out[name, r[0]]
            for field, value in object_.items():
                if value is None:
                    continue
                values = [row[c] for c in columns.get(field, ())]
                if isinstance(value, str):
                    same = value in [str(v).lower() if isinstance(v, bool) else str(v) for v in values] or json.dumps(value, ensure_ascii=False) in values
                elif isinstance(value, list | dict):
                    same = any(isinstance(v, str) and v[:1] in "[{" and json.loads(v) == value for v in values)
                else:
                    same = any(v == value or v == str(value) for v in values)
                assert same or json.loads((row["rest"] or {})[field]) == value, (name, r[0], field)
    assert seen == set(out)


# ---- p4
def test_deliver_once(spark):
    rows = [(1, "a", "r1"), (2, "a", "r2"), (3, "b", "r2"), (4, None, None), (5, "c", "r9"), (6, "b", None), (7, None, None)]
    df = spark.createDataFrame(rows, "seq long, u string, r string").withColumn("at", F.when(F.col("seq") % 2 == 0, F.expr("timestamp_seconds(seq * 100000)"))).withColumn("n", F.lit(1))
    ids = {"u": F.col("u"), "r": F.col("r")}
    got = {tuple(r) for r in deliver_once.redelivered(df, "seq", F.col("at"), ids).collect()}
    assert got == {(1, 2), (1, 3), (1, 6)}
    assert {r.seq for r in deliver_once.deliver_once(df, "seq", F.col("at"), ids).collect()} == {1, 4, 5, 7}
    assert deliver_once.redelivered(df.limit(0), "seq", F.col("at"), ids).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (100, 100), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


# ---- p6
@pytest.mark.parametrize(
    ("line", "failure"),
    [
        ("rejection,1,1,f,0,timeline,,,empty_text", ""),
        ('rejection,1,1,"a ""b"", c\nd",0,timeline,,,empty_text\r', ""),
        ('rejection,1,1,a"b,0,timeline,,,empty_text', "quoting"),
        ('rejection,1,1,"a"b,0,timeline,,,empty_text', "quoting"),
        ('rejection,1,1,"a,0,timeline,,,empty_text', "quoting"),
        ("rejection,1,1,f,0,timeline,,", "column_count"),
        ("rejection,1,0,f,0,timeline,,,empty_text", "bad_value"),
        ("rejection,1,2147483648,f,0,timeline,,,empty_text", "bad_value"),
        ("rejection,１,1,f,0,timeline,,,empty_text", "bad_value"),
        ("rejection,1,1, ,0,timeline,,,empty_text", "bad_value"),
        (" rejection ,1,1,f,0,timeline,,,empty_text|nonsense", "bad_value"),
        ("", None),
        ("  \r", None),
        ('﻿"kind",accountUserId,page,rawFile,index,origin,parentId,candidateId,reasons', None),
    ],
)
def test_records(line, failure):
    assert csvload.parse_record(line, ",")[0] == failure


def test_long_record():
    assert csvload.parse_record("rejection,1,1," + "x" * 2_000_000 + ",0,timeline,,,empty_text", ",")[0] == ""


def test_stream_resumes_after_a_broken_quote():
    good = "rejection,1,1,f,0,timeline,,,empty_text"
    text = "\n".join([good, 'rejection,1,1,"open,0,timeline,,,empty_text', good, 'rejection,1,1,"two\nlines",0,timeline,,,empty_text', good])
    got = [(text[a:b], failure) for a, b, failure, _ in csvload.parse_stream(text, ",")]
    assert [f for _, f in got] == ["", "quoting", "", "", ""]
    assert got[3][0].endswith('lines",0,timeline,,,empty_text')


def test_lines_are_parsed_as_running_text():
    good, tail = "rejection,1,1,f,0,timeline,,,empty_text", ",0,timeline,,,empty_text"
    lines = [
        good,
        'rejection,1,1,"open' + tail,  # runs on until a quote closes it
        "no record at all",
        "rejection,1,1",
        good + "\r",
        'rejection,1,1,"two\nlines, ""so""' + '"' + tail,
        'rejection,1,1,"open' + tail,  # closed by the next line's quote, which is no record's end
        'rejection,1,1,"shut"' + tail,
        'rejection,1,1,f,0,timeline,,,"empty_text',  # would take in the next line whole
        '",x',
        "",
        'rejection,1,1,"never closed' + tail,
    ]
    assert list(csvload.parse_lines(lines, ",")) == [csvload.parse_record(line, ",") for line in lines]
    assert [r[0] for r in csvload.parse_lines(lines, ",")] == ["", "quoting", "column_count", "column_count", "", "", "quoting", "", "quoting", "quoting", None, "quoting"]


def test_recovery_decides_where_to_resume(monkeypatch):
    """Without anchors everything behind a broken quote is judged line by line, by them records are parsed once."""
    good, bad = "rejection,1,1,f,0,timeline,,,empty_text", 'rejection,1,1,"open,0,timeline,,,empty_text'
    run = csvload.Recovery("\n".join([bad, "x", good]), ",", [0, len(bad) + 1, len(bad) + 3])
    assert run.anchor_after(0) == 2 and not run.is_anchor(1)
    text = "\n".join([good, bad, "x", "y", good, good])
    assert [f for *_, f, _ in csvload.parse_stream(text, ",")] == ["", "quoting", "", ""]
    monkeypatch.setattr(csvload.Recovery, "is_anchor", lambda *_: False)
    assert [f for *_, f, _ in csvload.parse_stream(text, ",")] == ["", "quoting", "column_count", "column_count", "", ""]


def test_blocks(spark, monkeypatch):
    rows = [(i, "f", i // 2, ('rejection,1,1,"open' if i % 7 == 0 else "rejection,1,1,f") + ",0,timeline,,,empty_text") for i in range(300)]
    df = spark.createDataFrame(rows, "raw_seq long, load_file string, line_no int, line string")
    monkeypatch.setattr(csvload, "BLOCK_LINES", 16)
    got = {r.raw_seq: r.failure for r in csvload.load_rejections(df).collect()}
    assert got == {i: "quoting" if i % 7 == 0 else None for i in range(300)}


def test_load_without_header(spark):
    df = spark.createDataFrame([(1, "f", 7, "rejection,1,1,f,0,timeline,,,empty_text", "x"), (2, "f", 8, None, "x")], "raw_seq long, load_file string, line_no int, line string, kind string")
    assert [(r.raw_seq, r.failure, r.reasons) for r in csvload.load_rejections(df).collect()] == [(1, None, ["empty_text"])]
    assert csvload.load_rejections(df.limit(0)).count() == 0


# ---- p7
def test_orphans(spark):
    t = lambda s: F.expr(f"timestamp_seconds({s})")
    refs = spark.createDataFrame([(i, "f", "e", k, s) for i, k, s in [(1, "a", 5), (2, "a", 50), (3, "b", 5), (4, None, 5), (5, "c", 5), (6, "d", 5), (7, "e", 5), (1, "a", 5)]], "ref_seq long, ref_field string, entity string, key string, s int").withColumn("seen_at", t("s")).withColumn("hot", F.lit(1))
    targets = spark.createDataFrame([("e", "a", 10), ("e", "c", 3), ("e", "d", 3), ("e", "d", 9)], "entity string, key string, s int").withColumn("seen_at", t("s"))
    gone = spark.createDataFrame([("e", "c", 3), ("e", "d", 4), ("e", "e", 1), ("e", "e", 1)], "entity string, key string, s int").withColumn("deleted_at", t("s"))
    for parts in (1000, 2):  # without and with heavy keys
        got = sorted((r.ref_seq, r.ref_state) for r in orphans.orphan_references(refs, targets, gone, heavy_parts=parts).collect())
        assert got == [(1, "late"), (1, "late"), (3, "missing"), (5, "deleted"), (7, "deleted")]
        report = {(r.ref_state, r.n_references, r.n_keys) for r in orphans.orphan_report(refs, targets, gone, heavy_parts=parts).collect()}
        assert report == {("late", 2, 1), ("missing", 1, 1), ("deleted", 2, 2)}
    assert orphans.orphan_references(refs.limit(0), targets, gone).count() == 0
    assert orphans.orphan_references(refs, targets.limit(0), gone.limit(0)).count() == 7


def test_prefix_sums(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, n long")
    want, total = {}, {}
    for g, o, n in rows:
        want[o] = total.get(g, 0)
        total[g] = want[o] + n
    assert {r.o: r.before for r in prefix_sums(df, ["g"], ["o"], "n").collect()} == want
    assert prefix_sums(df.limit(0), ["g"], ["o"], "n").count() == 0
