"""SQL twins (DuckDB) of the general problems' queries. That of p2 takes a source's declared order and zone as they are, as
the mixture must find them on these tables."""

from __future__ import annotations

from plover.operators.csvload import REJECTION_CODES
from plover.queries.sqlparts import canon, instants

_FILES = """src AS (SELECT 'loose_posts' AS record_table, stream_id, file_no, source_file, raw_line AS line FROM loose_posts UNION ALL SELECT 'capture_events', stream_id, file_no, source_file, properties FROM capture_events),
j AS (SELECT * EXCLUDE line, CASE WHEN json_valid(line) THEN CASE WHEN json_type(line) = 'VARCHAR' THEN CASE WHEN json_valid(CAST(line AS JSON)->>'$') THEN CAST(CAST(line AS JSON)->>'$' AS JSON) END ELSE CAST(line AS JSON) END END AS o FROM src),
names AS (SELECT record_table, stream_id, file_no, min(source_file) AS source_file FROM j GROUP BY record_table, stream_id, file_no),
files AS (SELECT *, row_number() OVER (PARTITION BY record_table, stream_id ORDER BY file_no) AS ord FROM names),
cells AS (SELECT record_table, stream_id, file_no, k, CASE json_type(o, '$."' || k || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS t
  FROM (SELECT *, unnest(json_keys(o)) AS k FROM j WHERE json_type(o) = 'OBJECT')),
f AS (SELECT record_table, stream_id, ord, k, array_to_string(list_sort(list(DISTINCT t)), '|') AS types FROM cells JOIN files USING (record_table, stream_id, file_no) WHERE t IS NOT NULL GROUP BY ALL)"""

_P3 = f"""WITH {_FILES},
cmp AS (SELECT coalesce(a.record_table, b.record_table) AS record_table, coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(b.ord, a.ord + 1) AS ord, coalesce(a.k, b.k) AS k, a.types AS old, b.types AS new
  FROM f a FULL JOIN f b ON a.record_table = b.record_table AND a.stream_id = b.stream_id AND a.ord + 1 = b.ord AND a.k = b.k),
ev AS (SELECT cmp.*, source_file, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'retyped' END AS kind, coalesce(new, old) AS types FROM cmp JOIN files USING (record_table, stream_id, ord) WHERE ord > 1),
mv AS (SELECT record_table, stream_id, ord, types, max(k) FILTER (kind = 'removed') AS o, max(k) FILTER (kind = 'added') AS n FROM ev WHERE kind IN ('added', 'removed') GROUP BY ALL HAVING count(*) FILTER (kind = 'added') = 1 AND count(*) FILTER (kind = 'removed') = 1)
SELECT record_table, source_file, o AS field_name, 'renamed' AS change_kind, n AS new_name FROM mv JOIN files USING (record_table, stream_id, ord)
UNION ALL SELECT record_table, source_file, k, kind, '' FROM ev WHERE kind = 'retyped' OR (kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mv WHERE mv.record_table = ev.record_table AND mv.stream_id = ev.stream_id AND mv.ord = ev.ord AND mv.types = ev.types))"""

_P3_LIVES = f"""WITH {_FILES}, s AS (SELECT *, CASE WHEN lag(ord) OVER w = ord - 1 AND lag(types) OVER w = types THEN 0 ELSE 1 END AS st FROM f WINDOW w AS (PARTITION BY record_table, stream_id, k ORDER BY ord)),
i AS (SELECT *, sum(st) OVER (PARTITION BY record_table, stream_id, k ORDER BY ord) AS isl FROM s)
SELECT record_table, stream_id, k AS field_name, types AS json_types, CAST(min(ord) AS INTEGER) AS from_ordinal, CAST(max(ord) AS INTEGER) AS to_ordinal FROM i GROUP BY record_table, stream_id, k, types, isl"""

_EVENTS = """raw AS (SELECT event_seq, lower(uuid) AS u, CASE WHEN json_type(properties) = 'VARCHAR' THEN CAST(CAST(properties AS JSON)->>'$' AS JSON) ELSE CAST(properties AS JSON) END AS o FROM capture_events),
ids AS (SELECT event_seq, replace(regexp_extract(u, '([0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})', 1), '-', '') AS key FROM raw
  UNION ALL SELECT event_seq, lower(o->>'$.request_id') || '|' || (o->>'$.chunk_index') || '|' || epoch_us(TRY_CAST(o->>'$.captured_at' AS TIMESTAMPTZ)) FROM raw),
good AS (SELECT * FROM ids WHERE key IS NOT NULL AND key <> '' AND key <> repeat('0', 32))"""

_P4 = f"""WITH RECURSIVE {_EVENTS},
link AS (SELECT DISTINCT a.event_seq AS a, b.event_seq AS b FROM good a JOIN good b USING (key)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT min(b) AS kept_seq, a AS dropped_seq FROM reach GROUP BY a HAVING min(b) < a"""


def _grammar(d: str) -> str:
    plain, quoted = f'[^"{d}]*', '"(?:[^"]|"")*"'
    field = f"(?:{quoted}|{plain})"
    return f"CASE WHEN regexp_full_match(l, '(?s){field}(?:{d}{field})*') THEN list_transform(regexp_extract_all({repr(d) if d != chr(9) else 'chr(9)'} || l, '(?s){d}({quoted}|{plain})', 1), lambda x: trim(CASE WHEN starts_with(x, '\"') THEN replace(x[2:-2], '\"\"', '\"') ELSE x END, ' ' || chr(9))) END"


_CODES = "[" + ", ".join(f"'{c}'" for c in REJECTION_CODES) + "]"
_INT = "regexp_full_match({0}, '[0-9]+') AND TRY_CAST({0} AS HUGEINT) BETWEEN {1} AND 2147483647"
_LINES = f"""WITH h AS (SELECT load_file, regexp_extract(line, '^\\x{{FEFF}}?"?kind"?([,;\\t])', 1) AS d FROM rejection_lines WHERE line_no = 1),
s AS (SELECT raw_seq, d, regexp_replace(regexp_replace(line, '\\r$', ''), '^\\x{{FEFF}}', '') AS l FROM rejection_lines JOIN h USING (load_file)),
p AS (SELECT raw_seq, l, CASE d WHEN ';' THEN {_grammar(';')} WHEN chr(9) THEN {_grammar(chr(9))} ELSE {_grammar(',')} END AS f FROM s WHERE trim(l, ' ' || chr(9)) <> ''),
r AS (SELECT raw_seq, f, CASE WHEN f IS NULL THEN 'quoting' WHEN len(f) = 9 AND f[1] = 'kind' AND f[2] = 'accountUserId' THEN 'header' WHEN len(f) <> 9 THEN 'column_count'
  WHEN NOT coalesce(f[1] = 'rejection' AND regexp_full_match(f[2], '[0-9]+') AND {_INT.format('f[3]', 1)} AND f[4] <> '' AND {_INT.format('f[5]', 0)} AND f[6] IN ('timeline', 'embedded')
   AND regexp_full_match(f[7], '[0-9]*') AND regexp_full_match(f[8], '[0-9]*') AND list_has_all({_CODES}, string_split(f[9], '|')), false) THEN 'bad_value' END AS failure FROM p)
"""

_REFS = f"""refs AS (SELECT ingress_seq, received_at, 'author_id' AS ref_field, 'author' AS entity, {canon('author_id')} AS key FROM ingress UNION ALL SELECT ingress_seq, received_at, 'quoted_tweet_id', 'tweet', {canon('quoted_tweet_id')} FROM ingress
  UNION ALL SELECT ingress_seq, received_at, 'retweet_of_tweet_id', 'tweet', {canon('retweet_of_tweet_id')} FROM ingress UNION ALL SELECT ingress_seq, received_at, 'in_reply_to_tweet_id', 'tweet', {canon('in_reply_to_tweet_id')} FROM ingress),
seen AS (SELECT entity, key, min(received_at) AS first_at, max(received_at) AS last_at FROM (SELECT 'tweet' AS entity, {canon('id')} AS key, received_at FROM ingress UNION ALL SELECT 'author', {canon('id')}, received_at FROM authors) GROUP BY ALL),
gone AS (SELECT entity, {canon('entity_id')} AS key, max(deleted_at) AS deleted_at FROM tombstones GROUP BY ALL),
st AS (SELECT refs.*, CASE WHEN deleted_at IS NOT NULL AND (last_at IS NULL OR deleted_at >= last_at) THEN 'deleted' WHEN last_at IS NULL THEN 'missing' WHEN first_at > received_at THEN 'late' END AS ref_state
  FROM refs LEFT JOIN seen USING (entity, key) LEFT JOIN gone USING (entity, key) WHERE key IS NOT NULL)"""

_P2 = f"""WITH src AS (SELECT 'ingress' AS record_table, ingress_seq AS record_seq, feed_id, created_at AS v FROM ingress UNION ALL SELECT 'capture_events', event_seq, feed_id, event_timestamp FROM capture_events
  UNION ALL SELECT 'loose_posts', loose_seq, feed_id, coalesce(CAST(raw_line AS JSON)->>'$.created_at', CAST(raw_line AS JSON)->>'$.createdAt') FROM loose_posts WHERE json_valid(raw_line) AND json_type(raw_line) = 'OBJECT'),
timed AS (SELECT src.*, zone_name, date_order FROM src LEFT JOIN feeds USING (feed_id) WHERE v IS NOT NULL AND NOT (regexp_matches(v, '^[0-9]{{13}}$') AND TRY_CAST(v AS BIGINT) BETWEEN 1136073600000 AND 1798761599999)),
{instants('timed')}
SELECT record_table, record_seq, ms AS utc_ms FROM resolved WHERE ms BETWEEN 1136073600000 AND 1798761599999"""

_P4_ONCE = f"""{_P4.replace('SELECT min(b) AS kept_seq', ', dropped AS (SELECT min(b) AS kept_seq').replace('HAVING min(b) < a', 'HAVING min(b) < a)')}
SELECT event_seq, nullif(nullif(replace(regexp_extract(u, '([0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}})', 1), '-', ''), ''), repeat('0', 32)) AS uuid_key, lower(o->>'$.request_id') AS request_id,
 CAST(o->>'$.chunk_index' AS BIGINT) AS chunk_index, epoch_us(TRY_CAST(o->>'$.captured_at' AS TIMESTAMPTZ)) AS captured_us FROM raw WHERE event_seq NOT IN (SELECT dropped_seq FROM dropped)"""

SQL = {
    "p4_delivered_once": _P4_ONCE,
    "p6_loaded": f"""{_LINES}SELECT raw_seq, f[1] AS kind, f[2] AS account_user_id, CAST(f[3] AS INTEGER) AS page, f[4] AS raw_file, CAST(f[5] AS INTEGER) AS row_index, f[6] AS origin, nullif(f[7], '') AS parent_id, nullif(f[8], '') AS candidate_id, f[9] AS reasons FROM r WHERE failure IS NULL""",
    "p2_found": _P2,
    "p3_found": _P3,
    "p3_lifespans": _P3_LIVES,
    "p4_found": _P4,
    "p6_found": f"{_LINES}SELECT raw_seq, failure FROM r WHERE failure <> 'header'",
    "p7_found": f"WITH {_REFS} SELECT ingress_seq, ref_field, ref_state FROM st WHERE ref_state IS NOT NULL",
    "p7_report": f"WITH {_REFS} SELECT ref_field, strftime(received_at, '%Y-%m') AS period, ref_state, count(*) AS n_references, count(DISTINCT key) AS n_keys FROM st WHERE ref_state IS NOT NULL GROUP BY ALL",
}
