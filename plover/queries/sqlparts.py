"""Building blocks of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from plover import lexicons
from plover.functions import text as X
from plover.operators.ingest import AHEAD_MS, FIRST_MS
from plover.operators.timestamps import ABBREVIATIONS, AMBIGUOUS
from plover.queries.store import NOW


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canon(column: str) -> str:
    return f"nullif(ltrim(regexp_extract({column}, '[0-9]+'), '0'), '')"


# ---- instants: another way than the operator's. Regular expressions per template; the clock of a zone is looked at a day
# before and a day after the wall time, so times shown twice or skipped need no rule of the time zone library.
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,18}))?)?"
_OFFSET = r"(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})?(\[[^\]]{1,64}\])?"
_AMPM = r"(?: ?([AaPp][Mm]))?"
_SHAPES = {
    "ymd": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[Tt ]{_CLOCK} ?{_OFFSET}$", "y mo d h mi s f zone region"),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,18}}))?{_OFFSET}$", "y mo d h mi s f zone region"),
    "day_name": (rf"^(?:[A-Za-z]{{3}},? )?(\d{{1,2}}) ([A-Za-z]{{3,9}}) (\d{{4}}),? {_CLOCK} ?{_OFFSET}$", "d mon y h mi s f zone region"),
    "unix_date": (rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) (\d{{1,2}}) {_CLOCK} {_OFFSET} (\d{{4}})$", "mon d h mi s f zone region y"),
    "name_day": (rf"^([A-Za-z]{{3,9}}) (\d{{1,2}}), (\d{{4}}),? {_CLOCK}{_AMPM}$", "mon d y h mi s f half"),
    "open": (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}),? {_CLOCK}{_AMPM}$", "a b y h mi s f half"),
}
_PARTS = "y mo d mon a b h mi s f zone region half".split()
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"


def instants(source: str) -> str:
    """CTEs ending in ``resolved``: the columns of ``source`` plus ms (null: no instant) for its v, zone_name and date_order."""
    shapes = ", ".join(
        f"regexp_matches(x, {q(pattern)}) AS is_{name}, regexp_extract(x, {q(pattern)}, [{', '.join(q(g) for g in groups.split())}]) AS p_{name}" for name, (pattern, groups) in _SHAPES.items()
    )
    picked = ", ".join(
        "CASE " + " ".join(f"WHEN is_{name} THEN p_{name}.{part}" for name, (_, groups) in _SHAPES.items() if part in groups.split()) + f" ELSE '' END AS {part}" for part in _PARTS
    )
    minutes = {k: v for k, v in ABBREVIATIONS.items()} | {k: v[0] for k, v in AMBIGUOUS.items()}
    known = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in minutes.items())
    num = lambda c: f"TRY_CAST({c} AS INTEGER)"
    at = lambda x: f"(timezone(zn, {x} AT TIME ZONE 'UTC'))"
    return f"""i0 AS (SELECT *, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS x FROM {source}),
i1 AS (SELECT *, {shapes} FROM i0),
i2 AS (SELECT * EXCLUDE ({', '.join(f'is_{n}, p_{n}' for n in _SHAPES)}), is_open, {picked} FROM i1),
i3 AS (SELECT *, {num('y')} AS yy, CASE WHEN is_open THEN CASE WHEN {num('b')} > 12 OR ({num('a')} <= 12 AND date_order = 'mdy') THEN {num('a')} ELSE {num('b')} END WHEN mon <> '' THEN list_position({_MONTHS}, lower(mon[:3])) ELSE {num('mo')} END AS mm,
 CASE WHEN is_open THEN CASE WHEN {num('b')} > 12 OR ({num('a')} <= 12 AND date_order = 'mdy') THEN {num('b')} ELSE {num('a')} END ELSE {num('d')} END AS dd,
 CASE WHEN half = '' THEN {num('h')} WHEN {num('h')} BETWEEN 1 AND 12 THEN {num('h')} % 12 + CASE WHEN lower(half) = 'pm' THEN 12 ELSE 0 END END AS hh, {num('mi')} AS mn, coalesce({num('s')}, 0) AS ss, coalesce({num("nullif(rpad(f[:6], 6, '0'), '000000')")}, 0) AS us FROM i2),
i4 AS (SELECT *, CASE WHEN hh <= 23 AND mn <= 59 AND ss <= 59 THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', yy, mm, dd, hh, mn, ss) AS TIMESTAMP) + to_microseconds(us) END AS wall,
 CASE WHEN zone[1] IN ('+', '-') THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * ({num('zone[2:3]')} * 60 + coalesce({num("right(replace(zone, ':', '')[4:], 2)")}, 0)) ELSE CASE upper(zone) {known} END END AS off,
 CASE WHEN region <> '' THEN region[2:-2] ELSE zone_name END AS zn,
 CASE WHEN regexp_matches(x, '^[0-9]{{1,20}}([.][0-9]{{1,12}})?([eE][+]?[0-9]{{1,2}})?$') THEN TRY_CAST(x AS DECIMAL(38,6)) END AS n FROM i3),
i5 AS (SELECT *, timezone(zn, wall - INTERVAL 1 DAY) + INTERVAL 1 DAY AS before, timezone(zn, wall + INTERVAL 1 DAY) - INTERVAL 1 DAY AS after FROM i4 WHERE zone = '' AND wall IS NOT NULL AND zn IN (SELECT name FROM pg_timezone_names())),
i6 AS (SELECT * EXCLUDE (before, after), epoch_us(CASE WHEN timezone(zn, before) = wall THEN before WHEN timezone(zn, after) = wall THEN after ELSE before END) AS at_us FROM i5
 UNION ALL SELECT *, CASE WHEN zone <> '' AND wall IS NOT NULL THEN epoch_us(wall) - CAST(off AS BIGINT) * 60000000 WHEN n BETWEEN 1136073600 AND 1798761599.999999 THEN CAST(n * 1000000 AS BIGINT) WHEN n BETWEEN 1136073600000 AND 1798761599999.999 THEN CAST(floor(n * 1000) AS BIGINT) WHEN n BETWEEN 1136073600000000 AND 1798761599999999 THEN CAST(floor(n) AS BIGINT) END
 FROM i4 WHERE NOT coalesce(zone = '' AND wall IS NOT NULL AND zn IN (SELECT name FROM pg_timezone_names()), false)),
resolved AS (SELECT *, CAST(floor(at_us / 1000.0) AS BIGINT) AS ms FROM i6)"""


POSTS = f"""timed AS (SELECT i.*, created_at AS v, zone_name, date_order FROM ingress i LEFT JOIN feeds USING (feed_id)),
{instants('timed')},
keyed AS (SELECT *, {canon('id')} AS post_id, CASE WHEN ms BETWEEN 1136073600000 AND 1798761599999 THEN ms END AS created_ms FROM resolved),
posts AS (
  SELECT post_id, ingress_seq, {canon('author_id')} AS author_id, text, created_ms, epoch_ms(received_at) AS received_ms,
    coalesce(metrics.likes, 0) AS likes, coalesce(metrics.replies, 0) AS replies, coalesce(metrics.retweets, 0) AS retweets,
    coalesce(metrics.quotes, 0) AS quotes, metrics_at, coalesce(media[1].type, 'none') AS media_type, lower(lang) AS lang,
    {canon('quoted_tweet_id')} AS quoted_id, {canon('retweet_of_tweet_id')} AS retweet_of_id, {canon('in_reply_to_tweet_id')} AS reply_to_id
  FROM keyed WHERE post_id IS NOT NULL AND trim(text, ' ') <> '' AND created_ms > {FIRST_MS} AND created_ms <= {NOW + AHEAD_MS} AND metrics_at > {FIRST_MS} AND metrics_at <= {NOW + AHEAD_MS}
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY ingress_seq) = 1)"""

_first = "substr(p, 1, 1)"
_rest = "replace(substr(p, 2), '’', '''')"
EXPAND = f"""CASE WHEN {_first} IN ('#', '@', '$') THEN
    CASE WHEN {_first} = '$' AND regexp_full_match({_rest}, '\\p{{N}}+') THEN [{_rest}] ELSE [{_first} || {_rest}, {_rest}] END
  WHEN regexp_matches({_first}, '[{X.CJK}]') THEN CASE WHEN length(p) = 1 THEN [p] ELSE list_transform(range(1, length(p)), lambda i: substr(p, i, 2)) END
  WHEN regexp_matches({_first}, '[{X.PICTURES}]') THEN list_filter(string_split(p, ''), lambda x, i: list_position(string_split(p, ''), x) = i)
  ELSE [replace(p, '’', '''')] END"""


def tokens(text: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(regexp_replace(lower({text}), {q(X.LINK)}, ' ', 'g'), {q('(' + X.PIECE + ')')}, 1), lambda p: {EXPAND}))"


STOP = "[" + ", ".join(q(s) for s in lexicons.stopwords()) + "]"
TOKENS = f"""{POSTS},
tok0 AS (SELECT *, {tokens('text')} AS tokens_all FROM posts),
tok AS (SELECT *, list_filter(tokens_all, lambda t: NOT list_contains({STOP}, t)) AS tokens FROM tok0)"""

PAIRS = "list_filter(list_transform(range(1, len(tokens)), lambda i: CASE WHEN NOT starts_with(tokens[i], '~') AND NOT starts_with(tokens[i + 1], '~') THEN chr(2) || tokens[i] || chr(2) || tokens[i + 1] END), lambda x: x IS NOT NULL)"


def aspects(lexicon: dict | None = None) -> str:
    parts = []
    for name, patterns in (lexicon or lexicons.aspects()).items():
        def hit(ps: list[str]) -> str:
            tests = []
            if one := [p for p in ps if " " not in p]:
                tests.append(f"list_has_any(tokens, [{', '.join(map(q, one))}])")
            tests += [f"contains(' ' || array_to_string(tokens, ' ') || ' ', {q(f' {p} ')})" for p in ps if " " in p]
            return "(" + " OR ".join(tests or ["false"]) + ")"

        weak = "[" + ", ".join(map(q, patterns["weak"])) + "]"
        test = f"{hit(patterns['strong'])} OR ({hit(patterns['weak'])} AND len(list_filter(tokens, lambda t: NOT starts_with(t, '~') AND NOT list_contains({weak}, t))) > 0)"
        if name == "~price":
            test += " OR regexp_matches(text, '\\$[0-9]')"
        parts.append(f"CASE WHEN {test} THEN {q(name)} END")
    return f"list_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"


ANALYSED = f"""{TOKENS},
ana AS (SELECT *, {PAIRS} AS pairs, {aspects()} AS aspects FROM tok)"""

ENGAGEMENT = "ln(1 + likes + 2 * replies + 3 * retweets + 4 * quotes)"
RECENCY = "greatest(0.0, least((created_ms - 1735689600000) / 86400000.0, 730.0)) / 30"


def bucket(score: str) -> str:
    return f"CAST(floor(255 * ln(1 + least(greatest({score}, 0.0), 42.0)) / ln(43.0)) AS INTEGER)"


POSTINGS = f"""{ANALYSED},
listed AS (
  SELECT post_id, unnest(list_concat(tokens, pairs)) AS term, 1 AS n FROM ana UNION ALL SELECT post_id, unnest(aspects), 0 FROM ana),
term_tf AS (SELECT post_id, term, CAST(greatest(sum(n), 1) AS BIGINT) AS tf FROM listed GROUP BY ALL),
postings AS (
  SELECT term_tf.*, author_id, created_ms, media_type, likes, lang, {bucket(f'{ENGAGEMENT} + {RECENCY}')} AS bucket FROM term_tf JOIN posts USING (post_id)),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

AUTHORS = f"""latest_authors AS (
  SELECT {canon('id')} AS author_id, lower(regexp_replace(trim(handle, ' '), '^@', '')) AS handle, display_name, follower_count, verified, received_at
  FROM authors WHERE {canon('id')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {canon('id')} ORDER BY received_at DESC NULLS LAST, author_seq) = 1)"""
