"""Queries of the problems for training data, over the project's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.functions.ids import canonical_id
from plover.llm import fusion, leaks, mixing, ranking, spans
from plover.runtime import materialize
from plover.sources.tables import table

#: 2006-01-01 and 2026-10-01, in milliseconds: readings outside are impossible.
FIRST_READING = 1136073600000
LAST_READING = 1790812800000


# ---- p1
def _records(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ingress as claims. Their source is the channel they came by, told by ``duplicates``: unlisted, or timeline or
    embedded on the author's own or another account's pages. A reading is a claim only if it can be one at all: it has
    likes and a possible time, and no report says that it refreshed nothing."""
    told = (
        table(spark, d, "duplicates")
        .filter(F.col("again_seq").isNotNull())
        .groupBy(F.col("again_seq").alias("seq"))
        .agg(F.bool_or(~F.col("metrics_refreshed")).alias("stale"), F.min("again.origin").alias("origin"), F.min(canonical_id("again.account_user_id")).alias("account"))
    )
    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = table(spark, d, "ingress").select(
        F.col("ingress_seq").alias("seq"),
        canonical_id("id").alias("object"),
        F.when(F.col("metrics.likes").isNotNull() & (F.col("metrics_at") > FIRST_READING) & (F.col("metrics_at") <= LAST_READING), F.col("metrics_at")).alias("reading"),
        F.coalesce(F.length(trimmed), F.lit(0)).cast("long").alias("text"),
        canonical_id("author_id").alias("author"),
        F.lower("lang").alias("lang"),
    )
    own = F.when(F.col("account") == F.col("author"), "own").otherwise("other")
    source = F.when(F.col("account").isNull() & F.col("origin").isNull(), "unlisted").otherwise(F.concat_ws("/", "origin", own))
    told = told.withColumnRenamed("seq", "told_seq")
    return rows.join(told, F.col("seq") == F.col("told_seq"), "left").select(
        "seq", "object", source.alias("source"), F.when(~F.coalesce("stale", F.lit(False)), F.col("reading")).alias("metrics"), "text", "author", "lang"
    )


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_records(spark, d), ["metrics", "text"], ["author", "lang"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select(F.col("object").alias("tweet_id"), "metrics_seq", "text_seq")


def p1_representatives(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each duplicate group, field by field, with the posterior of each."""
    fused = materialize(_fused(spark, d), "fused")
    raw = table(spark, d, "ingress").select(F.col("ingress_seq").alias("seq"), "metrics", "metrics_at", "text", canonical_id("author_id").alias("author"), F.lower("lang").alias("lang"))
    wanted = fused.select("object", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_seq").alias("seq")) for f in ("metrics", "text", "author", "lang")])).alias("w"))
    of = lambda field, value: F.max(F.when(F.col("field") == field, F.col(value))).alias(value.split(".")[-1])
    parts = (
        wanted.select("object", "w.field", "w.seq")
        .join(raw, "seq")
        .groupBy("object")
        .agg(of("metrics", "metrics.likes"), of("metrics", "metrics.retweets"), of("metrics", "metrics_at"), of("text", "text"), of("author", "author"), of("lang", "lang"))
    )
    odds = [F.round(f"{f}_p", 6).alias(f"{f}_p") for f in ("metrics", "text", "author", "lang")]
    return fused.join(parts, "object", "left").select(F.col("object").alias("tweet_id"), "n", "likes", "retweets", "metrics_at", "text", F.col("author").alias("author_id"), "lang", *odds)


# ---- p5
SCORES = {"like_count": 1, "author_authority": 1, "feedback_votes": 1, "created_at": 1}


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    fused, _ = ranking.fuse_ranks(table(spark, d, "candidates").select("query_key", "candidate_id", "cand_seq", *SCORES), "query_key", "candidate_id", "cand_seq", SCORES)
    return fused


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_of_groups(_ranked(spark, d), 5).select(F.col("grp").alias("query_key"), F.col("item").alias("candidate_id"))


def p5_projection(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select(F.col("grp").alias("query_key"), F.col("item").alias("candidate_id"), *[F.round(f"r_{s}", 6).alias(f"r_{s}") for s in SCORES], F.round("projection", 6).alias("projection"))


# ---- p8
def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_hits").alias("longest_hits"))


# ---- p9
def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].filter("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].select("source", "target_share", "max_repeats", "source_tokens", "wanted_tokens", "drawn_slots", "filled_slots", "mixed_tokens", "actual_share", "reached", "short")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: which parts of which documents fill each slot of each output shard, in their order (at)."""
    return _mix(spark, d)[0].select("shard", "source", "slot", "repeat", "block", F.inline("parts"))


# ---- p10
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.linked_pairs(table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_classes(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_representatives, p5_found, p5_projection, p8_found, p8_items, p9_found, p9_report, p9_mix, p10_found, p10_classes, p10_shares)}

#: White space at either end, as Unicode has it.
_TRIM = r"'^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$'"
_RANK = ", ".join(
    f"rank() OVER (PARTITION BY query_key ORDER BY {c}) + (count(*) OVER (PARTITION BY query_key, {c}) - 1) / 2.0 AS r{i}" for i, c in enumerate(SCORES)
)
_CLEAN = ", ".join(f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN '-Infinity'::DOUBLE ELSE CAST({c} AS DOUBLE) END AS {c}" for c in SCORES)
_N = range(len(SCORES))
_MID = ", ".join(f"(rank() OVER (PARTITION BY query_key ORDER BY {c}) - 1 + count(*) OVER (PARTITION BY query_key, {c}) / 2.0) / count(*) OVER (PARTITION BY query_key) AS r{i}" for i, c in enumerate(SCORES))
_TIMES = ", ".join("(" + " + ".join(f"c{min(i, j)}{max(i, j)} * w{j}" for j in _N) + f") AS v{i}" for i in _N)
_LENGTH = "sqrt(" + " + ".join(f"v{i} * v{i}" for i in _N) + ")"
#: p8 has no twin (NFKC is missing there); p9_found's counts characters, as the answer doesn't depend on the tokenizer.
SQL: dict[str, str] = {
    "p1_found": f"""WITH k AS (SELECT *, nullif(ltrim(regexp_extract(id, '[0-9]+'), '0'), '') AS tweet_id, length(regexp_replace(coalesce(text, ''), {_TRIM}, '', 'g')) AS n FROM ingress),
bad AS (SELECT DISTINCT again_seq FROM duplicates WHERE metrics_refreshed = false AND again_seq IS NOT NULL),
m AS (SELECT tweet_id, ingress_seq FROM k WHERE metrics.likes IS NOT NULL AND metrics_at > {FIRST_READING} AND metrics_at <= {LAST_READING} AND ingress_seq NOT IN (SELECT again_seq FROM bad)
  QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY metrics_at DESC, ingress_seq) = 1),
t AS (SELECT tweet_id, ingress_seq, count(*) OVER (PARTITION BY tweet_id) AS c FROM k WHERE tweet_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY n DESC, ingress_seq) = 1)
SELECT tweet_id, m.ingress_seq AS metrics_seq, t.ingress_seq AS text_seq FROM t LEFT JOIN m USING (tweet_id) WHERE c > 1""",
    "p5_found": f"""WITH o AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY query_key, candidate_id ORDER BY cand_seq) = 1),
c AS (SELECT query_key, candidate_id, {_CLEAN} FROM o), r AS (SELECT query_key, candidate_id, {_RANK} FROM c)
SELECT query_key, candidate_id FROM r QUALIFY row_number() OVER (PARTITION BY query_key ORDER BY r0 + r1 + r2 + r3 DESC, candidate_id) <= 5""",
    "p5_projection": f"""WITH RECURSIVE o AS (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY query_key, candidate_id ORDER BY cand_seq) = 1),
c AS (SELECT query_key, candidate_id, {_CLEAN} FROM o), r AS (SELECT query_key, candidate_id, {_MID} FROM c), m AS (SELECT {', '.join(f'corr(r{i}, r{j}) AS c{i}{j}' for i in _N for j in _N if i <= j)} FROM r),
w AS (SELECT 0 AS k, {', '.join(f'{1 + i / 10}::DOUBLE AS w{i}' for i in _N)} UNION ALL SELECT k + 1, {', '.join(f'v{i} / {_LENGTH}' for i in _N)} FROM (SELECT k, {_TIMES} FROM w, m WHERE k < 1000))
SELECT query_key, candidate_id, {', '.join(f'round(r{i}, 6) AS r_{c}' for i, c in enumerate(SCORES))}, round({' + '.join(f'r{i} * abs(w{i})' for i in _N)}, 6) AS projection FROM r, w WHERE k = 1000""",
    "p10_classes": """WITH RECURSIVE w AS (SELECT doc_id, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
m AS (SELECT h, min(doc_id) AS owner FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), e AS (SELECT DISTINCT doc_id AS a, owner AS b FROM w JOIN m USING (h)), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, x.b FROM reach r JOIN ways x ON r.b = x.a), c AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_members FROM c""",
    "p9_found": """WITH s AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source)
SELECT source FROM mix_targets LEFT JOIN s USING (source) WHERE target_share * (SELECT sum(n) FROM s) > coalesce(n, 0) * max_repeats""",
    "p10_shares": """WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
m AS (SELECT h, min(doc_id) AS lo, max(doc_id) AS hi FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), v AS (SELECT doc_id, i, lo < doc_id AS later FROM w JOIN m USING (h)),
s AS (SELECT doc_id, sum(least(200, i - coalesce(p, i - 200))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM v) GROUP BY doc_id),
l AS (SELECT doc_id, sum(least(200, i - coalesce(p, i - 200))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM v WHERE later) GROUP BY doc_id)
SELECT doc_id, length(text) AS n_chars, CAST(s.n AS BIGINT) AS shared_chars, CAST(coalesce(l.n, 0) AS BIGINT) AS later_chars FROM documents JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "p10_found": """WITH c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE length(text) >= 200),
w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM c WHERE doc_id = rep)),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), v AS (SELECT w.* FROM w SEMI JOIN m USING (h))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM v a JOIN v b USING (h) WHERE a.doc_id < b.doc_id UNION ALL SELECT rep, doc_id FROM c WHERE doc_id > rep""",
}
