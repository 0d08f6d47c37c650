"""Readers and writers of the ingest side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plover.operators.ingest import decode_ingress, decode_loose
from plover.operators.prefix import prefix_sums


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """line, source_file of all JSON lines under a folder."""
    return spark.read.text(folder, recursiveFileLookup=True).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"))


def split(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) of rows that carry a ``reason``."""
    return decoded.filter(F.col("reason").isNull()), decoded.filter(F.col("reason").isNotNull())


def read_ingress(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(posts, authors, quarantined) of strict JSON lines."""
    valid, bad = split(decode_ingress(read_lines(spark, folder)))
    of = lambda kind: valid.filter(F.col("r.kind") == kind).select("source_file", "r.*")
    return of("tweet"), of("author"), bad.select("reason", "line", "source_file")


def read_loose(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(posts, quarantined) of tolerant JSON lines. Lines of the strict contract among them are read by ``read_ingress``."""
    valid, bad = split(decode_loose(read_lines(spark, folder), "line"))
    return valid.drop("reason"), bad.filter("reason <> 'strict'").select("reason", "line", "source_file")


def write_quarantine(bad: DataFrame, path: str) -> None:
    """Refused lines with their reason, as JSON, a folder per reason."""
    bad.write.mode("append").partitionBy("reason").json(path)


def write_batch(rows: DataFrame, path: str) -> None:
    """A prepared batch; an existing one is never overwritten."""
    rows.write.mode("errorifexists").parquet(path)


def archive_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_archive(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem: files that are missing, changed or unknown."""
    both = manifest.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") != F.col("have"), "changed")
    return both.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("path", "problem")


def config_hash(*parts: bytes) -> str:
    """Identity of an index configuration: FNV-1a over its parts; appending under another one is refused by the caller."""
    from plover.plans.ir import fnv1a64

    return fnv1a64(b for part in parts for b in part)


def check_config(meta: DataFrame, wanted: str) -> None:
    row = meta.select("config_hash").first()
    if row is not None and row[0] != wanted:
        raise ValueError(f"the index was built with configuration {row[0]}, not {wanted}")


# ---- batches on disk
def stage_batches(rows: DataFrame, folder: str, per_batch: int) -> int:
    """Prepared posts as numbered folders of at most ``per_batch`` rows, in order of ``ingress_seq``; an existing folder is never
    overwritten. The number of batches."""
    placed = prefix_sums(rows.withColumns({"_all": F.lit(1), "_one": F.lit(1)}), ["_all"], ["ingress_seq"], "_one")
    numbered = placed.withColumn("batch", F.expr(f"before div {per_batch}")).drop("_all", "_one", "before")
    numbered.write.mode("errorifexists").partitionBy("batch").parquet(folder)
    return numbered.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] + 1


def replay_batches(spark: SparkSession, folder: str, engine) -> list[dict[str, int]]:
    """Staged batches into an engine, one after the other; replaying changes nothing."""
    staged = spark.read.parquet(folder)
    numbers = sorted(r[0] for r in staged.select("batch").distinct().collect())  # one per batch
    return [engine.ingest(staged.filter(F.col("batch") == n).drop("batch")) for n in numbers]


def batch_hash(spark: SparkSession, folder: str) -> str:
    """Identity of a staged folder: the digest of its files' names and digests."""
    files = archive_manifest(spark, folder).filter(F.col("path").endswith(".parquet"))
    named = files.select(F.concat_ws(":", F.regexp_extract("path", "([^/]+/[^/]+)$", 1), "sha256").alias("line"))
    return named.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).first()[0]  # a line per file


def acknowledge(spark: SparkSession, folder: str, expected: str, quarantined: DataFrame) -> None:
    """Accept an attempt: it must be about this very batch, and nothing may wait in quarantine."""
    if (found := batch_hash(spark, folder)) != expected:
        raise ValueError(f"the attempt is about batch {expected}, not {found}")
    if quarantined.take(1):
        raise ValueError("rows wait in quarantine")
    spark.createDataFrame([(expected,)], "batch_hash string").coalesce(1).write.mode("overwrite").json(f"{folder}/_acknowledged")


def replace_documents(stored: DataFrame, arriving: DataFrame, key: str, seq: str) -> DataFrame:
    """``stored`` with the arriving rows in place of those of the same key; of several arriving ones the last counts."""
    last = arriving.groupBy(key).agg(F.max_by(F.struct(*arriving.columns), seq).alias("r")).select("r.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last.select(stored.columns))
