"""Session helpers: shared working folder, materialised intermediate tables, size checks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "plover", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; an existing one is reused as it is."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="plover-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage is cut, losing an executor loses nothing.

    The table lives until the application ends, or until ``discard`` or ``clean_up``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, target = _file(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark.sparkContext.applicationId
    out._materialized_at = path
    return out


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``materialize`` that nothing will read any more (a round's, once the next is written)."""
    path = getattr(df, "_materialized_at", None)
    if path in _written:
        system, target = _file(df.sparkSession, path)
        system.delete(target, True)
        del _written[path]


def clean_up(spark: SparkSession) -> int:
    """Delete all tables this application has materialised; for long sessions, between pieces of work. How many there were."""
    mine = [path for path, app in _written.items() if app == spark.sparkContext.applicationId]
    for path in mine:
        system, target = _file(spark, path)
        system.delete(target, True)
        del _written[path]
    return len(mine)


_written: dict[str, str] = {}


def spread(spark: SparkSession) -> int:
    """Partitions for work that is heavy per byte: as many as the session shuffles into, at least one a core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, unless it is installed there (``plover.installed=true``)."""
    global _shipped
    app = spark.sparkContext.applicationId
    if _shipped == app or spark.conf.get("plover.installed", "false") == "true":
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="plover-")) / "plover_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".json") and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped = app


_shipped = ""
