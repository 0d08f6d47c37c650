"""Provider timeline pages: a fixture-backed data source; ``operators.normalize`` maps its rows to posts.

There is no network client here: ``PageSource`` reads saved pages (JSON files), one partition per file, and stands where
a live reader would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "account string, page int, received_at long, raw_file string, position int, row string"


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = json.loads(Path(partition.value).read_text("utf-8"))
        for i, row in enumerate(page["results"]):
            yield page["accountUserId"], int(page["page"]), int(page["receivedAt"]), partition.value, i, json.dumps(row, ensure_ascii=False)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timeline_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format("timeline_pages").load(folder)
