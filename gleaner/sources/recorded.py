"""Recorded responses as a Python data source, with partitions and pushed filters.

record() has Spark write responses as JSON lines in one folder for each bucket of place ids, in the folder that driver and executors share.
The data source makes a partition of each file; a filter on place_id is pushed into it, so that only its bucket's files
are opened, and only its lines are parsed.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from gleaner.sources.scratch import shared_dir

BUCKETS = 32
NAME = "gleaner_recorded"


def record(responses: DataFrame, place_id: str = "place_id", buckets: int = BUCKETS) -> str:
    """Writes responses (a place_id, and any columns) and returns the folder. Rows without a place_id are left out."""
    path = f"{shared_dir(responses.sparkSession)}/gleaner/recorded-{uuid.uuid4().hex}"
    rows = responses.where(F.col(place_id).isNotNull())
    lines = rows.select(F.pmod(F.crc32(F.col(place_id).cast("binary")), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(*responses.columns)).alias("value"))
    lines.repartition("bucket").write.partitionBy("bucket").text(path)
    return path


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.buckets = int(options.get("buckets", BUCKETS))
        self.fields = fields
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = {f.value} if isinstance(f, EqualTo) and f.attribute == ("place_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("place_id",) else None
            if isinstance(f, IsNotNull) and f.attribute == ("place_id",):
                continue  # each line has one
            if own is None:
                yield f
            else:
                self.wanted = own if self.wanted is None else self.wanted & own

    def partitions(self) -> list[_File]:
        buckets = range(self.buckets) if self.wanted is None else sorted({zlib.crc32(w.encode()) % self.buckets for w in self.wanted})
        folders = [f"{self.folder}/bucket={b}" for b in buckets]
        return [_File(f"{d}/{name}") for d in folders if os.path.isdir(d) for name in sorted(os.listdir(d)) if not name.startswith((".", "_"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.value:
            return
        with open(partition.value, encoding="utf-8") as lines:
            for line in lines:
                # Most lines of a bucket are told by their text; the parsed id decides.
                if self.wanted is not None and not any(json.dumps(w, ensure_ascii=False)[1:-1] in line for w in self.wanted):
                    continue
                row = json.loads(line)
                if self.wanted is None or row.get("place_id") in self.wanted:
                    yield tuple(row[f] if f == "place_id" else json.dumps(row[f], ensure_ascii=False, separators=(",", ":")) if f in row else None for f in self.fields)


class Recorded(DataSource):
    """Options: path, and buckets as recorded. Schema: place_id, and the JSON of each other field that is named."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "place_id string, result string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema.fieldNames())


def read(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """place_id and result (JSON) of recorded responses."""
    spark.dataSource.register(Recorded)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("buckets", str(buckets)).load(path)
