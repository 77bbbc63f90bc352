"""Recorded responses of search services as a data source: ``spark.read.format("recorded_responses").load(folder)``.

A folder holds one file of JSON lines for each provider (``<provider>.jsonl``), each line with query_id, limit and
payload (the response as a string). Option ``limit`` cuts nothing: it keeps the responses asked for with that limit.
Each file is a partition; lines that are no JSON become rows with an error instead of failing the scan.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "provider string, query_id string, asked int, payload string, error string"
_FIELDS = pa.schema([("provider", pa.string()), ("query_id", pa.string()), ("asked", pa.int32()), ("payload", pa.string()), ("error", pa.string())])
_BATCH = 4096


class RecordedResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.asked = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.folder)) if name.endswith(".jsonl")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        provider = partition.value.removesuffix(".jsonl")
        rows: list[dict] = []
        with open(os.path.join(self.folder, partition.value), encoding="utf-8") as lines:
            for line in lines:
                try:
                    entry = json.loads(line)
                    row = {"query_id": entry["query_id"], "asked": entry.get("limit"), "payload": entry.get("payload"), "error": None}
                except (ValueError, KeyError, TypeError) as error:
                    row = {"query_id": None, "asked": None, "payload": None, "error": type(error).__name__}
                if self.asked is None or row["error"] or row["asked"] == self.asked:
                    rows.append({"provider": provider} | row)
                if len(rows) == _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedResponses)
