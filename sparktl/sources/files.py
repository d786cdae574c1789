"""A Spark data source for Arrow IPC files on a file system that pyarrow can open."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


@dataclass
class Batch(InputPartition):
    number: int


class ArrowSource(DataSource):
    """One partition for each record batch of the file."""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def schema(self):
        place, path = opened(self.options["path"])
        with place.open_input_file(path) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema) -> DataSourceReader:
        return ArrowReader(self.options["path"])


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Batch]:
        place, path = opened(self.path)
        with place.open_input_file(path) as f:
            return [Batch(k) for k in range(max(1, pa.ipc.open_file(f).num_record_batches))]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        place, path = opened(self.path)
        with place.open_input_file(path) as f:
            file = pa.ipc.open_file(f)
            if partition.number < file.num_record_batches:
                yield file.get_batch(partition.number)
