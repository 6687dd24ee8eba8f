"""Vectors in one packed binary file: a header, then one fixed-size record a vector.

Fixed values of the format, little-endian: magic ``CVEC``, version 1 (u32), dimension (u32),
number of records (u64); per record unit_id (i64), v_min and v_max (f32), one byte an element.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, VERSION = b"CVEC", 1
HEADER = struct.Struct("<4sIIQ")
RECORDS_PER_PART = 1 << 20
SCHEMA = "unit_id bigint, dim int, v_min float, v_max float, data array<smallint>"


def record_type(dim: int) -> np.dtype:
    return np.dtype([("unit_id", "<i8"), ("v_min", "<f4"), ("v_max", "<f4"), ("data", "u1", (dim,))])


def read_header(path: str) -> tuple[int, int]:
    """Dimension and number of records; a broken file is an error."""
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
    if len(head) < HEADER.size:
        raise ValueError(f"{path}: too short for a header")
    magic, version, dim, n = HEADER.unpack(head)
    if magic != MAGIC:
        raise ValueError(f"{path}: not a vector file")
    if version != VERSION:
        raise ValueError(f"{path}: version {version}")
    if os.path.getsize(path) < HEADER.size + n * record_type(dim).itemsize:
        raise ValueError(f"{path}: truncated")
    return dim, n


class Part(InputPartition):
    def __init__(self, begin: int, count: int) -> None:
        self.begin, self.count = begin, count


class VectorReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        _, n = read_header(self.path)
        return [Part(a, min(RECORDS_PER_PART, n - a)) for a in range(0, n, RECORDS_PER_PART)] or [Part(0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        dim, _ = read_header(self.path)
        kind = record_type(dim)
        with open(self.path, "rb") as f:
            f.seek(HEADER.size + partition.begin * kind.itemsize)
            left = partition.count
            while left:
                rows = np.frombuffer(f.read(min(left, 8192) * kind.itemsize), kind)
                left -= len(rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(rows["data"].reshape(-1).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(rows["unit_id"]), pa.array(np.full(len(rows), dim, np.int32)), pa.array(rows["v_min"]), pa.array(rows["v_max"]), lists], names=["unit_id", "dim", "v_min", "v_max", "data"])


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_file"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return VectorReader(self.options["path"])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(VectorFile)
    return spark.read.format("vector_file").load(path)


def write_vectors(records: DataFrame, path: str) -> int:
    """Streams records to one file, made whole by a rename, and a zstd copy; for exchange, not for scale. Returns their number.

    Rows come to the driver partition by partition. The engine's own store is Parquet.
    """
    first = records.select("dim").first()
    dim = first["dim"] if first else 0
    kind, n = record_type(dim), 0
    draft = f"{path}.tmp"
    with open(draft, "wb") as f:
        f.write(HEADER.pack(MAGIC, VERSION, dim, 0))
        for row in records.toLocalIterator():
            if row["dim"] != dim or len(row["data"]) != dim:
                raise ValueError(f"unit {row['unit_id']}: expected {dim} dimensions")
            record = np.zeros(1, kind)
            record["unit_id"], record["v_min"], record["v_max"], record["data"] = row["unit_id"], row["v_min"], row["v_max"], row["data"]
            f.write(record.tobytes())
            n += 1
        f.seek(0)
        f.write(HEADER.pack(MAGIC, VERSION, dim, n))
    os.replace(draft, path)
    with open(path, "rb") as source, open(f"{path}.zst", "wb") as target:
        zstandard.ZstdCompressor(level=3).copy_stream(source, target)
    return n
