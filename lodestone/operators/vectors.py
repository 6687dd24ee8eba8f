"""Vector records: upsert, look-up and exact nearest neighbours of given queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.functions.vectors import LEAST_RANGE
from lodestone.session import ship

QUERY_BLOCK = 8192


def latest(records: DataFrame) -> DataFrame:
    """One record for each unit_id, the last written."""
    columns = [c for c in records.columns if c not in ("unit_id", "written_at")]
    last = records.groupBy("unit_id").agg(F.max(F.struct("written_at", *columns)).alias("r"))
    return last.select("unit_id", *[F.col(f"r.{c}").alias(c) for c in [*columns, "written_at"]])


def to_records(vectors: DataFrame, vector: str = "vector", dim: int | None = None) -> DataFrame:
    """(unit_id, vector) to quantized records; a vector of another length than ``dim`` is an error."""
    q = vx.quantize(F.col(vector))
    rows = vectors.select("unit_id", F.size(vector).alias("dim"), q.alias("q"))
    if dim is not None:
        rows = rows.withColumn("dim", F.when(F.col("dim") == dim, F.col("dim")).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.col("dim").cast("string"))).cast("int")))
    return rows.select("unit_id", "dim", F.col("q.v_min").cast("float").alias("v_min"), F.col("q.v_max").cast("float").alias("v_max"), F.col("q.data").alias("data"))


def upsert(records: DataFrame, new: DataFrame) -> DataFrame:
    """``records`` with those of ``new`` in place of their unit_ids'."""
    return records.join(new.select("unit_id").distinct(), "unit_id", "left_anti").unionByName(new)


def decoded(records: DataFrame) -> DataFrame:
    """(unit_id, vector) of usable records."""
    whole = records.where((F.size("data") == F.col("dim")) & F.col("v_min").isNotNull() & F.col("v_max").isNotNull())
    return whole.select("unit_id", vx.dequantize(F.col("data"), F.col("v_min"), F.col("v_max")).alias("vector"))


def vector_of(records: DataFrame, unit_id: int) -> DataFrame:
    return decoded(records.where(F.col("unit_id") == unit_id))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and decoded vectors of a batch of (unit_id, v_min, v_max, data) with one dimension."""
    n = batch.num_rows
    raw = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    low = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
    high = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
    return batch.column(0).to_numpy(zero_copy_only=False), low + raw / 255.0 * (high - low)


def _whole(records: DataFrame, dim: int) -> DataFrame:
    usable = (F.col("dim") == dim) & (F.size("data") == dim) & F.col("v_min").isNotNull() & F.col("v_max").isNotNull() & F.col("unit_id").isNotNull() & ~F.exists("data", lambda x: x.isNull())
    return records.where(usable).select("unit_id", "v_min", "v_max", "data")


def _cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    lengths = np.maximum(np.linalg.norm(vectors, axis=1), LEAST_RANGE)
    return queries @ vectors.T / (np.linalg.norm(queries, axis=1)[:, None] * lengths[None, :])


def similarities(records: DataFrame, query: list[float]) -> DataFrame:
    """(id, similarity) of all records with the query's dimension. A query without length gives no rows."""
    ship(records.sparkSession)
    q = np.array([query], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, vectors = _matrix(batch)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_cosines(q, vectors)[0])], names=["id", "similarity"])

    rows = _whole(records, len(query))
    if np.linalg.norm(q) < LEAST_RANGE:
        rows = rows.where("false")
    return rows.mapInArrow(run, "id bigint, similarity double")


def nearest_to(records: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, similarity) of the k nearest, ties by id. A top-k without a full sort."""
    return similarities(records, query).orderBy(F.round("similarity", 9).desc(), "id").limit(k)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, column) of the k best of each query, ties by id; ``ids`` ascend."""
    keys = -np.round(sims, 9)
    if keys.shape[1] > k:
        rows, columns = np.nonzero(keys <= np.partition(keys, k - 1, axis=1)[:, k - 1 : k])
    else:
        rows, columns = (x.ravel() for x in np.indices(keys.shape))
    order = np.lexsort((ids[columns], keys[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    at = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[at < k], columns[at < k]


def _first(rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, ties by id."""
    order = np.lexsort((ids, -np.round(sims, 9), rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], ids[kept], sims[kept]


def nearest_to_many(records: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank) for a stated set of queries (query_id, vector) against all records.

    Queries go to the records in blocks of about ``block``, so what is sent is bounded; each
    partition of records keeps its k best of each query before the shuffle.
    """
    ship(records.sparkSession)
    n_blocks = max(1, math.ceil(queries.count() / block))
    parts = []
    for b in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).select("query_id", "vector").toArrow()
        sizes = {len(v) for v in own.column("vector").to_pylist() if v}
        for dim in sorted(sizes):
            table = own.filter(pc.equal(pc.list_value_length(own.column("vector")), dim))
            names = table.column("query_id").to_numpy()
            matrix = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            long = np.linalg.norm(matrix, axis=1) >= LEAST_RANGE
            sent = records.sparkSession.sparkContext.broadcast((names[long], matrix[long]))

            def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
                names, matrix = sent.value
                best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                for batch in batches:
                    if not batch.num_rows or not len(names):
                        continue
                    ids, vectors = _matrix(batch)
                    order = np.argsort(ids, kind="stable")
                    ids, vectors = ids[order], vectors[order]
                    for a in range(0, len(names), 256):
                        sims = _cosines(matrix[a : a + 256], vectors)
                        rows, columns = _best(sims, ids, k)
                        found = (rows, ids[columns], sims[rows, columns])
                        best[a] = _first(*(np.concatenate(x) for x in zip(best[a], found)), k) if a in best else found
                for a, (rows, i, s) in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array(names[a + rows]), pa.array(i), pa.array(s)], names=["query_id", "id", "similarity"])

            parts.append(_whole(records, dim).mapInArrow(run, "query_id bigint, id bigint, similarity double"))
    if not parts:
        return records.select(F.lit(0).cast("bigint").alias("query_id"), F.col("unit_id").alias("id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).where("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id"))).where(F.col("rank") <= k)
