"""Inverted-file index over vectors: centroids, cells, and search in the nearest cells.

Centroids are fitted on a bounded sample (FIT_ROWS rows), every row gets its cell. A query
looks into the ``probes`` nearest cells only. The centroids, at most a few thousand, are the
only thing sent to executors besides blocks of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.vectors import QUERY_BLOCK, _best, _cosines
from lodestone.session import ship

FIT_ROWS = 50_000
MAX_CELLS = 4096
ROUNDS = 12
SEED = 11


def _rows(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _sample(vectors: DataFrame, n: int) -> pa.Table:
    """The FIT_ROWS of ``n`` rows with the smallest hashes of their ids."""
    share = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < F.lit(min(1 << 20, math.ceil(1.2 * FIT_ROWS / max(1, n) * (1 << 20))))
    return vectors.where(share).select("id", "vector").orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(FIT_ROWS).toArrow()


def probes_for(vectors: DataFrame, centres: np.ndarray, k: int = 10, recall: float = 0.95, trials: int = 200) -> int:
    """Fewest probes that find a share ``recall`` of the k nearest, as measured by brute force with ``trials`` rows of the sample against all of it.

    In the whole table neighbours are nearer than in a sample of it, so there the share is no smaller.
    """
    sample = _sample(vectors, vectors.count())
    if not sample.num_rows or not len(centres):
        return 1
    data = _unit(_rows(sample.column("vector")))
    own = (data @ centres.T).argmax(axis=1)
    asked = data[:trials]
    sims = asked @ data.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-sims, axis=1)[:, : min(k, max(1, len(data) - 1))]
    # the place of each neighbour's cell among the nearest cells of its query
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def fit_centroids(vectors: DataFrame, cells: int | None = None) -> np.ndarray:
    """Centroids of unit vectors by k-means on the FIT_ROWS rows with the smallest hashes of their ids."""
    n = vectors.count()
    sample = _sample(vectors, n)
    if not sample.num_rows:
        return np.zeros((0, 0))
    data = _unit(_rows(sample.column("vector")))
    k = min(len(data), MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    pick = np.random.default_rng(SEED)
    centres = data[pick.choice(len(data), k, replace=False)]
    for _ in range(ROUNDS):
        own = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        filled = np.bincount(own, minlength=k) > 0
        centres = np.where(filled[:, None], _unit(sums), centres)
    return centres


def with_cells(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(id, vector, cell): each row once for each of its ``probes`` nearest cells."""
    ship(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = dict(vectors.dtypes)["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            sims = _unit(_rows(batch.column(1))) @ own.T
            take = min(probes, len(own))
            cells = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            at = pa.array(np.repeat(np.arange(batch.num_rows), take))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells.ravel().astype(np.int32))], names=["id", "vector", "cell"])

    return vectors.select("id", "vector").mapInArrow(run, f"id bigint, vector {kind}, cell int")


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 10) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of each query in its nearest cells.

    Cells meet as groups: the rows of a cell and the queries that probe it. A large cell is cut
    into parts by id, each of which gets the cell's queries, and many queries of a cell into
    slices, each of which gets the cell's rows, so no task holds a whole hot cell or all of its queries.
    """
    slices = max(1, math.ceil(queries.count() * min(probes, max(1, len(centres))) / max(1, len(centres)) / QUERY_BLOCK))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(FIT_ROWS)).cast("int").alias("parts"))
    rows = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = with_cells(queries.select(F.col("query_id").alias("id"), "vector"), centres, probes).join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        ids = left.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], _rows(left.column("vector"))[order]
        names, wanted = right.column("id").to_numpy(), _rows(right.column("vector"))
        out: list[list[np.ndarray]] = [[], [], []]
        for a in range(0, len(names), 256):
            sims = _cosines(wanted[a : a + 256], vectors)
            q, c = _best(sims, ids, k)
            for column, values in zip(out, (names[a + q], ids[c], sims[q, c])):
                column.append(values)
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in zip(("query_id", "id", "similarity"), out)})

    found = rows.select("id", "vector", "cell", "part", "slice").groupBy("cell", "part", "slice").cogroup(asked.select("id", "vector", "cell", "part", "slice").groupBy("cell", "part", "slice")).applyInArrow(run, "query_id bigint, id bigint, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
