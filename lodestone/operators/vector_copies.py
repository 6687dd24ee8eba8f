"""Vectors that are nearly the same as another one: bands of random-hyperplane bits, exact cosines within a band's buckets.

Two vectors at a cosine share each bit with a known chance, so the number of bands follows from
the chance ``MISS`` of losing a pair at the threshold; the bits of a band grow with the logarithm
of the number of vectors, so buckets of unlike vectors stay small. Equal vectors are one class
before they meet. A bucket with more than ``CELL`` vectors, as of many alike, is laid out as a
grid of cells that compare two slices of it each, so no task holds a whole hot bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.vectors import _matrix, _whole
from lodestone.session import cut, ship

MISS = 1e-5
CELL = 2048
SEED = 31
LEAST_BITS, MOST_BITS = 8, 30

PAIRS = "unit_id bigint, copy_of bigint"


def bands_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, n)))))
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - shared)))


def near_copies(records: DataFrame, dim: int, threshold: float = 0.99) -> DataFrame:
    """(unit_id, copy_of): vectors with a smaller id at ``threshold`` or more, and the smallest such id.

    ``records`` has one row an id; those that are not whole, of another ``dim`` or all zero have no copies.
    """
    ship(records.sparkSession)
    span = F.col("v_max").cast("double") - F.col("v_min").cast("double")
    # a vector without length is like no other
    usable = _whole(records, dim).where(F.exists("data", lambda x: F.col("v_min").cast("double") + x / F.lit(255.0) * span != 0))
    keyed = cut(usable.withColumn("content", F.xxhash64("v_min", "v_max", "data")))
    firsts = keyed.groupBy("content", "v_min", "v_max", "data").agg(F.min("unit_id").alias("rep"))
    classes = cut(firsts.select(F.col("rep").alias("unit_id"), "v_min", "v_max", "data", "content"))
    n = classes.count()
    bits, bands = bands_for(n, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((dim, bits * bands))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, vectors = _matrix(batch)
            codes = ((vectors @ planes > 0).reshape(-1, bands, bits) * weights).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * bands), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["unit_id", "v_min", "v_max", "data", "codes"])

    coded = classes.select("unit_id", "v_min", "v_max", "data").mapInArrow(hashed, "unit_id bigint, v_min float, v_max float, data array<smallint>, codes array<bigint>")
    coded = cut(coded)
    places = coded.select("unit_id", F.posexplode("codes").alias("band", "code"))
    many = places.groupBy("band", "code").agg(F.count("*").alias("n")).where("n > 1").withColumn("cells", F.ceil(F.col("n") / F.lit(CELL)).cast("int"))
    own = F.pmod(F.xxhash64("unit_id"), F.col("cells")).cast("int")
    # a slice stands in the cells of its row and of its column
    sides = F.explode(F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda i: F.struct(F.least(own, i).alias("row"), F.greatest(own, i).alias("col"))))
    cells = places.join(many, ["band", "code"]).withColumn("cell", sides).select("unit_id", "band", "code", "cell")
    rows = cells.join(coded.drop("codes"), "unit_id").select("unit_id", "v_min", "v_max", "data", "band", "code", "cell")

    def compare(table: pa.Table) -> pa.Table:
        ids, vectors = _matrix(table.combine_chunks().to_batches()[0])
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(ids), 512):
            row, col = np.nonzero(np.round(vectors[a : a + 512] @ vectors.T, 6) >= threshold)
            smaller = col < row + a
            row, col = row[smaller] + a, col[smaller]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            out.append((ids[row[first]], ids[col[first]]))
        copies, of = (np.concatenate(x) for x in zip(*out))
        return pa.table({"unit_id": copies, "copy_of": of})

    across = rows.groupBy("band", "code", "cell").applyInArrow(compare, PAIRS).groupBy("unit_id").agg(F.min("copy_of").alias("copy_of"))
    # members of a class: the class's own copies, and what it is a copy of
    named = keyed.select("unit_id", "content", "v_min", "v_max", "data").join(classes.withColumnRenamed("unit_id", "rep"), ["content", "v_min", "v_max", "data"]).select("unit_id", "rep")
    best = named.join(across.toDF("rep", "other"), "rep", "left").withColumn("copy_of", F.least("rep", "other"))
    return best.where(F.col("copy_of") < F.col("unit_id")).select("unit_id", "copy_of")
