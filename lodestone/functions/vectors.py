"""Vector arithmetic as column expressions, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_RANGE = 1e-9


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def quantize(vector: Column) -> Column:
    """Struct (v_min, v_max, data) with one value 0..255 for each element."""
    v = doubles(vector)
    low, high = F.array_min(v), F.array_max(v)
    span = F.greatest(high - low, F.lit(LEAST_RANGE))
    data = F.transform(v, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.round((x - low) / span * F.lit(255.0)).cast("int"))).cast("smallint"))
    return F.struct(low.alias("v_min"), high.alias("v_max"), data.alias("data"))


def dequantize(data: Column, v_min: Column, v_max: Column) -> Column:
    low, high = v_min.cast("double"), v_max.cast("double")
    return F.transform(data, lambda b: low + b.cast("double") / F.lit(255.0) * (high - low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(query: Column, vector: Column) -> Column:
    """Null for a query without length; a vector without length counts as tiny."""
    length = norm(query)
    return F.when(length >= LEAST_RANGE, dot(query, vector) / (length * F.greatest(norm(vector), F.lit(LEAST_RANGE))))


def sparse(vector: Column, threshold: float) -> Column:
    """Elements of at least ``threshold`` in size, as (place, value)."""
    pairs = F.transform(vector, lambda x, i: F.struct(i.alias("place"), x.cast("double").alias("value")))
    return F.filter(pairs, lambda p: F.abs(p["value"]) >= threshold)
