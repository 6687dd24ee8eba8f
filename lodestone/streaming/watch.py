"""Changes of working trees as a stream: debounce, coalesce, and upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POLL_SECONDS = 5


def debounced(events: DataFrame, key: str, at: str, gap_seconds: float, span_seconds: float | None = None) -> DataFrame:
    """Adds ``batch``: a new one starts after a pause of more than ``gap_seconds`` within a key.

    With ``span_seconds`` a batch is also cut into stretches of that length from its first event.
    """
    order = Window.partitionBy(key).orderBy(at, *[c for c in ("event_id", "scan_id") if c in events.columns])
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    paused = F.coalesce(seconds(F.col(at)) - seconds(F.lag(at).over(order)) > gap_seconds, F.lit(True))
    rows = events.withColumn("batch", F.sum(paused.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    if span_seconds is not None:
        first = F.min(seconds(F.col(at))).over(Window.partitionBy(key, "batch"))
        rows = rows.withColumn("stretch", F.floor((seconds(F.col(at)) - first) / span_seconds).cast("bigint"))
    return rows


def coalesced(batches: DataFrame, keys: list[str], path: str, check_all: Column) -> DataFrame:
    """(keys, check_all, paths): whether a batch asks for a full scan, and else its distinct paths."""
    rows = batches.groupBy(*keys).agg(F.bool_or(check_all).alias("check_all"), F.array_sort(F.collect_set(path)).alias("found"))
    return rows.select(*keys, "check_all", F.when(F.col("check_all"), F.array().cast("array<string>")).otherwise(F.col("found")).alias("paths"))


def watched_paths(events: DataFrame, excluded: list[str], extensions: list[str], path: str = "file_path") -> DataFrame:
    """Events of source files outside excluded folders."""
    parts = F.split(F.col(path), "/")
    return events.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in excluded])) & F.regexp_extract(F.col(path), r"\.([^./]+)$", 1).isin(extensions))


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; idempotent, so a micro-batch that runs again changes nothing."""
    values = [c for c in rows.columns if c not in keys and c not in order]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in [*order, *values]])


def start_upserts(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], keys: list[str], order: list[str], trigger_seconds: int | None = None) -> StreamingQuery:
    """Feeds each micro-batch, reduced to its last row per key, to ``apply(rows, batch_id)``.

    Without ``trigger_seconds`` the query takes what is there and ends.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        apply(last_per_key(batch, keys, order), batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger_seconds is None else writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()


def event_counts(stream: DataFrame, at: str, kind: str, late: str, width: str) -> DataFrame:
    """Counts by kind in windows of event time, with a watermark for late events."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
