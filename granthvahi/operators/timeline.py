"""Timelines: running offsets, points and ranges in intervals, remapping between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sum


def running_offsets(rows: DataFrame, keys: list[str], order: str, duration_ms: Column, pause_ms: Column, speed: float = 1.0) -> DataFrame:
    """``rows`` with start_seconds and end_seconds: each begins where all before it, pauses
    included, have ended; an end includes the row's own pause. Whole milliseconds until the last step."""
    step = (F.coalesce(duration_ms, F.lit(0)) + F.coalesce(pause_ms, F.lit(0))).cast("bigint")
    out = running_sum(rows.withColumn("_step", step), keys, order, F.col("_step"), "_end")
    seconds = lambda c: F.round(c / F.lit(1000.0 * speed), 3)
    return out.withColumn("start_seconds", seconds(F.col("_end") - F.col("_step"))).withColumn("end_seconds", seconds(F.col("_end"))).drop("_step", "_end")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """Points with the intervals that hold them: start <= at < end (closed: <= end).

    A range join as an equi join: both sides are cut into cells of ``width``; a long
    interval lies in several cells, a point in one, so each pair meets once."""
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    p = points.where(F.col(at).isNotNull()).withColumn("_cell", cell(F.col(at)))
    i = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    i = i.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    inside = (F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end))
    return p.join(i, [*keys, "_cell"]).where((F.col(start) <= F.col(at)) & inside).drop("_cell")


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each group the first row by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def remap(points: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], id_: str, at: str, pad: float = 1.0, window: float = 5.0, width: float = 60.0) -> DataFrame:
    """Points of an old timeline as stretches of a new one: where the old interval's id
    lies now, padded; a point no interval holds, or whose id is gone, gives the window
    around its old time. old and new: keys, id, start_seconds, end_seconds."""
    unique = [c for c in points.columns]
    held = points_in_intervals(points, old.select(*keys, F.col(id_).alias("_id"), F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e")), keys, at, "_s", "_e", width, closed=True)
    held = first_per(held, unique, [F.col("_s"), F.col("_id")]).select(*unique, "_id")
    same = points.distinct().join(held, unique, "left")
    now = new.select(*keys, F.col(id_).alias("_id"), F.col("start_seconds").alias("_ns"), F.col("end_seconds").alias("_ne"))
    out = same.join(now, [*keys, "_id"], "left")
    low, high = F.greatest(F.lit(0.0), F.coalesce(F.col("_ns") - pad, F.col(at) - window)), F.coalesce(F.col("_ne") + pad, F.col(at) + window)
    return out.select(*unique, F.col("_id").alias("matched_id"), low.alias("from_seconds"), high.alias("to_seconds"), F.col("_ns").isNotNull().alias("remapped"))


def printed_pages(pages: DataFrame, page: str, rules: list[tuple[int, int, int | None]], overrides: dict[int, str] | None = None, fallback: int | None = None) -> DataFrame:
    """``pages`` with printed_page: an override, else what the first range that holds the
    page gives (its first printed number, or none), else the page plus ``fallback``.
    Ranges (first, last, printed number of the first) must not overlap."""
    ordered = sorted(rules)
    for (_, last, _), (first, _, _) in zip(ordered, ordered[1:], strict=False):
        if first <= last:
            raise ValueError("page ranges overlap")
    label = F.lit(None).cast("string") if fallback is None else (F.col(page) + fallback).cast("string")
    for first, last, printed in reversed(ordered):
        inside = F.col(page).between(first, last)
        label = F.when(inside, F.lit(None).cast("string") if printed is None else (F.col(page) - first + printed).cast("string")).otherwise(label)
    for number, text in (overrides or {}).items():
        label = F.when(F.col(page) == number, F.lit(text)).otherwise(label)
    return pages.withColumn("printed_page", label)


def order_faults(segments: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, n_apart: groups with chunks in which the n-th chunk is not the n-th segment, and at how many
    places. segments: key, n, id; chunks: key, n, chunk_id, numbered in order. An equi join on the
    place instead of two whole lists; groups without chunks are no faults."""
    s = segments.select(F.col(key), "n", F.col("id").alias("_id"))
    c = chunks.select(F.col(key), "n", F.col("chunk_id").alias("_chunk"), F.lit(True).alias("_has"))
    both = s.join(c, [key, "n"], "full_outer")
    apart = (~F.col("_id").eqNullSafe(F.col("_chunk"))).cast("bigint")
    return both.groupBy(key).agg(F.sum(apart).alias("n_apart"), F.count("_has").alias("_n")).where("_n > 0 and n_apart > 0").drop("_n")
