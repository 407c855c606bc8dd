"""Pairing of records with the nearest record in time of the same entity (problem 5).

Both tables are cut into shards of (entity, stretch of time). A target near a
shard's edge goes into the neighbouring shard too (the edges overlap by the
tolerance), so a query finds its partner inside its own shard and no entity, be
its timeline ever so long, has to fit into one task. Within a shard the sorted
times are indexed by a piecewise-linear model with a proven error bound, a query's
place is predicted by it, and a local search around the prediction gives the
exact neighbours before and after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decimal digits of the scripts that hand-written times come in.
DIGITS = "०१२३४५६७८९" + "০১২৩৪৫৬৭৮৯" + "૦૧૨૩૪૫૬૭૮૯" + "௦௧௨௩௪௫௬௭௮௯" + "۰۱۲۳۴۵۶۷۸۹" + "٠١٢٣٤٥٦٧٨٩" + "０１２３４５６７８９"


def read_seconds(value: Column) -> Column:
    """Seconds of a time written by hand, or null if it can't be read.

    h:m:s and h.m.s (minutes and seconds below 60), m:s and m.s (minutes may
    pass 59), "1h 2m 3s" with any of its parts, and a bare number of seconds; in
    any script's digits, with blanks around."""
    t = F.lower(F.translate(value, DIGITS + "\uff1a\uff0e\uff0c", "0123456789" * 7 + ":.,"))
    t = F.trim(F.regexp_replace(t, r"[\s\x{a0}\x{2000}-\x{200f}\x{202f}\x{2060}\x{3000}\x{feff}]+", " "))
    t = F.regexp_replace(t, r"\s*([:.])\s*", "$1")
    three, two = r"^(\d{1,6})([:.])(\d{1,2})\2(\d{1,2}(?:\.\d+)?)$", r"^(\d{1,7})[:.](\d{1,2})$"
    named = r"^(?:(\d+)\s*h(?:rs?|ours?)?\.?\s*)?(?:(\d+)\s*m(?:ins?|inutes?)?\.?\s*)?(?:(\d+)\s*s(?:ecs?|econds?)?\.?)?$"
    part = lambda pattern, k: F.expr("0D") + F.coalesce(F.regexp_extract(t, pattern, k).try_cast("double"), F.lit(0.0))
    return (
        F.when(t.rlike(r"^\d+$"), t.try_cast("double"))
        .when(t.rlike(three) & (part(three, 3) < 60) & (part(three, 4) < 60), part(three, 1) * 3600 + part(three, 3) * 60 + part(three, 4))
        .when(t.rlike(two) & (part(two, 2) < 60), part(two, 1) * 60 + part(two, 2))
        .when(t.rlike(named) & t.rlike(r"\d"), part(named, 1) * 3600 + part(named, 2) * 60 + part(named, 3))
    )


class LearnedIndex:
    """Piecewise-linear positions of ascending times, each off by ``error`` at most.

    One pass with a shrinking cone: a segment lasts as long as one line through
    its first point stays within the bound for every point."""

    def __init__(self, times: np.ndarray, error: int = 16):
        self.times, self.error = times, error
        first, slopes = [], []
        distinct, at = np.unique(times, return_index=True)
        x, y = distinct.tolist(), at.tolist()
        i, n = 0, len(x)
        while i < n:
            lo, hi, j = 0.0, float("inf"), i + 1
            while j < n:
                dx, dy = x[j] - x[i], y[j] - y[i]
                a, b = max(lo, (dy - error) / dx), min(hi, (dy + error) / dx)
                if a > b:
                    break
                lo, hi, j = a, b, j + 1
            first.append(i)
            slopes.append((lo + hi) / 2 if hi < float("inf") else 0.0)
            i = j
        self.x0, self.y0 = distinct[first], at[first].astype(np.float64)
        self.slope = np.asarray(slopes)
        self.y1 = np.append(self.y0[1:], len(times))

    def place(self, q: np.ndarray) -> np.ndarray:
        """For each query the number of times below it: predicted, then searched
        for between the bounds of the error, all queries at once."""
        if not len(self.times):
            return np.zeros(len(q), np.int64)
        s = np.clip(np.searchsorted(self.x0, q, side="right") - 1, 0, None)
        guess = np.minimum(self.y0[s] + self.slope[s] * np.maximum(q - self.x0[s], 0), self.y1[s])
        lo = np.clip(np.floor(guess).astype(np.int64) - self.error - 1, 0, len(self.times))
        hi = np.clip(np.ceil(guess).astype(np.int64) + self.error + 1, 0, len(self.times))
        # runs of equal times may be longer than the bound
        wrong = ((lo > 0) & (self.times[np.maximum(lo - 1, 0)] >= q)) | ((hi < len(self.times)) & (self.times[np.minimum(hi, len(self.times) - 1)] < q))
        lo, hi = np.where(wrong, 0, lo), np.where(wrong, len(self.times), hi)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            below = (self.times[np.minimum(mid, len(self.times) - 1)] < q) & (lo < hi)
            lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
        return lo


def nearest_in_shard(times: np.ndarray, queries: np.ndarray, tolerance: float, error: int = 16) -> np.ndarray:
    """Place of the nearest of ascending ``times`` for each query, -1 beyond the
    tolerance. Of equally near times the earlier, of equal times the first."""
    got = np.full(len(queries), -1, np.int64)
    if not len(times) or not len(queries):
        return got
    at = LearnedIndex(times, error).place(queries)
    after = np.minimum(at, len(times) - 1)
    before = np.searchsorted(times, times[np.maximum(at - 1, 0)])  # first of a run of equal times
    # milliseconds, so that what is equally far in decimal notation ties in binary too
    d_after, d_before = (np.round(np.abs(times[k] - queries), 6) for k in (after, before))
    best = np.where((at > 0) & (d_before <= d_after), before, after)
    d = np.minimum(np.where(at > 0, d_before, np.inf), np.where(at < len(times), d_after, np.inf))
    return np.where(d <= tolerance, best, got)


def _shards(tolerance: float, error: int):
    names = ["_entity", "_id", "_target", "_distance"]

    def solve(t: pa.Table, out_schema: pa.Schema) -> pa.RecordBatch:
        is_query = t.column("_query").to_numpy()
        targets, queries = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
        times, q = targets.column("_t").to_numpy(), queries.column("_t").to_numpy()
        got = nearest_in_shard(times, q, tolerance, error)
        hit = np.flatnonzero(got >= 0)
        found, target = queries.take(pa.array(hit)), targets.column("_id").take(pa.array(got[hit]))
        cols = [found.column("_entity"), found.column("_id"), target, pa.array(np.abs(times[got[hit]] - q[hit]))]
        return pa.table(cols, names=names).cast(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the shard that is being read
        key = schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([pa.field("_entity", batch.schema.field("_entity").type), ("_id", pa.string()), ("_target", pa.string()), ("_distance", pa.float64())])
            e, s = batch.column("_entity").to_numpy(zero_copy_only=False), batch.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero((e[1:] != e[:-1]) | (s[1:] != s[:-1])) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                k = (e[lo], s[lo])
                if key is not None and k != key:
                    yield from solve(pa.Table.from_batches(held), schema).to_batches()
                    held = []
                key = k
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from solve(pa.Table.from_batches(held), schema).to_batches()

    return run


def nearest(queries: DataFrame, targets: DataFrame, tolerance: float, shard_seconds: float = 1800.0, error: int = 16) -> DataFrame:
    """The nearest target of each query of the same entity, if within ``tolerance``.

    Both tables: entity, id STRING, t DOUBLE. Result: entity, id, target_id,
    distance; a query without a partner has no row. Rows with a null or non-finite
    entity, id or time take no part. Repeated rows count once. Of two targets
    equally near the earlier wins, of equal times the smaller id."""
    width = max(float(shard_seconds), 2.0 * float(tolerance))
    rows = lambda df, query: (
        df.select(F.col("entity").alias("_entity"), F.col("id").alias("_id"), F.col("t").alias("_t"))
        .where("_entity is not null and _id is not null and _t is not null and not isnan(_t) and abs(_t) < double('Infinity')")
        .withColumn("_query", F.lit(query))
    )
    shard = lambda t: F.floor(t / F.lit(width))
    q = rows(queries, True).withColumn("_shard", shard(F.col("_t")))
    slack = tolerance * 1.001 + 1e-6
    t = rows(targets, False).withColumn("_shard", F.explode(F.sequence(shard(F.col("_t") - slack), shard(F.col("_t") + slack))))
    kind = queries.schema["entity"].dataType.simpleString()
    return (
        t.unionByName(q)
        .repartition("_entity", "_shard")
        .sortWithinPartitions("_entity", "_shard", "_query", "_t", "_id")
        .mapInArrow(_shards(float(tolerance), error), f"_entity {kind}, _id string, _target string, _distance double")
        .select(F.col("_entity").alias("entity"), F.col("_id").alias("id"), F.col("_target").alias("target_id"), F.col("_distance").alias("distance"))
        .distinct()
    )
