"""Ordered operations within groups of any size.

A window over a group runs in one task, so a group that holds a third of all rows
would not fit. These operators cut each group into stretches of its order
(``span`` wide), work inside the stretches, and carry one row per stretch across:
the same results as the plain window, with no task larger than a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stretch(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn("_s", F.floor(F.col(order) / F.lit(span)).cast("bigint"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: list[str] | None = None, span: int = 50_000, inclusive: bool = True) -> DataFrame:
    """``df`` with ``name``: the sum of value over the rows of the group up to this one
    (without this one unless inclusive). order: a numeric column; ties break by ``ties``.
    Null values count as nothing; rows with a null order come first, as one stretch."""
    rows = _stretch(df.withColumn("_v", value), order, span)
    by = [F.col(order).asc_nulls_first(), *[F.col(t) for t in ties or []]]
    inside = Window.partitionBy(*keys, "_s").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy(F.col("_s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_s").agg(F.sum("_v").alias("_t")).withColumn("_before", F.sum("_t").over(across))
    return _back(rows.withColumn("_here", F.sum("_v").over(inside)), sums.select(*keys, "_s", "_before"), keys).withColumn(
        name, F.coalesce("_before", F.lit(0)) + F.coalesce("_here", F.lit(0))
    ).drop("_v", "_s", "_here", "_before")


def numbered(df: DataFrame, keys: list[str], order: str, name: str, ties: list[str] | None = None, span: int = 50_000) -> DataFrame:
    """``df`` with ``name``: the row's number in its group, from 1."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name, ties, span)


def last_known(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: list[str] | None = None, span: int = 50_000, inclusive: bool = True) -> DataFrame:
    """``df`` with ``name``: the last non-null value up to this row (before it unless inclusive)."""
    rows = _stretch(df.withColumn("_v", value), order, span)
    by = [F.col(order).asc_nulls_first(), *[F.col(t) for t in ties or []]]
    inside = Window.partitionBy(*keys, "_s").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy(F.col("_s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*[F.coalesce(F.col(order), F.lit(-1)), *[F.col(t) for t in ties or []]])
    lasts = rows.where("_v is not null").groupBy(*keys, "_s").agg(F.max_by("_v", rank).alias("_t"))
    stretches = rows.select(*keys, "_s").distinct()
    lasts = _back(stretches, lasts, keys).withColumn("_before", F.last("_t", ignorenulls=True).over(across))
    out = _back(rows.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)), lasts.select(*keys, "_s", "_before"), keys)
    return out.withColumn(name, F.coalesce("_here", "_before")).drop("_v", "_s", "_here", "_before")


def _back(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their stretch (null keys match each other)."""
    few = few.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate([*keys, "_s"])], *[c for c in few.columns if c not in (*keys, "_s")])
    same = None
    for i, k in enumerate([*keys, "_s"]):
        c = rows[k].eqNullSafe(few[f"_j{i}"])
        same = c if same is None else same & c
    return rows.join(few, same, "left").drop(*[f"_j{i}" for i in range(len(keys) + 1)])


def with_neighbour(df: DataFrame, keys: list[str], position: str, columns: list[str], by: int, suffix: str) -> DataFrame:
    """``df`` with ``columns`` of the row ``by`` positions on (null at the ends). position
    must be dense and unique in its group, as ``numbered`` gives it; an equi join on
    (keys, position), so no group has to fit into a task."""
    other = df.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], (F.col(position) - by).alias("_jp"), *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    same = df[position] == other["_jp"]
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(other[f"_j{i}"])
    return df.join(other, same, "left").drop("_jp", *[f"_j{i}" for i in range(len(keys))])
