"""Versions of keyed items: differences, lineage, reuse by fingerprint, invalidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import numbered


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 over what is heard of an item: a null differs from an empty text."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, change: added, removed or changed (null-safe) between two versions with unique keys."""
    o = old.select(*keys, F.struct(*columns).alias("_o"))
    n = new.select(*keys, F.struct(*columns).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return o.join(n, keys, "full_outer").withColumn("change", change).where("change is not null").select(*keys, "change")


def descends_from(items: DataFrame, targets: DataFrame, keys: list[str], id_: str = "id", parents: str = "parents") -> DataFrame:
    """keys, target, id of items that are a target or have it among their parents. parents
    hold the transitive closure; both cases are one equi join on the exploded ids."""
    ids = F.array_distinct(F.concat(F.array(id_), F.coalesce(F.col(parents), F.array().cast("array<string>"))))
    own = items.select(*keys, F.col(id_).alias("id"), F.explode(ids).alias("target"))
    return own.join(targets.select(*keys, "target").distinct(), [*keys, "target"]).distinct()


def reuse(old: DataFrame, new: DataFrame, keys: list[str], id_: str = "id", mark: str = "fingerprint") -> DataFrame:
    """keys, id, reused_id, how: which old item serves each new one, each old one once.

    First those of the same id and fingerprint (exact); then, per fingerprint, the
    n-th item left over on one side takes the n-th on the other (matched), in order
    of id. New items without a partner have how = 'new'."""
    o, n = old.select(*keys, F.col(id_).alias("_old"), mark), new.select(*keys, F.col(id_).alias("_id"), mark)
    exact = cut(n.join(o.withColumnRenamed("_old", "_id"), [*keys, "_id", mark], "left_semi"))
    rest_n = n.join(exact, [*keys, "_id", mark], "left_anti")
    rest_o = o.join(exact.select(*keys, F.col("_id").alias("_old"), mark), [*keys, "_old", mark], "left_anti")
    rank = lambda df, c: numbered(df.withColumn("_h", F.pmod(F.xxhash64(c), F.lit(1 << 20))), [*keys, mark], "_h", "_rank", [c], span=1 << 14)
    matched = rank(rest_n, "_id").drop("_h").join(rank(rest_o, "_old").drop("_h"), [*keys, mark, "_rank"], "left")
    a = exact.select(*keys, F.col("_id").alias("id"), F.col("_id").alias("reused_id"), F.lit("exact").alias("how"))
    b = matched.select(*keys, F.col("_id").alias("id"), F.col("_old").alias("reused_id"), F.when(F.col("_old").isNull(), "new").otherwise("matched").alias("how"))
    return a.unionByName(b)


def unseen(incoming: DataFrame, seen: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the incoming rows those whose key was not seen before, one per key (the first by order)."""
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*incoming.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*").join(seen.select(*keys).distinct(), keys, "left_anti")


# Which artifact is made from which.
MADE_FROM = [("raw", "clean"), ("clean", "segments"), ("segments", "phonetics"), ("phonetics", "master")]


def invalidated(changed: str, edges: list[tuple[str, str]] | None = None) -> list[str]:
    """What has to be made again when ``changed`` changes: the closure over a graph of a few stages."""
    edges = MADE_FROM if edges is None else edges
    out: list[str] = []
    front = [changed]
    while front:
        front = [b for a, b in edges if a in front and b not in out]
        out += front
    return out


def with_columns_of(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with the columns of an older or newer version: missing ones null, in the schema's order; idempotent."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def union_versions(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def latest_applicable(events: DataFrame, now: DataFrame, keys: list[str], state: str, status: str, order: list[str]) -> DataFrame:
    """keys, status, n: the last event made on the state its group is in now, and how many there are."""
    same = events.join(now.select(*keys, state), [*keys, state])
    return same.groupBy(*keys).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n"))


def up_to_date(items: DataFrame, made: DataFrame, keys: list[str], mark: str = "fingerprint") -> DataFrame:
    """``items`` with up_to_date: what was made of it is complete and of the same fingerprint."""
    m = made.select(*keys, F.col(mark).alias("_m"), F.col("complete").alias("_c"))
    return items.join(m, keys, "left").withColumn("up_to_date", F.coalesce(F.col("_c") & (F.col("_m") == F.col(mark)), F.lit(False))).drop("_m", "_c")
