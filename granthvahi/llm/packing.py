"""Packing of items into containers of fixed capacity (problem 8).

Hierarchical multi-length packing over the histogram of sizes. Sizes are whole
numbers up to the capacity, so the histogram has at most ``capacity`` rows
however many items there are, and it alone goes to the driver.

1. Routing: windows have context sizes (capacity, a half of it, a quarter, ...);
   an item belongs to the tier of the smallest window that holds it.
2. Each tier is packed by itself into windows of its own size, and what room these
   windows leave is filled from the shorter tiers, best fit first, before those open
   windows of their own.
3. Windows are put together into containers; sizes being halves of each other, they
   tile. Containers are dealt to step groups of about equal numbers of tokens.

The plan is a list of containers' patterns and how often each is used. Items find
their place by their rank among those of their size: a range join with the plan.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

Held = tuple[int, ...]  # the sizes in a window, from long to short
Windows = tuple[tuple[int, Held], ...]  # a container: its windows' sizes and what they hold


class Rooms:
    """Equal open boxes in groups: (what is in one, how many of them) by the room they have left."""

    def __init__(self) -> None:
        self.open: dict[int, list[tuple[tuple, int]]] = {}
        self.rooms: list[int] = []  # ascending

    def put(self, room: int, inside: tuple, n: int) -> None:
        if n <= 0:
            return
        if room not in self.open:
            bisect.insort(self.rooms, room)
            self.open[room] = []
        self.open[room].append((inside, n))

    def fit(self, size: int, thing: object, left: int, new: int | None = None) -> int:
        """Puts ``left`` things of a size where the least room holds one, whole groups of
        boxes at once; then into new boxes of ``new``, if there may be any. Returns how
        many are still outside."""
        while left:
            at = bisect.bisect_left(self.rooms, size)
            if at < len(self.rooms):
                room = self.rooms[at]
                inside, n = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    self.rooms.pop(at)
            elif new is not None:
                room, inside, n = new, (), left
            else:
                break
            each = min(room // size, left)
            use = min(n, left // each)
            if inside:
                self.put(room, inside, n - use)
            self.put(room - each * size, inside + (thing,) * each, use)
            left -= use * each
        return left

    def all(self) -> list[tuple[tuple, int]]:
        return [x for group in self.open.values() for x in group]


def plan_patterns(histogram: dict[int, int], capacity: int, tiers: int = 4) -> list[tuple[Windows, int]]:
    """Containers' patterns and how often each is used, fullest first.

    Work and result follow the number of distinct sizes and not the number of items.
    One tier is best fit decreasing into whole containers."""
    left = {s: n for s, n in histogram.items() if n > 0}
    containers = Rooms()
    for t in range(tiers):
        window = capacity >> t
        low = 0 if t == tiers - 1 else capacity >> (t + 1)
        if window == 0:
            break
        held = Rooms()
        for size in sorted((s for s in left if low < s <= window), reverse=True):
            left[size] = held.fit(size, size, left[size], window)
        for size in sorted((s for s, n in left.items() if n and s <= low), reverse=True):  # gaps, from shorter tiers
            left[size] = held.fit(size, size, left[size])
        for inside, n in sorted(held.all(), key=lambda x: (-sum(x[0]), x[0])):
            containers.fit(window, (window, inside), n, capacity)
    return sorted(containers.all(), key=lambda x: (-sum(sum(w) for _, w in x[0]), x[0]))


def place_table(patterns: list[tuple[Windows, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (size, rank from, rank to, first container, items of that size in each window, window, its size)."""
    rows, used, base = [], {}, 0
    for windows, n in patterns:
        for k, (window, inside) in enumerate(windows):
            for size in dict.fromkeys(inside):
                each = inside.count(size)
                lo = used.get(size, 0)
                used[size] = lo + each * n
                rows.append((size, lo, used[size], base, each, k, window))
        base += n
    return rows


def pack(sizes: DataFrame, key: str, size: str, capacity: int, step: int = 8, tiers: int = 4, rank_buckets: int = 256) -> DataFrame:
    """Every item of ``sizes`` with its container.

    Result: ``key``, piece, piece_size, container, window (its number in the container),
    window_size, tier (the item's own, so that an item in a larger window fills a gap),
    step_group. An item above the capacity is cut into full pieces and a rest; any other
    is whole (piece 0). Null and negative sizes count as 0. Items of size 0 need no room
    and lie in the first window of container 0. Repeated rows are items of their own;
    ties go by key. step_group deals the containers to groups of about ``step`` each,
    fullest first and there and back, so that groups of equal number differ by less than
    one container's spread.

    The histogram (at most ``capacity`` rows) is all that reaches the driver."""
    spark = sizes.sparkSession
    cap = F.lit(int(capacity)).cast("bigint")
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))
    items = sizes.select(F.col(key).alias("_key"), n.alias("_n"))
    last = F.greatest(F.ceil(F.col("_n") / cap) - 1, F.lit(0)).cast("bigint")
    items = items.select("_key", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    items = items.select("_key", "piece", F.least(cap, F.col("_n") - F.col("piece") * cap).alias("piece_size"))
    items = cut(items.withColumn("_b", F.pmod(F.xxhash64("_key", "piece"), F.lit(rank_buckets)).cast("int")))

    counts = items.where("piece_size > 0").groupBy("piece_size", "_b").agg(F.count("*").alias("_c"))
    histogram = {r["piece_size"]: r["n"] for r in counts.groupBy("piece_size").agg(F.sum("_c").alias("n")).collect()}  # <= capacity rows
    patterns = plan_patterns(histogram, int(capacity), tiers)
    containers = sum(c for _, c in patterns)
    places = spark.createDataFrame(place_table(patterns), "piece_size bigint, _lo bigint, _hi bigint, _base bigint, _each bigint, _w bigint, _ws bigint")

    before = Window.partitionBy("piece_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    # each bucket of a size is a slice of the ranks; patterns meet slices before items do
    slices = starts.join(places, "piece_size").where("_lo < _start + _c and _hi > _start")
    slices = slices.groupBy("piece_size", "_b").agg(F.min("_start").alias("_start"), F.sort_array(F.collect_list(F.struct("_lo", "_hi", "_base", "_each", "_w", "_ws"))).alias("_p"))
    rank = F.row_number().over(Window.partitionBy("piece_size", "_b").orderBy("_key", "piece")).cast("bigint") - 1
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = items.where("piece_size > 0").repartition(spread, "piece_size", "_b").withColumn("_r", rank).join(slices, ["piece_size", "_b"])
    placed = placed.withColumn("_r", F.col("_r") + F.col("_start"))
    placed = placed.withColumn("_p", F.element_at(F.filter("_p", lambda p: (p["_lo"] <= F.col("_r")) & (p["_hi"] > F.col("_r"))), 1))
    container = F.col("_p._base") + F.floor((F.col("_r") - F.col("_p._lo")) / F.col("_p._each")).cast("bigint")
    placed = placed.select("_key", "piece", "piece_size", container.alias("container"), F.col("_p._w").alias("window"), F.col("_p._ws").alias("window_size"))
    zero = F.lit(0).cast("bigint")
    first = F.lit(patterns[0][0][0][0] if patterns else int(capacity)).cast("bigint")
    nothing = items.where("piece_size = 0").select("_key", "piece", "piece_size", zero.alias("container"), zero.alias("window"), first.alias("window_size"))
    groups = F.lit(max(1, -(-containers // step)))
    turn, at = F.floor(F.col("container") / groups), F.pmod(F.col("container"), groups)
    group = F.when(turn % 2 == 0, at).otherwise(groups - 1 - at).cast("bigint")
    tier = F.lit(int(capacity) >> (tiers - 1))
    for t in range(tiers - 2, -1, -1):
        tier = F.when(F.col("piece_size") > (int(capacity) >> (t + 1)), F.lit(int(capacity) >> t)).otherwise(tier)
    out = placed.unionByName(nothing)
    return out.select(F.col("_key").alias(key), "piece", "piece_size", "container", "window", "window_size", tier.cast("bigint").alias("tier"), group.alias("step_group"))
