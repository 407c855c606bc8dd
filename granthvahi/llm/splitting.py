"""Splitting of oversized items at natural boundaries with overlap (problem 2).

Dynamic programming over the boundary positions of a text. A piece reaches from
``overlap`` units before one cut to the next cut and is at most ``limit`` units
long. The cost of a plan is the sum of its cuts' penalties (a paragraph's end
costs nothing, a place inside a word much) and of each piece's imbalance, the
squared share by which it differs from the even size. Positions come in tiers
of naturalness: a window that holds none of a tier is given those of the next,
down to any whole character, so a plan always exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cuts lie behind what these match; the penalty says how much such a cut disturbs.
BOUNDARIES = [
    (regex.compile(r"\n[ \t]*\n\s*"), 0.0),
    (regex.compile(r"\n"), 0.15),
    (regex.compile(r"[।॥.!?۔؟。！？…]+[\"'”’»)\]」』]*(?:\s+|(?=[぀-鿿])|$)"), 0.25),
    (regex.compile(r"[,;:،؛、，；：—–](?:\s+|(?=[぀-鿿]))"), 0.6),
    (regex.compile(r"\s+"), 1.0),
]
INSIDE = 4.0
GRAPHEME = regex.compile(r"\X")


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions a cut may lie at, ascending, and their penalties. Where no blank
    or mark lies within half of ``reach`` code points, grapheme ends serve."""
    best: dict[int, float] = {}
    for pattern, penalty in BOUNDARIES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), penalty)
    at = sorted({0, len(text), *best})
    for a, b in zip(at, at[1:], strict=False):
        if b - a > max(1, reach // 2):
            for m in GRAPHEME.finditer(text, a, b):
                best.setdefault(m.end(), INSIDE)
                if m.end() - m.start() > reach // 2:  # a cluster of marks as long as a piece: any code point
                    best.update({i: 2 * INSIDE for i in range(m.start() + 1, m.end())})
    best.pop(0, None)
    best[len(text)] = 0.0
    pos = np.array(sorted(best), np.int64)
    return pos, np.array([best[p] for p in pos.tolist()])


def split_text(text: str, limit: int, overlap: int, unit: str = "characters", balance: float = 3.0) -> list[tuple[int, int]]:
    """(start, end) of each piece in code points. A text within the limit is one
    piece; the overlap is given up to a whole character at most."""
    n = len(text)
    if unit == "characters":
        offset = np.arange(n + 1)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.concatenate([[0], np.cumsum(width)])
    size = int(offset[-1])
    if size <= limit:
        return [(0, n)]
    room = limit - overlap  # what a piece adds at most
    if room <= 0 or (unit != "characters" and room < 4):
        raise ValueError("the overlap must leave room below the limit")
    pos, penalty = boundaries(text, room if unit == "characters" else room // 4)
    units = offset[pos]
    # even pieces: the first is one overlap longer than what the others add
    pieces = max(2, -(-(size - overlap) // room))
    even = (size - overlap) / pieces
    m = len(pos)
    cost, back = np.full(m, np.inf), np.full(m, -1, np.int64)
    first = np.flatnonzero(units <= limit)
    added = np.append(units[first] - overlap, 0)[: len(first)]
    cost[first] = penalty[first] + balance * ((added - even) / even) ** 2
    lows = np.searchsorted(units, units - room, side="left")
    for j in range(m):
        lo = lows[j]
        # a cut before the overlap is full would repeat text from two pieces before
        if lo < j:
            prev = cost[lo:j]
            got = prev + balance * ((units[j] - units[lo:j] - even) / even) ** 2
            k = int(np.argmin(got))
            if got[k] + penalty[j] < cost[j]:
                cost[j], back[j] = got[k] + penalty[j], lo + k
    if not np.isfinite(cost[-1]):
        raise ValueError("no plan")
    cuts, j = [], m - 1
    while j >= 0:
        cuts.append(int(pos[j]))
        j = int(back[j])
    cuts.reverse()
    starts = [0]
    for c in cuts[:-1]:
        starts.append(int(np.searchsorted(offset, max(0, offset[c] - overlap), side="left")))
    return list(zip(starts, cuts, strict=True))


def _split_rows(limit: int, overlap: int, unit: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, start, end, text = [], [], [], [], []
            for i, t in enumerate(batch.column(batch.schema.get_field_index("_text")).to_pylist()):
                for k, (a, b) in enumerate(split_text(t, limit, overlap, unit)):
                    row.append(i), no.append(k), start.append(a), end.append(b), text.append(t[a:b])
            take = pa.array(row, pa.int64())
            cols = [batch.column(batch.schema.get_field_index(k)).take(take) for k in keys]
            cols += [pa.array(no, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "piece", "start_at", "end_at", "piece_text"])

    return run


def split_oversized(items: DataFrame, keys: list[str], text: str, limit: int, overlap: int, unit: str = "characters", oversized_only: bool = False) -> DataFrame:
    """Pieces of every item: ``keys``, piece, start_at, end_at (code points), piece_text.

    unit: characters (code points) or utf8_bytes. Items within the limit are one
    piece and never leave the JVM; a null text has no piece, an empty one a single
    empty piece. Repeated rows are split once. Columns other than the keys, whatever
    their names, are left behind."""
    rows = items.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).alias("_text")).where("_text is not null")
    ks = [f"_k{i}" for i in range(len(keys))]
    size = F.length("_text") if unit == "characters" else F.octet_length("_text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in ks) + ", piece bigint, start_at bigint, end_at bigint, piece_text string"
    # planning costs far more than the rows' bytes tell: as many tasks as a shuffle has, not coalesced by size
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.where(size > limit).repartition(tasks, *ks, "_text").dropDuplicates().mapInArrow(_split_rows(limit, overlap, unit, ks), schema)
    if not oversized_only:
        zero = F.lit(0).cast("bigint")
        whole = rows.where(size <= limit).dropDuplicates()
        out = out.unionByName(whole.select(*ks, zero.alias("piece"), zero.alias("start_at"), F.length("_text").cast("bigint").alias("end_at"), F.col("_text").alias("piece_text")))
    return out.select(*[F.col(k).alias(n) for k, n in zip(ks, keys, strict=True)], "piece", "start_at", "end_at", "piece_text")
