"""Token ids of whole texts by a public byte-level BPE (problem 7).

Tree concatenation. A text of at most ``leaf_chars`` code points is one leaf. A
longer one is cut into leaves that are encoded as rows of their own, wherever
there is room, and joined again pairwise: around each join a window is encoded
once more and grows until what it gives agrees with both sides. Sides agree at a
place if no pre-token of the whole text can span it, or if it lies inside one
run and the two tokens there are just what the vocabulary makes of their bytes
(a sequence of tokens is the encoding of its bytes if and only if each two
neighbours are). So the joined ids equal those of the text encoded at once.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text has so many leaves at most; beyond, its leaves are longer. (Each is cut out by a walk over the text.)
MAX_LEAVES = 256
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published pre-token pattern of the 50k byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    """A vocabulary with what joining needs: bytes and length of each token."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.sizes[i] = len(b)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32).astype(np.int32)

    def whole(self, a: int, b: int) -> bool:
        """Whether tokens a, b are what the bytes of both encode to as one run."""
        piece = self.bytes_of[int(a)] + self.bytes_of[int(b)]
        return list(self.encoding._encode_single_piece(piece)) == [int(a), int(b)]


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _kind(c: str) -> str:
    if c.isspace():
        return "s"
    if c.isalpha():
        return "l"
    return "n" if c.isnumeric() else "o"


def _apart(text: str, at: int) -> bool:
    """No pre-token spans ``at`` whatever else the text holds."""
    a, b = text[at - 1], text[at]
    ka, kb = _kind(a), _kind(b)
    return ka != "s" and ka != kb and a != "'" and (b in " \n\t" or (a.isascii() and b.isascii()))


def _inside(text: str, at: int) -> bool:
    """Both sides of ``at`` belong to one run of plain letters."""
    a, b = text[at - 1], text[at]
    return a.isalpha() and b.isalpha() and not (at > 1 and text[at - 2] == "'") and not (at > 2 and text[at - 3] == "'")


def join_ids(code: Codec, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], window: int = 48) -> tuple[str, np.ndarray]:
    """Text and ids of ``left`` followed by ``right`` (each a text with its ids)."""
    (lt, li), (rt, ri) = left, right
    if not lt or not rt:
        return lt + rt, np.concatenate([li, ri])
    text, cut = lt + rt, len(lt)
    l_end = np.cumsum(code.sizes[li[::-1]])  # bytes from each token's start to the join
    r_end = np.cumsum(code.sizes[ri])
    while True:
        lo, hi = max(0, cut - window), min(len(text), cut + window)
        got = None
        for a in range(max(1, cut - window // 4), max(lo, 1) - 1, -1) if lo else [*range(max(1, cut - window // 4), 0, -1), 0]:
            n = len(text[a:cut].encode())
            k = int(np.searchsorted(l_end, n))
            if k < len(l_end) and l_end[k] == n and (a == 0 or _apart(text, a) or _inside(text, a)):
                keep_l, start = len(li) - k - 1, a
                break
        else:
            window *= 2
            continue
        for b in range(min(len(text), cut + window // 4), hi + 1):
            n = len(text[cut:b].encode())
            k = int(np.searchsorted(r_end, n))
            if k < len(r_end) and r_end[k] == n and (b == len(text) or _apart(text, b) or _inside(text, b)):
                mid = code.encode(text[start:b])
                ok = len(mid) > 0
                if ok and start and not _apart(text, start):
                    ok = keep_l > 0 and code.whole(li[keep_l - 1], mid[0])
                if ok and b < len(text) and not _apart(text, b):
                    ok = k + 1 < len(ri) and code.whole(mid[-1], ri[k + 1])
                if ok:
                    got = np.concatenate([li[:keep_l], mid, ri[k + 1 :]])
                break
        if got is not None:
            return text, got
        if lo == 0 and hi == len(text):
            return text, code.encode(text)
        window *= 2


def join_tree(code: Codec, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Ids of the leaves' concatenated text, joined level by level."""
    while len(leaves) > 1:
        leaves = [join_ids(code, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0][1] if leaves else np.zeros(0, np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32), pa.int32()))


def _encode_rows(path: str, keep: list[str], count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids = [code.encode(t) if t else np.zeros(0, np.int32) for t in texts.slice(lo, 1024).to_pylist()]
                got = pa.array([len(i) for i in ids], pa.int64()) if count_only else _lists(ids)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, got], names=[*keep, "_got"])

    return run


def _join_group(path: str, count_only: bool):
    def run(table: pa.Table) -> pa.Table:
        code = codec(path)
        order = np.argsort(table.column("_leaf").to_numpy())
        texts, ids = table.column("_text").to_pylist(), table.column("_got").combine_chunks()
        leaves = [(texts[i], np.asarray(ids[int(i)].values.to_numpy(zero_copy_only=False), np.int32)) for i in order]
        joined = join_tree(code, leaves)
        got = pa.array([len(joined)], pa.int64()) if count_only else _lists([joined])
        return pa.table([table.column("_key").slice(0, 1), got], names=["_key", "_got"])

    return run


def _encode(docs: DataFrame, key: str, text: str, vocabulary: str, leaf_chars: int, count_only: bool) -> DataFrame:
    got = "bigint" if count_only else "array<int>"
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    fits = F.coalesce(F.length("_text"), F.lit(0)) <= leaf_chars
    short = rows.where(fits).mapInArrow(_encode_rows(vocabulary, ["_key"], count_only), f"_key {kind}, _got {got}")
    size = F.greatest(F.lit(leaf_chars), F.ceil(F.length("_text") / F.lit(MAX_LEAVES)).cast("int"))
    n = F.ceil(F.length("_text") / size).cast("int")
    leaves = rows.where(~fits).select("_key", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("_text", i * size + 1, size))).alias("_leaf", "_text"))
    long = (
        leaves.repartition("_key", "_leaf")
        .mapInArrow(_encode_rows(vocabulary, ["_key", "_leaf", "_text"], False), f"_key {kind}, _leaf int, _text string, _got array<int>")
        .groupBy("_key")
        .applyInArrow(_join_group(vocabulary, count_only), f"_key {kind}, _got {got}")
    )
    return short.unionByName(long)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, leaf_chars: int = 4096) -> DataFrame:
    """``key`` and ``ids`` of every row, without special tokens.

    ``key`` must be unique. A null or empty text has an empty list; an empty table
    gives none; other columns, whatever their names, are left behind."""
    return _encode(docs, key, text, vocabulary, leaf_chars, False).select(F.col("_key").alias(key), F.col("_got").alias("ids"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, leaf_chars: int = 4096) -> DataFrame:
    """``key`` and ``n_tokens`` of every row: the length of what ``token_ids`` gives."""
    return _encode(docs, key, text, vocabulary, leaf_chars, True).select(F.col("_key").alias(key), F.col("_got").alias("n_tokens"))
