"""Phrases heard and written down in Latin letters, looked for in all sentences of their book.

The notes of a book are a stated set of queries against all of its sentences. Both
sides are cut into blocks, every block of notes meets every block of sentences, and
each block pair is a task of bounded size, however many notes or sentences one book
has. Inside a block no pair is skipped on a guess: a pair is left out only if an upper
bound of its score lies below what the note has already found. The bound is the
longest common subsequence, which no sum of matching blocks can exceed. It is worked
out for all notes of a block at once along the sorted texts of all windows, what
they begin with in common only once; small books share a block.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfc_devanagari, roman_note, romanize
from ..session import cut

VOWELS = frozenset("aeiou")
#: Strings of so many characters or more are compared by difflib, whose rule for frequent characters begins here.
LONG = 200
#: Pairs that are compared at once.
PAIRS = 8192
#: Sentences that small books put together in one block.
SHARED = 8192
#: Slack for scores being rounded to four places.
ROUNDING = 6e-5
RESULT = "passage_id string, sentence_no int, window string, score double"


def skeleton(text: str) -> str:
    return "".join(c for c in text if c != " " and c not in VOWELS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, texts), default=0) or 1
    flat = _codes("".join([t.ljust(width, "\0") for t in texts]))
    return flat.reshape(len(texts), width), np.array([len(t) for t in texts], np.int64)


def matched(a: str | list[str], texts: list[str]) -> np.ndarray:
    """Sum of the matching blocks of ``a`` (one for all or one for each) with ``texts``, all of
    them at once: the longest common run, the first of equals, then the same on either side of it."""
    out = np.zeros(len(texts), np.int64)
    if not a or not texts:
        return out
    if len(texts) > 2 * PAIRS:
        parts = range(0, len(texts), PAIRS)
        return np.concatenate([matched(a if isinstance(a, str) else a[k : k + PAIRS], texts[k : k + PAIRS]) for k in parts])
    # short and long ones apart: every text is as wide as the longest beside it
    middle = 2 * sorted(map(len, texts))[len(texts) // 2] + 8
    far = [i for i, t in enumerate(texts) if len(t) > middle]
    if far:
        near = [i for i, t in enumerate(texts) if len(t) <= middle]
        for few in (near, far):
            out[few] = matched(a if isinstance(a, str) else [a[i] for i in few], [texts[i] for i in few])
        return out
    code, lengths = _padded([a] if isinstance(a, str) else a)
    if len(code) < len(texts):
        code, lengths = np.repeat(code, len(texts), axis=0), np.repeat(lengths, len(texts))
    return _matched(code, lengths, *_padded(texts))


def _matched(code: np.ndarray, lengths: np.ndarray, b: np.ndarray, sizes: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
    """need: pairs that cannot come to as much are given up; what they have by then is less."""
    out = np.zeros(len(b), np.int64)
    owner = np.flatnonzero((sizes > 0) & (lengths > 0))
    zero = np.zeros(len(owner), np.int64)
    a_lo, a_hi, b_lo, b_hi = zero, lengths[owner], zero, sizes[owner]
    place = np.arange(b.shape[1])[:, None]
    across = np.arange(code.shape[1])[:, None]
    while len(owner):
        # a column for each pair; what lies outside its stretches equals nothing
        mine = np.where((place >= b_lo) & (place < b_hi), b[owner].T, 0)
        note = np.where((across >= a_lo) & (across < a_hi), code[owner].T, 255)
        run = np.zeros((b.shape[1] + 1, len(owner)), np.uint8)
        size, at_a, at_b = np.zeros(len(owner), np.uint8), *(np.zeros(len(owner), np.int64) for _ in range(2))
        for i in range(int(a_lo.min()), int(a_hi.max())):
            run[1:] = (run[:-1] + np.uint8(1)) * (mine == note[i])
            top = run.max(axis=0)
            more = np.flatnonzero(top > size)
            if len(more):
                size[more] = top[more]
                at_a[more], at_b[more] = i + 1 - top[more].astype(np.int64), run[:, more].argmax(axis=0) - top[more].astype(np.int64)
        size = size.astype(np.int64)
        np.add.at(out, owner, size)
        hit = size > 0
        owner, size, at_a, at_b, a_lo, a_hi, b_lo, b_hi = (x[hit] for x in (owner, size, at_a, at_b, a_lo, a_hi, b_lo, b_hi))
        owner = np.concatenate([owner, owner])
        a_lo, a_hi = np.concatenate([a_lo, at_a + size]), np.concatenate([at_a, a_hi])
        b_lo, b_hi = np.concatenate([b_lo, at_b + size]), np.concatenate([at_b, b_hi])
        rest = (a_lo < a_hi) & (b_lo < b_hi)
        if need is not None:
            could = out + np.bincount(owner, np.where(rest, np.minimum(a_hi - a_lo, b_hi - b_lo), 0), len(out))
            rest &= (could >= need)[owner]
        owner, a_lo, a_hi, b_lo, b_hi = (x[rest] for x in (owner, a_lo, a_hi, b_lo, b_hi))
    return out


def ratios(a: str | list[str], texts: list[str]) -> np.ndarray:
    """2 * matches / length of both, as difflib gives it; 1 where both are empty. ``a``: one for all or one for each."""
    each = [a] * len(texts) if isinstance(a, str) else a
    long = [i for i, t in enumerate(texts) if len(t) >= LONG]
    m = matched(a, ["" if len(t) >= LONG else t for t in texts]).astype(float)
    total = np.array([len(x) + len(t) for x, t in zip(each, texts, strict=True)], float)
    out = np.where(total > 0, 2.0 * m / np.maximum(total, 1.0), 1.0)
    for i in long:
        out[i] = SequenceMatcher(None, each[i], texts[i]).ratio()
    return out


class Starts:
    """The windows of a block of sentences, by the word they start with."""

    def __init__(self, sentences: list[str]):
        self.words = [w for s in sentences for w in s.split(" ")]
        sizes = np.array([s.count(" ") + 1 for s in sentences], np.int64)
        self.stops = np.cumsum(sizes)
        self.begins = self.stops - sizes
        place = np.arange(len(self.words))
        sentence = np.repeat(np.arange(len(sentences)), sizes)
        self.rest = self.stops[sentence] - place
        self.short = np.where(place == self.begins[sentence], sizes[sentence], 0)  # words of the sentence, at its first word
        bare = {w: skeleton(w) for w in set(self.words)}
        bones = [bare[w] for w in self.words]
        texts = [" ".join(self.words), "".join(bones)]
        gap = [1, 0]  # a blank follows each word of a text
        self.ends = [np.concatenate([[0], np.cumsum([len(w) + g for w in ws])]) for ws, g in zip((self.words, bones), gap, strict=True)]
        self.codes = [_codes(t) if t else np.zeros(1, np.uint8) for t in texts]
        self._made: dict[int, tuple] = {}
        self._lengths: dict[int, tuple] = {}

    def window(self, start: int, width: int) -> str:
        return " ".join(self.words[start : start + min(width, self.rest[start])])

    def lengths(self, n: int) -> tuple:
        """For notes of n words: widths; each window's length (-1: there is no such window), of its text and of its skeleton."""
        if n not in self._lengths:
            widths = np.arange(max(1, n - 1), n + 4)
            has = self.rest[:, None] >= widths
            has[(self.short > 0) & (self.short < widths[0]), 0] = True  # a sentence of fewer words is one window
            place = np.arange(len(self.words))
            last = place[:, None] + np.minimum(widths, self.rest[:, None])
            self._lengths[n] = (widths, *[np.where(has, ends[last] - ends[place][:, None] - gap, -1) for ends, gap in zip(self.ends, (1, 0), strict=True)])
        return self._lengths[n]

    def of(self, n: int) -> tuple:
        """For notes of n words: widths; of texts and of skeletons the characters from each
        start and each window's length."""
        if n not in self._made:
            widths, *lengths = self.lengths(n)
            place = np.arange(len(self.words))
            out = [widths]
            for ends, codes, length in zip(self.ends, self.codes, lengths, strict=True):
                # longest first, so that the walk over characters leaves out those that have ended
                longest = length.max(axis=1)
                by = np.argsort(-longest, kind="stable")
                wide = min(int(longest.max(initial=0)), WIDEST)
                at = np.minimum(ends[place[by]][:, None] + np.arange(wide), len(codes) - 1)
                going = len(by) - np.searchsorted(longest[by][::-1], np.arange(wide), side="right")
                out.append((np.ascontiguousarray(codes[at].T), length, by, going))
            self._made[n] = tuple(out)
        return self._made[n]


#: Of a longer window only the lengths bound the score.
WIDEST = 256


def _bounds(note: str, codes: np.ndarray, length: np.ndarray, by: np.ndarray, going: np.ndarray) -> np.ndarray:
    """No ratio of the note with a window is above 2 * common subsequence / lengths: bit-parallel over all starts."""
    common = np.zeros(length.shape, np.int64)
    rows = np.empty(len(by), np.int64)
    rows[by] = np.arange(len(by))
    at = np.clip(length, 0, len(codes))
    for lo in range(0, len(note), 64):  # a longer note: the sum of its parts' is a bound as well
        part = note[lo : lo + 64]
        table = np.zeros(256, np.uint64)
        for i, c in enumerate(part):
            table[ord(c)] |= np.uint64(1 << i)
        mask = np.uint64((1 << len(part)) - 1)
        v = np.full(codes.shape[1], mask, np.uint64)
        left = np.full((len(codes) + 1, codes.shape[1]), len(part), np.uint8)
        for j, n in enumerate(going):
            v = v[:n]
            u = v & table[codes[j, :n]]
            v = ((v + u) | (v - u)) & mask
            np.bitwise_count(v, out=left[j + 1, :n])
        common += len(part) - left[at, rows[:, None]].astype(np.int64)
    common = np.where(length > len(codes), np.minimum(len(note), length), common)
    total = len(note) + length
    return np.where(length < 0, -1.0, np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0))


def best_of_block(note: str, starts: Starts, ids: list[tuple], best: int, least: float, chunk: int = 128) -> list[tuple]:
    """The note's ``best`` sentences of a block: (score, id, window), by score, then id."""
    if not ids:
        return []
    widths, texts_of, bones_of = starts.of(len(note.split(" ")))
    bare = skeleton(note)
    whole, thin = _bounds(note, *texts_of), _bounds(bare, *bones_of)
    either = np.maximum(whole, thin)
    bound = np.maximum.reduceat(either.max(axis=1), starts.begins)
    order = np.argsort(-bound, kind="stable")
    found: list[tuple] = []
    for lo in range(0, len(order), chunk):
        floor = (found[best - 1][0] if len(found) >= best else least) - ROUNDING
        few = [int(s) for s in order[lo : lo + chunk] if bound[s] >= floor]
        if not few:
            break
        # of each sentence the window of the highest bound first ...
        spans = [slice(starts.begins[s], starts.stops[s]) for s in few]
        tops = [divmod(int(whole[x].argmax()), len(widths)) for x in spans]
        first = ratios(note, [starts.window(x.start + r, widths[c]) for x, (r, c) in zip(spans, tops, strict=True)])
        # ... then those that may be nearer still, unless none of them could score enough
        more, texts = [], []
        for k, x in enumerate(spans):
            may = whole[x] >= first[k] - 1e-12
            if either[x][may].max() >= floor:
                for c, r in np.argwhere(may.T):  # equals are taken by width, then place
                    more.append(k)
                    texts.append(starts.window(x.start + r, widths[c]))
        top: dict[int, tuple] = {}
        for k, t, x in zip(more, texts, ratios(note, texts).tolist(), strict=True):
            if k not in top or x > top[k][0]:
                top[k] = (x, t)
        for (k, (x, t)), y in zip(top.items(), ratios(bare, [skeleton(t) for _, t in top.values()]), strict=True):
            score = round(max(float(x), float(y)), 4)
            if score >= least:
                found.append((score, ids[few[k]], t))
        found.sort(key=lambda x: (-x[0], x[1]))
        del found[best:]
    return found


#: Letters, digits and the blank, which is all that romanised texts hold; 0 ends a text.
ALPHABET = np.zeros(256, np.uint8)
ALPHABET[list(b" abcdefghijklmnopqrstuvwxyz0123456789")] = np.arange(1, 38)
SIGNS = 38
#: Sentences of each book that are met in the first round; each round has so many times more than all before it.
FIRST, MORE = 96, 6
#: Cells of notes by texts that are worked on at once.
CELLS = 1 << 19
#: Notes of a large book that are worked on at once.
COLUMNS = 512


def _tops(note: np.ndarray, sentence: np.ndarray, bound: np.ndarray) -> tuple:
    """Of each pair the highest bound."""
    by = np.lexsort((-bound, sentence, note))
    note, sentence, bound = note[by], sentence[by], bound[by]
    top = np.r_[True, (note[1:] != note[:-1]) | (sentence[1:] != sentence[:-1])]
    return note[top], sentence[top], bound[top]


def _ones(v: np.ndarray) -> np.ndarray:
    """Bits that are set; of two bytes by each byte, which is several times faster."""
    if v.itemsize != 2:
        return np.bitwise_count(v).view(np.int8)
    c = np.bitwise_count(v.view(np.uint8)).view(np.uint16)
    c += c << 8
    c >>= 8
    return c.view(np.int16)


class Notes:
    """Notes of n words, with the sentences of their books: each keeps the best it has met."""

    def __init__(self, notes: list[str], book: np.ndarray, sentences: list[str], home: np.ndarray, best: int, least: float):
        """book, home: of each note and each sentence; the sentences of a book stand together, in the order that decides between equals."""
        self.notes, self.bones, self.book, self.home = notes, [skeleton(x) for x in notes], book, home
        self.best, self.least, self.starts = best, least, Starts(sentences)
        self.found: list[list[tuple]] = [[] for _ in notes]
        self.floor = np.full(len(notes), least - ROUNDING)  # what a later sentence must reach
        self.tie = np.full(len(notes), len(sentences))  # as good as the last of the best is enough before this sentence
        self.n = len(notes[0].split(" ")) if notes else 1
        self.widths, *self.lengths = self.starts.lengths(self.n)
        self.codes = [ALPHABET[c] for c in self.starts.codes]
        self.sentence = np.repeat(np.arange(len(sentences)), self.starts.stops - self.starts.begins)
        self.tables = []
        for texts in (notes, self.bones):
            t = np.zeros((len(texts), SIGNS), np.uint64)
            for i, x in enumerate(texts):
                for k, c in enumerate(x.encode()):
                    t[i, ALPHABET[c]] |= np.uint64(1 << k)
            self.tables.append(t)
        self.padded = [_padded(texts)[0] for texts in (notes, self.bones)]
        self.sizes = [np.array([len(x) for x in texts], np.int64) for texts in (notes, self.bones)]

    def meet(self) -> None:
        """All notes meet all sentences of their books, a stretch of each book's sentences at a time."""
        first = np.searchsorted(self.home, self.home)
        place = np.arange(len(self.home)) - first
        lo, hi, most = 0, FIRST, int(place.max(initial=-1)) + 1
        self.open: tuple | None = None
        while lo < most:
            self._round((place >= lo) & (place < hi), hi >= most)
            lo, hi = hi, hi * MORE

    def _round(self, now: np.ndarray, last: bool) -> None:
        """Before the last round only the most promising are scored; the others wait until more is found."""
        per_book = np.bincount(self.book, minlength=int(self.home.max(initial=0)) + 1)
        parts = [self.open] if self.open else []
        for kind in (0, 1):
            # books with like numbers of notes go together, so that few columns stay empty
            rows = np.flatnonzero(now[self.sentence])
            rows = rows[per_book[self.home[self.sentence[rows]]] > 0]
            step = np.ceil(np.log2(per_book[self.home[self.sentence[rows]]]) * 2)
            for s in np.unique(step):
                parts += self._sweep(kind, rows[step == s])
        if not parts:
            return
        note, sentence, bound = (np.concatenate(x) for x in zip(*parts, strict=True))
        may = bound >= np.where(sentence < self.tie[note], self.floor[note] - 2 * ROUNDING, self.floor[note])
        note, sentence, bound = note[may], sentence[may], bound[may]
        if not len(note):
            self.open = None
            return
        note, sentence, bound = _tops(note, sentence, bound)
        by = np.lexsort((sentence, -bound, note))
        note, sentence, bound = note[by], sentence[by], bound[by]
        size = self.best + 1
        while len(note):
            rank = np.arange(len(note)) - np.searchsorted(note, note)
            now = rank < size
            for lo in range(0, int(now.sum()), 20_000):
                few = np.flatnonzero(now)[lo : lo + 20_000]
                self._score(note[few], sentence[few])
            note, sentence, bound = note[~now], sentence[~now], bound[~now]
            may = bound >= np.where(sentence < self.tie[note], self.floor[note] - 2 * ROUNDING, self.floor[note])
            note, sentence, bound = note[may], sentence[may], bound[may]
            size *= 2
            if not last and size > 4 * self.best + 4:
                break
        self.open = (note, sentence, bound)

    def _sweep(self, kind: int, rows: np.ndarray) -> list[tuple]:
        """(note, sentence, bound) of what may be good enough, over the windows that start at rows."""
        out = []
        home = self.home[self.sentence[rows]]
        books, here = np.unique(home, return_inverse=True)
        mine = np.flatnonzero(np.isin(self.book, books))
        size = self.sizes[kind][mine]
        groups = [mine[(size > lo) & (size <= hi)] for lo, hi in ((0, 8), (8, 16), (16, 32), (32, 64))]
        if len(books) == 1:  # notes of like sizes go together: they look as far into a text
            groups = [part for few in groups for part in np.array_split(few[np.argsort(self.sizes[kind][few], kind="stable")], -(-len(few) // COLUMNS) or 1)]
        for few in groups:
            if len(few):
                bits = next(x for x in (8, 16, 32, 64) if self.sizes[kind][few].max() <= x)
                few = few[np.argsort(self.book[few], kind="stable")]
                of = np.searchsorted(books, self.book[few])
                held = np.bincount(of, minlength=len(books))
                slot = np.arange(len(few)) - (np.cumsum(held) - held)[of]
                grid = np.full((len(books), int(held.max())), -1)
                grid[of, slot] = few
                own = held[here] > 0
                out += self._walk(kind, rows[own], here[own], grid, np.dtype(f"u{bits // 8}"))
        return out

    def _walk(self, kind: int, rows: np.ndarray, here: np.ndarray, grid: np.ndarray, dtype: np.dtype) -> list[tuple]:
        """grid: the notes of each book. Bit-parallel longest common subsequences of a row's notes (its columns) with all that texts begin with."""
        size = np.where(grid < 0, 0, self.sizes[kind][grid])
        floor = np.where(grid < 0, 9.0, self.floor[grid])
        wide = min(WIDEST, int((size * (2 / np.maximum(floor, 1e-6) - 1) + 1e-6).max(initial=0)))  # longer ones score less
        least = int(np.ceil(np.where(grid < 0, WIDEST, size * floor / (2 - floor)).min() - 1e-6))  # and so do shorter ones
        length = self.lengths[kind][rows]
        length = np.where((length <= wide) & (length >= least), length, 0)
        keep = length.max(axis=1) > 0
        rows, here, length = rows[keep], here[keep], length[keep]
        if not len(rows):
            return []
        longest = length.max(axis=1)
        wide = int(longest.max())
        place = np.arange(wide)
        texts = np.empty((len(rows), wide), np.uint8)
        for lo in range(0, len(rows), 1 << 14):
            x = slice(lo, lo + (1 << 14))
            texts[x] = self.codes[kind][np.minimum(self.starts.ends[kind][rows[x]][:, None] + place, len(self.codes[kind]) - 1)] * (place < longest[x, None])
        keys = np.concatenate([here.astype(">u4")[:, None].view(np.uint8), texts], axis=1)
        by = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
        texts, here, rows, length, longest = texts[by], here[by], rows[by], length[by], longest[by]
        differs = texts[1:] != texts[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
        same = np.r_[0, np.where(here[1:] != here[:-1], 0, same)]
        ends = np.zeros((len(rows), wide + 1), bool)
        for c in range(length.shape[1]):
            ends[np.arange(len(rows)), np.maximum(length[:, c], 0)] = True
        # a letter's places in each note of each book; what a note may lack for each length of a window
        table = np.where(grid[:, None, :] < 0, 0, self.tables[kind][grid].transpose(0, 2, 1)).astype(dtype).reshape(-1, grid.shape[1])
        full = np.where(size > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(size, 1).astype(np.uint64)), np.uint64(0)).astype(dtype)
        total = size[:, None, :] + np.arange(wide + 1)[:, None]
        lack = np.floor(size[:, None, :] - floor[:, None, :] * total / 2 + 1e-9)
        lack = np.where(grid[:, None, :] < 0, -1, np.clip(lack, -1, 64)).astype(np.int16 if dtype.itemsize == 2 else np.int8).reshape(-1, grid.shape[1])
        out = []
        many = max(32, CELLS // (grid.shape[1] * dtype.itemsize))
        for lo in range(0, len(rows), many):
            x = slice(lo, lo + many)
            out += self._levels(texts[x], here[x], rows[x], longest[x], np.r_[0, same[lo + 1 : lo + many]], ends[x], table, full, lack.reshape(len(grid), wide + 1, -1), grid, size)
            if len(out) > 1 and sum(len(y[0]) for y in out) > 1 << 19:
                out = [_tops(*(np.concatenate(y) for y in zip(*out, strict=True)))]
        return out

    def _levels(self, texts, here, rows, longest, same, ends, table, full, lack, grid, size) -> list[tuple]:  # noqa: ANN001
        out = []
        node, v = here, full  # before the first letter
        for j in range(int(longest.max())):
            new = (same <= j) & (longest > j)
            at = np.flatnonzero(new)
            if len(at):
                v = v.take(node[at], axis=0)
                u = table.take(here[at] * SIGNS + texts[at, j], axis=0)
                u &= v
                w = v - u
                v += u
                v |= w
            node = np.cumsum(new) - 1
            end = np.flatnonzero(ends[:, j + 1])
            if not len(end):
                continue
            first = np.flatnonzero(np.r_[True, node[end[1:]] != node[end[:-1]]])
            one = end[first]
            left = v.take(node[one], axis=0)
            left &= full if len(grid) == 1 else full[here[one]]
            left = _ones(left)
            hit = np.flatnonzero(left <= (lack[0, j + 1] if len(grid) == 1 else lack[here[one], j + 1]))
            if len(hit):
                which, slot = np.divmod(hit, left.shape[1])
                lacks = left.ravel()[hit].astype(np.int64)
                times = np.diff(np.r_[first, len(end)])[which]
                row = end[np.repeat(first[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                s = size[here[one[which]], slot]
                bound = 2.0 * (s - lacks) / (s + j + 1)
                out.append((np.repeat(grid[here[one[which]], slot], times), self.sentence[rows[row]], np.repeat(bound, times)))
        return out

    def _bounds(self, kind: int, note: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """As _bounds does, of a row's note with the windows from the row's start."""
        length = self.lengths[kind][rows]
        longest = np.minimum(length.max(axis=1), WIDEST)
        by = np.argsort(-longest, kind="stable")
        going = len(by) - np.searchsorted(longest[by][::-1], np.arange(int(longest.max(initial=0))), side="right")
        at, mine = self.starts.ends[kind][rows[by]], note[by] * SIGNS
        size = self.sizes[kind][note]
        full = np.where(size > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(size, 1).astype(np.uint64)), np.uint64(0))[by]
        left = np.zeros((len(going) + 1, len(by)), np.uint8)
        left[0] = size[by]
        table, v = self.tables[kind].ravel(), full.copy()
        for j, n in enumerate(going):
            v = v[:n]
            u = v & table[mine[:n] + self.codes[kind][at[:n] + j]]
            v = (v + u) | (v - u)
            left[j + 1, :n] = np.bitwise_count(v & full[:n])
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        common = size[:, None] - left[np.clip(length, 0, len(going)), back[:, None]].astype(np.int64)
        common = np.where(length > len(going), np.minimum(size[:, None], length), common)
        total = size[:, None] + length
        return np.where(length < 0, -1.0, np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0))

    def _exact(self, kind: int, note: np.ndarray, rows: np.ndarray, c: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
        """Ratios of notes with the windows of width c from rows on; where they are below need, they may come out lower yet."""
        size, length = self.sizes[kind][note], self.lengths[kind][rows, c]
        out = np.empty(len(note))
        order = np.argsort(length, kind="stable")  # short and long ones apart: every text is as wide as the longest beside it
        stop = int(np.searchsorted(length[order], LONG))
        for lo in range(0, stop, PAIRS):
            x = order[lo : min(lo + PAIRS, stop)]
            place = np.arange(int(length[x].max()))
            texts = self.starts.codes[kind][np.minimum(self.starts.ends[kind][rows[x]][:, None] + place, len(self.starts.codes[kind]) - 1)] * (place < length[x][:, None])
            total = size[x] + length[x]
            m = _matched(self.padded[kind][note[x], : max(1, int(size[x].max()))], size[x], texts, length[x], None if need is None else np.ceil(need[x] * total / 2 - 1e-6))
            out[x] = np.where(total > 0, 2.0 * m / np.maximum(total, 1), 1.0)
        for x in order[stop:].tolist():
            text = self.starts.window(rows[x], self.widths[c[x]])
            out[x] = SequenceMatcher(None, *((self.bones[note[x]], skeleton(text)) if kind else (self.notes[note[x]], text))).ratio()
        return out

    def _score(self, note: np.ndarray, sentence: np.ndarray) -> None:
        """Exact scores of pairs, as in best_of_block."""
        begin, count = self.starts.begins[sentence], (self.starts.stops - self.starts.begins)[sentence]
        offset = np.cumsum(count) - count
        pair = np.repeat(np.arange(len(note)), count)
        rows = np.arange(count.sum()) - offset[pair] + begin[pair]
        whole, thin = self._bounds(0, note[pair], rows), self._bounds(1, note[pair], rows)
        need = np.where(sentence < self.tie[note], self.floor[note] - 2 * ROUNDING, self.floor[note])
        # where a bound is high enough it is made exact; most sentences go by that
        for kind, bound in enumerate((whole, thin)):
            r, c = np.nonzero(bound >= need[pair][:, None])
            bound[r, c] = self._exact(kind, note[pair[r]], rows[r], c, need[pair[r]] if kind else None)
        either = np.maximum(whole, thin)
        left = np.flatnonzero(np.maximum.reduceat(either.max(axis=1), offset) >= need)
        if not len(left):
            return
        on = np.isin(pair, left)
        rows, whole, either = rows[on], whole[on], either[on]
        note, sentence, need, count = note[left], sentence[left], need[left], count[left]
        pair = np.repeat(np.arange(len(note)), count)
        # the nearest window must be one of those that score enough: others, by their bounds, until one is nearer
        enough = either >= need[pair][:, None]
        r, c = np.nonzero(enough)
        score, near = self._exact(0, note[pair[r]], rows[r], c), np.full(len(note), -1.0)
        np.maximum.at(near, pair[r], score)
        held = [(r, c, score)]
        r, c = np.nonzero((whole >= near[pair][:, None] - 1e-12) & ~enough)
        by = np.lexsort((-whole[r, c], pair[r]))
        r, c, size = r[by], c[by], 3
        while len(r):
            now = np.arange(len(r)) - np.searchsorted(pair[r], pair[r]) < size
            score = self._exact(0, note[pair[r[now]]], rows[r[now]], c[now])
            held.append((r[now], c[now], score))
            near[pair[r[now]][score > near[pair[r[now]]]]] = 9.0  # the sentence is out
            later = ~now & (near[pair[r]] < 9)
            r, c, size = r[later], c[later], size * 3
        r, c, score = (np.concatenate(x) for x in zip(*held, strict=True))
        r, c, score = (x[near[pair[r]] < 9] for x in (r, c, score))
        if not len(r):
            return
        whose = pair[r]
        lead = np.lexsort((r, c, -score, whose))  # equals are taken by width, then place
        lead = lead[np.r_[True, whose[lead[1:]] != whose[lead[:-1]]]]
        thin = self._exact(1, note[whose[lead]], rows[r[lead]], c[lead])
        for k, x, y in zip(lead.tolist(), score[lead].tolist(), thin.tolist(), strict=True):
            mark = round(max(x, y), 4)
            if mark >= self.least:
                i = int(note[whose[k]])
                own = self.found[i]
                own.append((mark, int(sentence[whose[k]]), self.starts.window(rows[r[k]], self.widths[c[k]])))
                if len(own) >= self.best:
                    own.sort(key=lambda z: (-z[0], z[1]))
                    del own[self.best :]
                    self.floor[i], self.tie[i] = own[-1][0] + 0.8 * ROUNDING, own[-1][1]


def best_of_books(asked: list[tuple], held: list[tuple], best: int, least: float) -> list[tuple]:
    """The ``best`` sentences of each note's book: (place in asked, score, place in held, window).

    asked: (book, note), notes of as many words each; held: (book, id, sentence)."""
    books = {b: i for i, b in enumerate(dict.fromkeys(x[0] for x in held))}
    order = sorted(range(len(held)), key=lambda k: (books[held[k][0]], held[k][1]))
    which: dict[tuple, list[int]] = {}
    for i, (b, x) in enumerate(asked):
        if b in books:
            which.setdefault((b, x), []).append(i)
    out = []
    plain = [k for k in which if len(k[1]) <= 64 and skeleton(k[1])]
    if plain:
        notes = Notes([x for _, x in plain], np.array([books[b] for b, _ in plain]), [held[k][2] for k in order], np.array([books[held[k][0]] for k in order]), best, least)
        notes.meet()
        for k, found in zip(plain, notes.found, strict=True):
            out += [(i, score, order[s], window) for i in which[k] for score, s, window in found]
    blocks: dict = {}
    for b, x in which.keys() - set(plain):  # notes longer than a machine word, or of vowels alone
        if b not in blocks:
            mine = [k for k in order if held[k][0] == b]
            blocks[b] = Starts([held[k][2] for k in mine]), [(held[k][1], k) for k in mine]
        out += [(i, score, k, window) for score, (_, k), window in best_of_block(x, *blocks[b], best, least) for i in which[b, x]]
    return out


# Where sentences end for this comparison; a full stop only before a new sentence.
SENTENCE_END = r"[।!?॥]+|(?<=\.)\s+(?=[A-Zऀ-ॿ])"


def _sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def phrase_matches(notes: DataFrame, passages: DataFrame, keys: list[str], best: int = 3, least: float = 0.55, note_block: int = 1024, sentence_block: int = 32768) -> DataFrame:
    """Sentences that sound like a reviewer's romanised note: keys, note_id, rank,
    passage_id, sentence_no, window, score (4 places).

    notes: keys, note_id, note. passages: keys, passage_id, text. Every note meets every
    sentence of its keys. The window of a sentence is the one nearest by matching blocks,
    its score the better one of whole strings and of consonants. A note that tells of the
    sign for abbreviations takes a sentence that holds the two at 1.0. Equal scores go by
    passage_id and sentence_no; repeated rows count once; nulls and notes without a Latin
    letter or digit have no row."""
    q = notes.where("note is not null").select(*keys, "note_id", roman_note(F.col("note")).alias("q"), F.lower("note").contains("shunya").alias("sign")).distinct()
    s = passages.where("passage_id is not null").select(*keys, "passage_id", F.posexplode(_sentences(F.col("text"))).alias("sentence_no", "s"))
    s = s.select(*keys, "passage_id", "sentence_no", roman_note(romanize(nfc_devanagari(F.col("s")))).alias("c")).distinct()
    # a block holds notes of as many words, for which the windows are laid out once
    q, s = cut(q.withColumn("w", F.size(F.split("q", " ")))).where("q <> ''"), cut(s).where("c <> ''")  # a filter before the cut would romanise twice
    n = q.groupBy(*keys, F.col("w").alias("v")).agg(F.count("*").alias("nq")).join(s.groupBy(*keys).agg(F.count("*").alias("ns")), keys)
    n = n.withColumn("bq", F.ceil(F.col("nq") / note_block).cast("int")).withColumn("bs", F.ceil(F.col("ns") / sentence_block).cast("int"))
    small = F.col("bq") * F.col("bs") == 1
    sizes = n.groupBy("v").agg(F.sum(F.when(small, F.col("ns"))), F.sum(F.when(small, F.col("nq"))), F.sum(F.when(~small, F.col("bq") * F.col("bs"))))
    held, asked, own, lengths = sizes.toDF("v", "held", "asked", "own").agg(F.max("held"), F.max("asked"), F.sum("own"), F.count("*")).first()
    # books of one block share it with others
    shared = max(1, -(-(held or 0) // SHARED), -(-(asked or 0) // note_block))
    book = F.xxhash64(*keys)
    blocks = n.select(*keys, "v", F.when(small, F.pmod(book, F.lit(shared))).otherwise(book).alias("g"), F.col("bq").alias("nq"), F.col("bs").alias("ns"))
    to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, *by: F.pmod(F.xxhash64(*by), F.col(c)).cast("int")
    q_in = q.join(blocks.withColumnRenamed("v", "w"), [*keys, "w"]).select(*keys, "w", "g", part("nq", "q").alias("bq"), to("ns").alias("bs"), "note_id", "q")
    s_in = s.join(blocks, keys).select(*keys, F.col("v").alias("w"), F.col("g").alias("g"), to("nq").alias("bq"), part("ns", "passage_id", "sentence_no").alias("bs"), "passage_id", "sentence_no", "c")
    kinds = ", ".join(f"`{k}` {notes.schema[k].dataType.simpleString()}" for k in keys)

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        a = list(asked[[*keys, "note_id", "q"]].itertuples(index=False, name=None))
        h = list(held[[*keys, "passage_id", "sentence_no", "c"]].itertuples(index=False, name=None))
        k = len(keys)
        got = best_of_books([(x[:k], x[-1]) for x in a], [(x[:k], x[k:-1], x[-1]) for x in h], best, least) if a and h else []
        rows = [(*a[i][:-1], *h[j][k:-1], window, score) for i, score, j, window in got]
        return pd.DataFrame(rows, columns=[*keys, "note_id", "passage_id", "sentence_no", "window", "score"])

    by = ["w", "g", "bq", "bs"]
    # little data and much work: the partitions are counted by blocks, which keeps them from being joined by size
    tasks = min(2000, 2 * (shared * max(1, min(lengths, 16)) + (own or 0)))
    got = q_in.repartition(tasks, *by).groupBy(*by).cogroup(s_in.repartition(tasks, *by).groupBy(*by)).applyInPandas(meet, f"{kinds}, note_id string, {RESULT}")
    got = got.unionByName(_abbreviations(q.where("sign").select(*keys, "note_id"), passages, keys))
    got = got.groupBy(*keys, "note_id", "passage_id", "sentence_no").agg(F.max_by(F.struct("window", "score"), "score").alias("m")).select("*", "m.window", "m.score").drop("m")
    # the group limit of this window keeps ``best`` rows a note in each task before anything is shuffled
    order = Window.partitionBy(*keys, "note_id").orderBy(F.desc("score"), "passage_id", "sentence_no")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select(*keys, "note_id", "rank", "passage_id", "sentence_no", "window", "score")


# The two halves of the abbreviation and how it is shown.
FIRST_HALF, SECOND_HALF, ABBREVIATION = "बी[०0.]", "ए[०0.]", "बी० ए०"


def _abbreviations(signs: DataFrame, passages: DataFrame, keys: list[str]) -> DataFrame:
    both = lambda c: c.rlike(FIRST_HALF) & c.rlike(SECOND_HALF)
    s = passages.where(both(F.col("text"))).select(*keys, "passage_id", F.posexplode(_sentences(F.col("text"))).alias("sentence_no", "s")).where(both(F.col("s")))
    s = s.groupBy(*keys, "passage_id").agg(F.min("sentence_no").alias("sentence_no"))
    return signs.join(s, keys).select(*keys, "note_id", "passage_id", "sentence_no", F.lit(ABBREVIATION).alias("window"), F.lit(1.0).alias("score"))


def single_match(matches: DataFrame, keys: list[str], score: Column | None = None) -> DataFrame:
    """Of each group's matches the one there is, if it is the only one and exact (score 1);
    groups with several, none or only likely matches have no row."""
    score = F.col("score") if score is None else score
    one = matches.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(score.alias("_s"), *[c for c in matches.columns if c not in keys])).alias("_m"))
    return one.where("_n = 1 and _m._s = 1").select(*keys, *[F.col(f"_m.{c}").alias(c) for c in matches.columns if c not in keys])
