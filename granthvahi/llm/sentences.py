"""Sentence boundaries across languages and scripts (problem 3).

A hidden-event n-gram model: between two words lies an event, boundary or none, and the
n-gram holds it: ``word boundary next`` against ``word next``. Line ends are sure
boundaries and starts of lines sure starts; all other events are hidden.

* After a word with a full stop the event's odds are how often that word stands at line
  ends, as a share of how often sentences end there, times how much likelier the next
  word is as a sentence's first than behind this word inside a sentence (bigram counts,
  less what boundaries explain of them, backed off to the word's own).
* End marks are words with learnt odds: for each mark, expectation maximisation finds
  what share of its occurrences inside lines is followed by words as they begin lines.
* Lines without marks have a possible event between all words; in scripts without
  blanks between all characters, two before and one after being the words.

The places of a line are a chain; forward-backward gives the posterior of each,
neighbours holding each other in check: a sentence of a word or two is unlikely.

Counts cover the whole corpus and stay tables: rows are cut into blocks, and each block
is joined with the counts of just the words it asks for, so no task holds a model that
grows with the corpus and nothing is hashed into shared buckets.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lookalikes import TO_LATIN, normal_form

# Kinds of counts: first word of a line; word inside a sentence; mark inside a line and the word after it; word with a
# stop at a line's end, inside a line, and there with the word after it; plain words before an end, all, and in pairs;
# how many different words follow a word with a stop, a plain word.
FIRST, INSIDE, MARKED, ENDED, STOP, PAIR, BEFORE_END, SEEN, NEXT, PAIR_TYPES, NEXT_TYPES = range(11)
#: What a mark not seen often is thought to be: its share of boundaries.
PRIOR = {"|": 0.8, "...": 0.05}
#: Log odds beyond which the next word can't turn a mark's event.
SETTLED = 6.0

SURE = "।॥?!؟۔。！？｡"
CLUSTER = re.compile(f"[{SURE}.…|]+")
CLOSERS = "\"'”’»)]」』›）］"
OPENERS = "\"'“‘«([「『‹（［„"
QUOTES_OPEN, QUOTES_CLOSE = "\"'“‘«「『‹„", "\"'”’»」』›"
AFTER = re.compile(r"\s*[(\[（][\s\d.,:/-]+[)\]）]")
VERSE = re.compile(r"\s*[\d]+\s*[॥।|]+")
EDGES = re.compile(f"^[{re.escape(OPENERS)}]+|[{re.escape(CLOSERS)},;:]+$")
NUMBER = re.compile(r"^[\d.,:/-]*\d[\d.,:/-]*$")
LETTER = re.compile(r"[^\W\d_]")
FOREIGN_LETTER = re.compile("[\\u0370-\\u03ff\\u0400-\\u052f]")
_TWINS = str.maketrans(TO_LATIN)
STOPS = frozenset(SURE + ".…|")


@functools.lru_cache(200_000)
def _plain(word: str) -> str:
    """The form a word is counted in: without quotes and brackets, numbers as one."""
    w = word
    if not w.isascii():
        w = normal_form(w)
        if FOREIGN_LETTER.search(w):
            w = w.translate(_TWINS)
    w = EDGES.sub("", w)
    if w.endswith(".") and w[-2:-1] in CLOSERS:
        return "<)>."
    if NUMBER.match(w):
        return "<n>." if w.endswith(".") else "<n>"
    return w


def mark_of(cluster: str) -> str:
    """The mark that a run of end marks counts as: its first sure one, a bar, a stop, or dots."""
    for c in cluster:
        if c in SURE:
            return c
    return "|" if "|" in cluster else "." if cluster == "." else "..."


HAN = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")


#: A character of a script without blanks behind another: what goes on inside a sentence.
HAN_NEXT = re.compile("(?<=[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff])[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
#: A full stop with no blank after it; what no sentence begins with.
NO_START = "".join(c for c in CLOSERS if c not in OPENERS) + ",;:،、，；："


TIGHT = re.compile(r"(?<=[^\s.])\.(?=[^\s.\d,;:])")


def _behind(line: str, at: int) -> int:
    """The place behind an end mark's closing quotes and brackets, numbers of verses and blanks."""
    while at < len(line) and line[at] in CLOSERS and line[at] not in OPENERS:
        at += 1
    tail = AFTER.match(line, at) or VERSE.match(line, at)
    at = tail.end() if tail else at
    while at < len(line) and line[at].isspace():
        at += 1
    return at


def units(line: str) -> list[tuple[int, str, str]]:
    """(place, word before, word after) of every gap of a line: between words, and inside
    words of scripts without blanks between characters, of which two before and one after count as words."""
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", line)]
    out = []
    for k, (at, w) in enumerate(words):
        if k:
            out.append((at, _last(words[k - 1][1]), _head(w)))
        if HAN.search(w):
            out += [(at + i, w[max(0, i - 2) : i], w[i]) for i in range(1, len(w)) if HAN.match(w, i - 1) and HAN.match(w, i)]
    return out


@functools.lru_cache(200_000)
def _head(word: str) -> str:
    return word[:1] if HAN.match(word) else _plain(word)


def _last(word: str) -> str:
    return word[-2:] if HAN.match(word, len(word) - 1) else _plain(word)


def _plain_keys(part: str, keys: list[tuple[int, str, str]]) -> None:
    """Adds what counts of plain words: each, each pair, and the last before an end mark or a line's end."""
    tail = part.strip().rstrip(CLOSERS)
    if not tail or " " not in tail and not HAN.search(tail):
        return
    if HAN.search(part):
        gaps = units(part)
        keys += [(SEEN, a, "") for _, a, _ in gaps]
        keys += [(NEXT, a, b) for _, a, b in gaps]
        last = _last(tail.split()[-1])
        keys += [(BEFORE_END, last, ""), (SEEN, last, "")] if gaps else []
        return
    words = [_plain(w) for w in tail.split()]
    keys += zip(itertools.repeat(SEEN), words, itertools.repeat(""))
    keys += zip(itertools.repeat(NEXT), words, words[1:])
    keys.append((BEFORE_END, words[-1], ""))


def count_lines(texts: list[str], plain: list[tuple[int, str, str]] | None = None) -> Counter:
    """Counts by (kind, word, word after); what counts of plain words is added to the list ``plain``, if there is one."""
    got: Counter = Counter()
    inside: list[str] = []
    for text in texts:
        for line in text.split("\n"):
            words = line.split()
            if words and HAN.match(words[0]):
                got[FIRST, "", words[0][0]] += 1
            for m in CLUSTER.finditer(line):
                kind, d = mark_of(m[0]), _behind(line, m.end())
                # behind closing quotes stand the words that tell who spoke: they say nothing of the mark
                if kind != "." and d < len(line) and line[m.end()] not in CLOSERS and not CLUSTER.match(line, d) and line[d] not in NO_START:
                    got[MARKED, kind, _head(_word_after(line, d))] += 1
            if len(words) >= 3:
                if not HAN.match(words[0]):
                    got[FIRST, "", _plain(words[0])] += 1
                before = words[0]
                for w in words[1:]:
                    last = before[-1]
                    if last in CLOSERS:
                        last = before.rstrip(CLOSERS)[-1:]
                    if last not in STOPS:
                        inside.append(_head(w))
                    elif last == "." and not before.rstrip(CLOSERS).endswith(".."):
                        got[STOP, _plain(before), ""] += 1
                        got[PAIR, _plain(before), _head(w)] += 1
                    before = w
                if before.rstrip(CLOSERS).endswith("."):
                    got[ENDED, _plain(before), ""] += 1
            if not line.isascii():
                inside += HAN_NEXT.findall(line)
            for m in TIGHT.finditer(line) if "." in line else ():  # a stop without a blank after it
                a, b = _plain(_word_before(line, m.end())), _head(_word_after(line, m.end()))
                got[STOP, a, ""] += 0
                got[PAIR, a, b] += 0
            if plain is not None:
                for part in CLUSTER.split(line):
                    _plain_keys(part, plain)
    got.update(zip(itertools.repeat(INSIDE), itertools.repeat(""), inside))
    return got


#: A line without marks of fewer words (characters, where they are words) is one unit: a heading, an item.
LEAST_WORDS, LEAST_HAN, SHORTEST = 6, 12, 12


def _may_hold_two(line: str) -> bool:
    return len(line.split()) >= LEAST_WORDS or len(HAN.findall(line)) >= LEAST_HAN


def asked_of(text: str, counts: Counter, unpunctuated: bool) -> set[tuple[int, str, str]]:
    """The counts by which a text, of which ``counts`` are the own ones, is decided."""
    need: set[tuple[int, str, str]] = set()
    for kind, a, b in counts:
        if kind in (STOP, ENDED):
            need |= {(STOP, a, ""), (ENDED, a, ""), (PAIR_TYPES, a, "")}
        elif kind == PAIR:
            need |= {(PAIR, a, b), (FIRST, "", b), (INSIDE, "", b)}
        elif kind == MARKED:
            need |= {(FIRST, "", b), (INSIDE, "", b)}
    if unpunctuated:
        for line in text.split("\n"):
            if len(line) >= SHORTEST and not CLUSTER.search(line):
                for _, a, b in units(line) if _may_hold_two(line) else ():
                    need |= {(BEFORE_END, a, ""), (SEEN, a, ""), (NEXT_TYPES, a, ""), (NEXT, a, b), (FIRST, "", b), (INSIDE, "", b)}
    return need


#: So many occurrences of a pair say nothing: the place in question itself, its row delivered again and a copy.
OWN = 3.0


class HiddenEvents:
    """Log odds of events from counts by (kind, word, word after). FIRST holds what is
    expected to begin sentences: lines' first words and those after marks, by their odds."""

    def __init__(self, counts: dict, totals: dict[int, float], marks: dict[str, float]):
        self.counts, self.totals, self.marks = counts, totals, marks
        ended, stops = totals.get(ENDED, 0.0), totals.get(STOP, 0.0)
        self.share = min(max(ended / (ended + stops + 1.0), 0.05), 0.95)
        # words and characters as words are counted apart: a line has many more of the latter
        self.start, self.inside = ({False: totals.get(k, 0.0) + 1.0, True: totals.get(-1 - k, 0.0) + 1.0} for k in (FIRST, INSIDE))
        self.ends = min(max((totals.get(BEFORE_END, 0.0) + 1.0) / (totals.get(SEEN, 0.0) + 10.0), 0.001), 0.5)

    def count(self, kind: int, a: str, b: str = "") -> float:
        return float(self.counts.get((kind, a, b), 0.0))

    def chance(self, word: str) -> float:
        """Probability that a sentence ends behind ``word``, which has a full stop."""
        e, i = self.count(ENDED, word), self.count(STOP, word)
        n = len(LETTER.findall(word))
        guess, held = (0.95, 8.0) if word == "<)>." else (0.05, 3.0) if n <= 1 else (0.4, 3.0) if n <= 3 else (0.85, 8.0 if n > 4 else 3.0)
        # words that end sentences stand at line ends as often as sentences do
        p = (e + held * self.share * guess) / (e + i + held) / self.share
        return min(max(p, 0.002), 0.995)

    def begins(self, word: str) -> float:
        start = self.start[bool(HAN.match(word))]
        return (self.count(FIRST, "", word) + 0.5) / (start + 0.5)

    def goes_on(self, word: str) -> float:
        han = bool(HAN.match(word))
        return (self.count(INSIDE, "", word) + 0.5 * self.inside[han] / self.start[han]) / (self.inside[han] + 0.5)

    def before(self, word: str) -> float:
        """Log odds that ``word`` begins a sentence, against what all words do."""
        return min(max(math.log(self.begins(word) / self.goes_on(word)), -4.0), 4.0)

    def stop(self, left: str, right: str) -> float:
        """Log odds of ``left. boundary right`` against ``left. right``."""
        a, b = _plain(left), _head(right)
        p = self.chance(a)
        first, on = self.begins(b), self.goes_on(b)
        # of the pairs seen, those that boundaries don't explain speak for running on
        alone = max(self.count(PAIR, a, b) - OWN, 0.0) * (1.0 - p * first / (p * first + (1.0 - p) * on))
        held = 2.0 + self.count(PAIR_TYPES, a)  # the more words have followed, the likelier a new one
        behind = (alone + held * on) / (max(self.count(STOP, a) - OWN, 0.0) * (1.0 - p) + held)
        return math.log(p / (1 - p)) + min(max(math.log(first / behind), -4.0), 4.0)

    def mark(self, mark: str, right: str) -> float:
        """Log odds of ``mark boundary right`` against ``mark right``."""
        got = self.marks.get(mark)
        if got is None:
            p = PRIOR.get(mark, 0.95)
            got = math.log(p / (1 - p))
        return got if abs(got) >= SETTLED else got + self.before(_head(right))

    def plain(self, a: str, b: str) -> float:
        """Log odds of ``a boundary b`` against ``a b`` where nothing marks it."""
        n = self.count(SEEN, a)
        p = min(max((self.count(BEFORE_END, a) + 4.0 * self.ends) / (n + 4.0), 0.0005), 0.98)
        held = 2.0 + self.count(NEXT_TYPES, a)
        behind = (max(self.count(NEXT, a, b) - OWN, 0.0) + held * self.goes_on(b)) / (max(n - OWN, 0.0) * (1.0 - p) + held)
        return math.log(p / (1 - p)) + min(max(math.log(self.begins(b) / behind), -5.0), 5.0)


def share_of_boundaries(bins: list[tuple[float, float]], prior: float, rounds: int = 60) -> float:
    """Of a mark's occurrences the share with a boundary behind it, by expectation
    maximisation. bins: (log of how much likelier the next words begin sentences than go on, number)."""
    p = prior
    for _ in range(rounds):
        hit = sum(n * p / (p + (1.0 - p) * math.exp(-x)) for x, n in bins)
        p = min(max((hit + 2.0 * prior) / (sum(n for _, n in bins) + 2.0), 0.0005), 0.9997)
    return p


def posteriors(odds: list[float], gaps: list[int]) -> list[float]:
    """Probability of a boundary at each place of a chain, by forward-backward.

    odds: the log odds of each place by itself; gaps[i]: words between place i - 1
    and place i. Two boundaries with a word or two between them are unlikely."""
    if len(odds) == 1:
        return [1.0 / (1.0 + math.exp(-odds[0]))]
    link = [0.0] + [math.exp(-3.0) if g <= 1 else math.exp(-1.0) if g == 2 else 1.0 for g in gaps[1:]]
    on = [math.exp(min(max(o, -30.0), 30.0)) for o in odds]
    f = [(1.0, on[0])]
    for i in range(1, len(on)):
        a, b = f[-1]
        x, y = a + b, (a + b * link[i]) * on[i]
        f.append((x / (x + y), y / (x + y)))
    out, (x, y) = [0.0] * len(on), (1.0, 1.0)
    for i in range(len(on) - 1, -1, -1):
        a, b = f[i][0] * x, f[i][1] * y
        out[i] = b / (a + b)
        if i:
            x, y = x + on[i] * y, x + link[i] * on[i] * y
            t = x + y
            x, y = x / t, y / t
    return out


def _word_before(line: str, at: int) -> str:
    a = at
    while a > 0 and not line[a - 1].isspace():
        a -= 1
    return line[a:at]


def _word_after(line: str, at: int) -> str:
    b = at
    while b < len(line) and not line[b].isspace():
        b += 1
    return line[at:b]


def line_cuts(model: HiddenEvents, line: str, threshold: float = 0.5) -> list[int]:
    """Places inside a line at which a sentence begins (the first of the line left out)."""
    places: list[int] = []
    odds: list[float] = []
    begin = len(line) - len(line.lstrip())
    unit = begin  # where the sentence that is being read began, if all so far hold
    quote_done = -1
    for m in CLUSTER.finditer(line):
        a, b = m.start(), m.end()
        if a < unit:
            continue
        mark = m[0]
        c = b
        opened = line.count('"', 0, b) % 2 == 1
        while c < len(line) and line[c] in CLOSERS and (line[c] != '"' or opened):
            opened = opened and line[c] != '"'
            c += 1
        closers = line[b:c]
        sure = any(x in SURE for x in mark)
        tail = AFTER.match(line, c)
        if tail and (sure or mark[0] in ".|"):
            c = tail.end()
        elif ("।" in mark or "॥" in mark or "|" in mark) and (tail := VERSE.match(line, c)):
            c = tail.end()
        d = c
        while d < len(line) and line[d].isspace():
            d += 1
        if d >= len(line):
            break
        after = line[d]
        if after in CLOSERS and after not in OPENERS or after in ",;:،、，；：" or CLUSTER.match(line, d) and c == d:
            continue
        here = 0.0
        kind = mark_of(mark)
        if kind == ".":
            if c == b and d == b:  # no blank: inside a number or an abbreviation, or a blank was lost
                if not (after.isalpha() or after in OPENERS) or a == 0 or not (line[a - 1].isalpha() or line[a - 1] in CLOSERS or ord(line[a - 1]) > 0x300):
                    continue
                here -= 2.5
            word = _word_before(line, a)
            if NUMBER.match(word) and a - len(word) == begin:
                continue  # the number of a list's item
            here += model.stop(word + ".", _word_after(line, d))
        else:
            if kind == "|":
                before = line[:a].rstrip()[-1:]
                if not ("ऀ" <= before <= "෿" or before in CLOSERS):
                    continue
            here += model.mark(kind, _word_after(line, d))
            if kind == "..." and after.islower():  # a pause that mostly runs on
                here -= 2.0
        if closers and line[unit] in QUOTES_OPEN and any(x in QUOTES_CLOSE for x in closers):
            # the words that tell who spoke carry the quoted sentence on
            inner = line[unit + 1 : b]
            if not any(x in inner for x in (QUOTES_CLOSE.replace("'", "").replace("’", "") if line[unit] not in "'‘" else "’")):
                here = min(here, 8.0) - 16.0
        places.append(d)
        odds.append(here)
        if here > 0:
            unit = d
    if not places:
        return []
    words = [0] + [len(line[x:y].split()) for x, y in zip(places, places[1:], strict=False)]
    return [p for p, q in zip(places, posteriors(odds, words), strict=True) if q > threshold]


def unmarked_cuts(model: HiddenEvents, line: str, threshold: float = 0.5) -> list[int]:
    """As line_cuts for a line without marks: an event is possible in every gap."""
    gaps = units(line) if _may_hold_two(line) else []
    if not gaps:
        return []
    odds = [model.plain(a, b) for _, a, b in gaps]
    words = [0] + [max(1, (y - x + 1) // 2) if HAN.match(line, y) else 1 for (x, _, _), (y, _, _) in zip(gaps, gaps[1:], strict=False)]
    return [p for (p, _, _), q in zip(gaps, posteriors(odds, words), strict=True) if q > threshold]


def cuts(model: HiddenEvents, text: str, unpunctuated: bool = False) -> list[int]:
    """Place of the first character of every sentence but the first, in code points."""
    out, at, seen = [], 0, False
    for line in text.split("\n"):
        start = at + len(line) - len(line.lstrip())
        if line.strip():
            if seen:
                out.append(start)
            seen = True
            if unpunctuated and not CLUSTER.search(line):
                out += [at + x for x in unmarked_cuts(model, line)]
            elif CLUSTER.search(line):
                out += [at + x for x in line_cuts(model, line)]
        at += len(line) + 1
    return out


def _count_rows(unpunctuated: bool, most: int = 400_000):
    """Rows (block, kind, a, b, n): counts have block -1; what a block asks for has its block and n 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        asked: set[tuple] = set()
        plain: list[tuple[int, str, str]] | None = [] if unpunctuated else None

        def give() -> Iterator[pa.RecordBatch]:
            rows = [(-1, *k, n) for k, n in held.items() if n] + [(*k, 0) for k in asked]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "kind", "a", "b", "n"])
            held.clear()
            asked.clear()

        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = count_lines([text], plain)
                for k, n in own.items():
                    held[k] += n
                for k in asked_of(text, own, unpunctuated):
                    asked.add((block, *k))
                if plain and len(plain) > 50_000:
                    held.update(plain)
                    plain.clear()
            if len(held) + len(asked) > most:
                yield from give()
        held.update(plain or ())
        yield from give()

    return run


def _totals(counts: DataFrame) -> dict[int, float]:
    """Sums by kind, -1 - kind for those of characters as words: twice eleven at most."""
    kind = F.when(F.col("b").rlike(f"^{HAN.pattern}") & F.col("kind").isin(FIRST, INSIDE), -1 - F.col("kind")).otherwise(F.col("kind"))
    return {r["kind"]: float(r["n"]) for r in counts.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n")).collect()}


def _expected(counts: DataFrame, marks: dict[str, float]) -> Column:
    """What a row counts as a beginning of sentences: lines' first words in full, words after marks by the marks' shares."""
    share = F.lit(1.0)
    for m, x in marks.items():
        share = F.when((F.col("kind") == MARKED) & (F.col("a") == m), 1.0 / (1.0 + math.exp(-x))).otherwise(share)
    return F.when(F.col("kind").isin(FIRST, MARKED), F.col("n") * share).otherwise(0.0)


def _marks(counts: DataFrame, rounds: int = 3, width: float = 0.25) -> dict[str, float]:
    """Log odds of each mark, by expectation maximisation over marks' shares and over the
    words that begin sentences. The next words' likelihoods are gathered in bins, so at
    most marks x bins rows reach the driver, whatever the vocabulary."""
    counts = counts.where(F.col("kind").isin(FIRST, INSIDE, MARKED))
    inside = _totals(counts)
    on = F.when(F.col("kind") == INSIDE, F.col("n")).otherwise(0)
    marks: dict[str, float] = {m: -30.0 for m in [*SURE, "|", "..."]}  # first, lines' first words alone
    for _ in range(rounds):
        words = counts.groupBy("b").agg(F.sum(_expected(counts, marks)).alias("f"), F.sum(on).alias("i"))
        start = _totals(words.select(F.lit(FIRST).alias("kind"), "b", F.col("f").alias("n")))
        of = lambda t, k: F.when(F.col("b").rlike(f"^{HAN.pattern}"), t.get(-1 - k, 0.0) + 1.0).otherwise(t.get(k, 0.0) + 1.0)
        s, m = of(start, FIRST), of(inside, INSIDE)
        ratio = F.log((F.col("f") + 0.5) / (s + 0.5)) - F.log((F.col("i") + 0.5 * m / s) / (m + 0.5))
        near = F.coalesce(F.least(F.lit(4.0), F.greatest(F.lit(-4.0), ratio)), F.lit(0.0))
        met = counts.where(F.col("kind") == MARKED).select("a", "b", "n").join(words, "b", "left")
        bins: dict[str, list[tuple[float, float]]] = {}
        for r in met.groupBy("a", F.round(near / width).alias("x")).agg(F.sum("n").alias("n")).collect():
            bins.setdefault(r["a"], []).append((r["x"] * width, float(r["n"])))
        found = {mark: share_of_boundaries(b, PRIOR.get(mark, 0.95)) for mark, b in bins.items()}
        marks = {mark: math.log(p / (1 - p)) for mark, p in found.items()}
    return marks


def _cut_rows(part: pa.Table, model: HiddenEvents, unpunctuated: bool, sentences: bool) -> pa.Table:
    row, no, at, end, out = [], [], [], [], []
    for i, text in enumerate(part.column("_text").to_pylist()):
        got = cuts(model, text, unpunctuated)
        if sentences:
            first = len(text) - len(text.lstrip())
            for k, (x, y) in enumerate(zip([first, *got], [*got, len(text)], strict=True)):
                s = text[x:y].rstrip()
                if s:
                    row.append(i), no.append(k), at.append(x), end.append(x + len(s)), out.append(s)
        else:
            row += [i] * len(got)
            at += got
    keys = part.column("_key").take(pa.array(row, pa.int64()))
    if sentences:
        return pa.table({"_key": keys, "sentence": pa.array(no, pa.int64()), "start_at": pa.array(at, pa.int64()), "end_at": pa.array(end, pa.int64()), "sentence_text": pa.array(out, pa.string())})
    return pa.table({"_key": keys, "cut_at": pa.array(at, pa.int64())})


def _decided(rows: DataFrame, key: str, text: str, unpunctuated: bool, sentences: bool, block_rows: int, learn_from: DataFrame | None) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    held = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    blocks = max(1, -(-held.count() // block_rows))
    block: Column = F.pmod(F.xxhash64("_key"), F.lit(blocks))
    held = held.withColumn("_block", block.cast("bigint"))
    source = held.select("_block", "_text")
    if learn_from is not None:  # counts of other texts; what these ask for is still asked
        source = learn_from.where("text is not null").select(F.lit(-1).cast("bigint").alias("_block"), F.col("text").alias("_text"))
    raw = cut(source.mapInArrow(_count_rows(unpunctuated), "block bigint, kind int, a string, b string, n bigint"))
    counts = cut(raw.where("block = -1").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")))
    totals, marks = _totals(counts), _marks(counts)
    # what marks are expected to begin counts as firsts
    firsts = counts.where(F.col("kind").isin(FIRST, MARKED)).groupBy("b").agg(F.sum(_expected(counts, marks)).alias("n"))
    totals |= _totals(firsts.withColumn("kind", F.lit(FIRST)))
    known = counts.where(~F.col("kind").isin(FIRST, MARKED)).withColumn("n", F.col("n").cast("double"))
    types = counts.where(F.col("kind").isin(PAIR, NEXT)).groupBy(F.when(F.col("kind") == PAIR, PAIR_TYPES).otherwise(NEXT_TYPES).alias("kind"), "a")
    known = known.unionByName(types.agg(F.count("*").cast("double").alias("n")).select("kind", "a", F.lit("").alias("b"), "n"))
    known = known.unionByName(firsts.select(F.lit(FIRST).alias("kind"), F.lit("").alias("a"), "b", "n"))
    asked = raw.where("block >= 0") if learn_from is None else held.select("_block", "_text").mapInArrow(_count_rows(unpunctuated), raw.schema).where("block >= 0")
    words = asked.select(F.col("block").alias("_block"), "kind", "a", "b").distinct().join(known, ["kind", "a", "b"])

    def decide(texts: pa.Table, have: pa.Table) -> pa.Table:
        k, a, b, n = (have.column(c).to_pylist() for c in ("kind", "a", "b", "n"))
        return _cut_rows(texts, HiddenEvents(dict(zip(zip(k, a, b, strict=True), n, strict=True)), totals, marks), unpunctuated, sentences)

    schema = f"_key {kind}, " + ("sentence bigint, start_at bigint, end_at bigint, sentence_text string" if sentences else "cut_at bigint")
    # a task is a block or two, however many there are
    tasks = max(blocks, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held, words = held.repartition(tasks, "_block"), words.repartition(tasks, "_block")
    return held.groupBy("_block").cogroup(words.groupBy("_block")).applyInArrow(decide, schema).withColumnRenamed("_key", key)


def sentence_cuts(rows: DataFrame, key: str, text: str, unpunctuated: bool = False, block_rows: int = 20_000, learn_from: DataFrame | None = None) -> DataFrame:
    """key, cut_at of every sentence but a text's first. Null, empty and blank texts
    and texts of one sentence have no row; repeated rows count once; columns of
    other names are left behind. The model is learnt from these rows, or from the
    column text of ``learn_from``."""
    return _decided(rows, key, text, unpunctuated, False, block_rows, learn_from).distinct()


def sentence_units(rows: DataFrame, key: str, text: str, unpunctuated: bool = True, block_rows: int = 20_000, learn_from: DataFrame | None = None) -> DataFrame:
    """key, sentence (from 0), start_at, end_at, sentence_text: every text's sentences in
    order, those of lines without marks too unless ``unpunctuated`` is off."""
    return _decided(rows, key, text, unpunctuated, True, block_rows, learn_from)
