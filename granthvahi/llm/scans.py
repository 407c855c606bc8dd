"""Repair of text from scanned pages (problem 6).

What belongs to the page and not to the text (page numbers, running headers) is
found by its form, by the book's title and page, and by holding none of the words
that only running text has. Words broken at line ends are joined unless the
corpus knows the compound. Misread words are corrected by a noisy channel:

* A word that typed text doesn't have is a possible misreading of every word that
  character confusions lead to, however many letters are misread: confusable
  characters are of one class, and words that are the same up to classes meet in a join.
* How often each character is misread for which is estimated from the corpus itself, by
  expectation maximisation over the unknown words and what they may stand for.
* Every stretch of doubtful words with its neighbours is decoded by Viterbi: the
  channel's probabilities times the counts of words and of pairs of words.

Counts come from all typed text and stay tables: pages are cut into blocks, and a
block is joined with the counts of its own words and pairs only (pairs by 64-bit
digests), so no task holds a model that grows with the corpus.
"""

from __future__ import annotations

import difflib
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lookalikes import TO_LATIN, normal_form

# What the scanner reads (left) for what is printed (right).
CONFUSIONS = {
    "|": "ा ા", "ऱ": "र", "ब": "व", "ष": "प", "भ": "म", "ी": "ि", "थ": "य", "घ": "ध", "ढ": "ट", "૨": "ર", "ષ": "પ", "થ": "ય", "ભ": "મ", "ઘ": "ધ", "વ": "બ",
    "c": "e", "!": "i", "b": "h", "f": "t", "u": "n", "1": "l", "5": "s", "0": "o", "9": "g", "rn": "m", "प": "ष", "म": "भ", "व": "ब", "य": "थ",
}
#: A misreading's probability before any is estimated, as (seen, of so many printed).
PRIOR = (1.0, 50.0)
#: What a word not in the corpus weighs beside counts of words, and one with bars, exclamation marks or digits among its letters.
UNSEEN, ODD_UNSEEN = 0.02, 2e-6
ODD = re.compile(r"[|ऱ!]|(?<=[^\W\d_])\d|\d(?=[^\W\d_])")
#: Characters that no word holds between letters: their misreading needs no vocabulary.
ALIEN = re.compile(r"(?<=[ऀ-ॣॱ-ॿ઀-૥])\|(?=[ऀ-ॣॱ-ॿ઀-૥])|(?<=[઀-૥])૨|૨(?=[઀-૥])|(?<=[A-Za-zÀ-ɏ])[!1509](?=[a-zÀ-ɏ])")

#: Occurrences in a million words that make an original sure: of words with alien characters, of 5 letters or more, of 4, of fewer.
RATES = (0.0, 0.24, 0.64, 2.4)

DIGITS = "0-9०-९০-৯૦-૯௦-௯۰-۹٠-٩"
NUM = f"[{DIGITS}]{{1,4}}"
PAGE_LINE = re.compile(rf"^\s*(?:[\[(~–—|-]{{0,2}}\s*{NUM}\s*[\])~–—|.-]{{0,2}}|(?:पृष्ठ|पान|पाना|page|seite|p\.|પાનું|પૃષ્ઠ|পৃষ্ঠা|صفحہ|பக்கம்|ページ|第)\s*{NUM}\s*[页頁]?|[ivxlc]{{2,7}}|[IVXLC]{{2,7}})\s*$", re.I)
HEADER_FORMS = [
    (re.compile(r"^\[\s*(.+?)\s*\]$"), True), (re.compile(rf"^({NUM})\s*\|\s*(.+)$"), True), (re.compile(rf"^(.+?)\s*\)\s*\(\s*({NUM})\)?$"), True),
    (re.compile(rf"^({NUM})\s+(.+)$"), False), (re.compile(rf"^(.+?)\s+({NUM})$"), False),
]
PUNCTUATION = re.compile(r"[।॥?!؟۔。！？;:,،、，；：\"“”‘’…]|\.(?=\s|$)")
ITEM = re.compile(rf"^\s*(?:[-*•‣▪☐–·]|\(?[{DIGITS}]{{1,3}}[.)])\s+\S")
HYPHENS = "-\u2010\u2011\xac\xad"
CJK = re.compile("[぀-ヿ㐀-鿿]")
BETWEEN = r"\s।॥?؟۔,;:“”\"‘’'()\[\]…/،、，。！？；：「」—–=<>*~"
SPLIT = re.compile(rf"[{BETWEEN}]+|\.+|(?<![A-Za-z])!+|!+(?![a-zÀ-ɏ])")
WORDS = re.compile(rf"[^{BETWEEN}.]+")  # the same for lines without exclamation marks
END = re.compile(r"[।॥.?!؟۔。！？|…][\"”’)\]]*\s*$")
_TWINS = str.maketrans(TO_LATIN)
_TWIN = re.compile("[Ͱ-ϿЀ-ԯ]")


def plain(text: str) -> str:
    """Normal form, with the letters of other alphabets that look like Latin ones as Latin."""
    t = normal_form(text)
    return t if t.isascii() or not _TWIN.search(t) else t.translate(_TWINS)


def words_of(line: str) -> list[str]:
    if "!" in line:  # where the case of the next letter matters
        return [w.lower() for w in SPLIT.split(line) if w and not w.isdigit()]
    return [w for w in WORDS.findall(line.lower()) if not w.isdigit()]


def _classes() -> dict[str, str]:
    """Each confusable character with the one that stands for its class."""
    of: dict[str, str] = {}
    for seen, printed in CONFUSIONS.items():
        if len(seen) == 1:
            for p in printed.split():
                one, other = of.get(seen, seen), of.get(p, p)
                for c in [c for c, k in of.items() if k == other] + [p, seen]:
                    of[c] = one
    return of


CLASSES = _classes()


def shape(word: Column) -> Column:
    """The word with confusable characters as their classes: no misreading changes it."""
    classed = F.translate(word, "".join(CLASSES), "".join(CLASSES.values()))
    for seen, printed in CONFUSIONS.items():
        if len(seen) > 1:
            classed = F.replace(classed, F.lit(_classed(seen)), F.lit(_classed(printed)))
    return classed


def _classed(text: str) -> str:
    return "".join(CLASSES.get(c, c) for c in text)


def explain(word: str, original: str, chances: dict[tuple[str, str], float]) -> tuple[float, list[tuple[str, str]]] | None:
    """Log probability and misreadings by which ``original`` was read as ``word``; None if no confusions do."""
    latin = any(c.isascii() and c.isalpha() for c in word)
    best: dict[tuple[int, int], tuple[float, list[tuple[str, str]]]] = {(0, 0): (0.0, [])}  # by places in both: score, misreadings
    front = [(0, 0)]
    while front:
        later = []
        for i, j in sorted(set(front)):
            if i == len(word) or j == len(original):
                continue
            score, done = best[i, j]
            steps = [((i + 1, j + 1), 0.0, [])] if word[i] == original[j] else []
            for seen in (word[i], word[i : i + 2]):
                if original[j] in CONFUSIONS.get(seen, "").split() and (latin or seen not in "15059!"):
                    beside = word[i - 1 : i] or word[i + 1 : i + 2]
                    if seen != "|" or ("ऀ" <= beside <= "ॿ" if original[j] == "ा" else "઀" <= beside <= "૿"):
                        steps.append(((i + len(seen), j + 1), math.log(chances.get((seen, original[j]), PRIOR[0] / PRIOR[1])), [(seen, original[j])]))
            for at, cost, what in steps:
                if at not in best or best[at][0] < score + cost:
                    best[at] = (score + cost, done + what)
                    later.append(at)
        front = later
    got = best.get((len(word), len(original)))
    return got if got and got[1] else None


class Corpus:
    """Counts of words, of words in headings and what words may be misreadings of, for one block of pages."""

    def __init__(self, words: dict[str, int], titles: dict[str, int], originals: dict[str, list[tuple[str, int, float]]], total: float, titled: float, common: frozenset[str]):
        self.words, self.titles, self.originals = words, titles, originals
        self.total, self.titled, self.common = total, titled, common

    def count(self, word: str) -> int:
        return self.words.get(word, 0)

    @functools.lru_cache(200_000)  # noqa: B019 (a block's corpus ends with its task)
    def running(self, word: str) -> bool:
        """A word of running text that headings don't have."""
        if word in self.common:
            return True
        n = self.count(word)
        expected = self.titled * n / self.total  # if headings were like running text
        return expected >= 4.0 and self.titles.get(word, 0) < 0.1 * expected

    def repairs(self, word: str) -> list[tuple[str, int, float]]:
        """Known words that ``word`` may be a misreading of: (word, count, log probability of the misreading)."""
        return self.originals.get(word, [])


def unknown(word: str, corpus: Corpus) -> bool:
    """A word that the corpus doesn't know and that may be a misreading; a bar after a known word is a mark."""
    if len(word) < 2 or corpus.count(word) >= 2 or CJK.search(word):
        return False
    return not (word.endswith("|") and corpus.count(word.rstrip("|")) >= 2)


Option = tuple[str, int, float]  # a word that may stand here, its count, its score


def stretches(words: list[str], corpus: Corpus) -> list[list[list[Option]]]:
    """Runs of words of which each has several options, with the settled word before and behind:
    paths meet in a settled word, so what is decoded apart is decoded as the line would be."""
    doubtful = [k for k, w in enumerate(words) if w in corpus.originals and unknown(w, corpus)]

    def options(k: int) -> list[Option]:
        w = words[k]
        n = corpus.count(w)
        own = (w, n, math.log((n if n >= 2 else ODD_UNSEEN if ODD.search(w) else UNSEEN) / corpus.total))
        return [own, *((c, m, p + math.log(m / corpus.total)) for c, m, p in corpus.repairs(w))] if k in within else [own]

    within, out, at = set(doubtful), [], 0
    while at < len(doubtful):
        first = last = doubtful[at]
        while at + 1 < len(doubtful) and doubtful[at + 1] == last + 1:
            at, last = at + 1, last + 1
        out.append([options(k) for k in range(max(0, first - 1), min(len(words), last + 2))])
        at += 1
    return out


def pair_key(a: str, b: str) -> int:
    """A pair of words as a signed 64-bit digest."""
    k = xxhash.xxh3_64_intdigest(f"{a}\x00{b}")
    return k - (1 << 64) if k >> 63 else k


def links(options: list[list[Option]]) -> list[int]:
    """The pairs that decoding a stretch asks for."""
    return list({pair_key(a[0], b[0]) for x, y in zip(options, options[1:], strict=False) for a in x for b in y})


def decode(options: list[list[Option]], pairs: dict[int, int]) -> list[Option]:
    """The likeliest words of a stretch: Viterbi over the options of each place and counts of pairs."""
    best = [(o[2], [o]) for o in options[0]]
    for here in options[1:]:
        best = [max(((score + math.log1p(pairs.get(pair_key(path[-1][0], o[0]), 0)) + o[2], [*path, o]) for score, path in best), key=lambda x: x[0]) for o in here]
    return max(best, key=lambda x: x[0])[1]


def sure(word: str, count: int, total: float) -> bool:
    """Whether an original of this count is frequent enough, as a share of all words, for a
    misreading of this word's length. Less than 2 is no word of the corpus."""
    letters = sum(c.isalpha() or ord(c) > 0x2FF for c in word)
    rate = RATES[0] if ALIEN.search(word) or "|" in word or "ऱ" in word else RATES[1] if letters >= 5 else RATES[2] if letters >= 4 else RATES[3]
    return count >= max(2.0, rate * total / 1e6)


def alien(word: str) -> bool:
    """Misread for sure, whatever it was: letters with characters between them that no word has."""
    return sum(c.isalpha() or ord(c) > 0x2FF for c in word) >= 3 and ALIEN.search(word) is not None


def changed(options: list[list[Option]], pairs: dict[int, int], total: float) -> dict[str, str]:
    """The misread words of a stretch with what decoding puts for them, "" where that is not sure but the word is alien."""
    out: dict[str, str] = {}
    for here, (new, n, _) in zip(options, decode(options, pairs), strict=True):
        old = here[0][0]
        if old != new and sure(old, n, total):
            out.setdefault(old, new)
        elif len(here) > 1 and alien(old):
            out.setdefault(old, "")
    return out


def _core(line: str) -> tuple[str, bool, str]:
    """The line without a header's marks, whether they are sure ones, and the number among them."""
    s = line.strip()
    for form, sure in HEADER_FORMS:
        m = form.match(s)
        if m:
            groups = m.groups()
            if len(groups) == 1:
                return groups[0], sure, ""
            number = next(g for g in groups if re.fullmatch(NUM, g))
            return next(g for g in reversed(groups) if g is not number) if groups[0] is number else groups[0], sure, number
    return s, False, ""


def _ascii_number(s: str) -> int:
    return int("".join(str(int(c)) for c in s)) if s else -1


def frame_lines(lines: list[str], title: str | None, page: int | None, corpus: Corpus) -> list[str]:
    """For each line '' (text), 'page_number' or 'header'."""
    kinds = [""] * len(lines)
    solid = [i for i, x in enumerate(lines) if x.strip()]
    for i in solid:
        if len(solid) > 1 and PAGE_LINE.match(lines[i]):
            kinds[i] = "page_number"
    body = [i for i in solid if not kinds[i]]
    if len(body) < 2:
        return kinds
    width = max(len(lines[i].strip()) for i in body)
    name = re.sub(r"\s+", "", plain(title).lower()) if title else ""
    flow = functools.lru_cache(1)(lambda: sum(corpus.running(w) for i in body for w in words_of(lines[i])))  # asked for by few pages
    items = functools.lru_cache(1)(lambda: sum(bool(ITEM.match(lines[i])) for i in body))
    han = functools.lru_cache(1)(lambda: sum(bool(CJK.search(lines[i])) for i in body) * 2 > len(body))
    for i in body:
        s = lines[i].strip()
        core, sure, number = _core(s)
        like = False
        if name and 0.7 * len(name) <= len(core):
            key = re.sub(r"\s+", "", core.lower())
            first = re.sub(r"\s+", "", re.split(r"\s[/~]\s", core)[0].lower())
            like = name in (key, first) or any(abs(len(k) - len(name)) <= 3 and difflib.SequenceMatcher(None, k, name, False).ratio() >= 0.8 for k in {key, first})
        marks = PUNCTUATION.search(core)
        if marks and not like or ITEM.match(s) and not like:
            continue
        words = words_of(core)
        if len(words) > 10 and not like and not CJK.search(core):
            continue
        function = sum(corpus.running(w) for w in words)
        if like and not (marks and END.search(s)) and function <= 1:
            kinds[i] = "header"
        elif marks or not words:
            continue
        elif CJK.search(core):
            last = i == body[-1]
            before = lines[body[body.index(i) - 1]] if i != body[0] else ""
            if sure or number and (page is None or _ascii_number(number) == page) or len(core) <= 0.6 * width and len(core) <= 16 and width >= 16 and (not last or END.search(before) or kinds[body[body.index(i) - 1]] != ""):
                kinds[i] = "header"
        elif function or len(words) > 10:
            continue
        elif sure or re.search(r"\S\s+/\s+\S", core) or number and len(words) <= 8 and (page is None or _ascii_number(number) == page or len(s) < 0.8 * width):
            kinds[i] = "header"
        elif not number and 2 <= len(words) <= 8 and len(s) <= 0.85 * width and s[-1] not in "-¬‐" and items() * 2 < len(body) and not han() and flow() >= 3:
            k = body.index(i)
            before = lines[body[k - 1]] if k else ""
            if i != body[-1] or END.search(before):
                kinds[i] = "header"
    if all(kinds[i] for i in body):  # a heading's own text is no frame
        for i in max(([i] for i in body if kinds[i] == "header"), key=lambda x: len(lines[x[0]])):
            kinds[i] = ""
    return kinds


def own_hyphen(left: str, right: str, corpus: Corpus) -> bool:
    """Whether a hyphen between these parts belongs to the word."""
    whole, compound = left + right, f"{left}-{right}"
    if corpus.count(compound) >= 2 and corpus.count(compound) >= corpus.count(whole):
        return True
    if corpus.count(whole) >= 2:
        return False
    return any(n >= 3 for _, n, _ in corpus.repairs(compound)) and not any(n >= 3 for _, n, _ in corpus.repairs(whole))


def _broken(s: str) -> bool:
    """A line that ends in a broken word."""
    return len(s) > 1 and s[-1] in HYPHENS and (s[-2].isalpha() or ord(s[-2]) > 0x2FF) and s[-2] not in HYPHENS


def _joint(left: str, line: str) -> tuple[str, str]:
    """The two parts of a broken word as they are looked up."""
    first = line.partition(" ")[0]
    m = re.match(r"^([^\s।॥.,;:?!؟۔)\]”’\"]+)(.*)$", first)
    return re.sub(r"^[\"“‘'(\[]+", "", left).lower(), (m[1] if m else first).lower()


def asked_of(text: str) -> tuple[list[str], set[str]]:
    """A page's words, and other words by whose counts it is decided: broken words joined
    with the start of every line that may follow when frame lines are left out."""
    words = words_of(text)
    more = {w.rstrip("|") for w in words if w[-1] == "|"}
    lines = [x.strip() for x in text.split("\n")]
    for i, s in enumerate(lines):
        if "|" in s:
            more.update(words_of(_core(s)[0]))
        if _broken(s):
            left = s[s.rfind(" ") + 1 : -1]
            for later in filter(None, lines[i + 1 :]):
                a, b = _joint(left, later)
                joint = re.sub(r"\S+", "", later, count=1)
                more |= {a + b, f"{a}-{b}", *words_of(f"{left}{later.partition(' ')[0]}"), *words_of(f"{left}-{later.partition(' ')[0]}")}
                if END.search(later) and PUNCTUATION.search(later) and joint:
                    break  # no frame line: the word goes on here at the latest
    return words, more


def damages(text: str, title: str | None, page: int | None, corpus: Corpus) -> tuple[set[str], list[str], list[list[list[Option]]]]:
    """Kinds of damage of a page's plain text but for misreadings decoding decides, its
    paragraphs, and the stretches to be decoded."""
    lines = text.split("\n")
    kinds = frame_lines(lines, title, page, corpus)
    found = {k for k in kinds if k}
    body: list[str] = []
    paragraphs: list[list[str]] = [[]]
    carry = ""  # the first part of a broken word
    for line, kind in zip(lines, kinds, strict=True):
        if kind:
            continue
        s = line.strip()
        if not s:
            if not carry and body and END.search(body[-1]) and paragraphs[-1]:
                paragraphs.append([])
            continue
        if carry:
            own = own_hyphen(*_joint(carry, s), corpus)
            if not own:
                found.add("hyphen")
            s = carry + ("-" if own else "") + s
            carry = ""
        if _broken(s):
            at = s.rfind(" ") + 1
            carry, s = s[at:-1], s[:at].rstrip()
        if s:
            body.append(s)
            paragraphs[-1].append(s)
    if carry:
        paragraphs[-1].append(carry)
        body.append(carry)
    out, doubtful = [], []
    for paragraph in paragraphs:
        joined = " ".join(paragraph)
        words = words_of(joined)
        doubtful += stretches(words, corpus)
        if ALIEN.search(joined.lower()) and any(unknown(w, corpus) and not corpus.repairs(w) and alien(w) for w in words):
            found.add("misread")
        if joined:
            out.append(joined)
    return found, out, doubtful


def _cased(piece: str, fixed: dict[str, str]) -> str:
    low = piece.lower()
    for old, new in fixed.items():
        if new and old in low:
            k = low.index(old)
            if k and low[k - 1].isalnum() or low[k + len(old) : k + len(old) + 1].isalpha():
                continue
            if piece[k].isupper():
                new = new[:1].upper() + new[1:]
            return piece[:k] + new + piece[k + len(old) :]
    return piece


def apply_fixes(text: str, fixed: dict[str, str]) -> str:
    return "".join(_cased(p, fixed) for p in re.split(r"(\s+)", text))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, pair, n, titled): words of running text and of headings, or pairs of words as digests."""
    words, titles, pairs = Counter(), Counter(), Counter()

    def give() -> Iterator[pa.RecordBatch]:
        one = list(words.keys() | titles.keys())
        no, none = pa.nulls(len(one), pa.int64()), pa.nulls(len(pairs), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.string()), no, pa.array([words[w] for w in one], pa.int64()), pa.array([titles[w] for w in one], pa.int64())], names=COUNT_NAMES)
        yield pa.RecordBatch.from_arrays([none, pa.array([pair_key(*p) for p in pairs], pa.int64()), pa.array(list(pairs.values()), pa.int64()), pa.nulls(len(pairs), pa.int64())], names=COUNT_NAMES)
        for c in (words, titles, pairs):
            c.clear()

    for batch in batches:
        for text, heading in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = words_of(plain(text))
            if heading:
                titles.update(own)
            else:
                words.update(own)
                pairs.update(zip(own, own[1:], strict=False))
        if len(words) + len(titles) + len(pairs) > 600_000:
            yield from give()
    yield from give()


COUNT_NAMES = ["word", "pair", "n", "titled"]


def _asked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, word, n): a block's words, n times on its pages (0: asked only)."""
    held: dict[int, Counter] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for block, words in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(words), pa.int64()), pa.array(words, pa.string()), pa.array(list(words.values()), pa.int64())], names=["block", "word", "n"])
        held.clear()

    for batch in batches:
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, more = asked_of(plain(text))
            own = held.setdefault(block, Counter())
            own.update(words)
            for w in more:
                own[w] += 0
        if sum(map(len, held.values())) > 300_000:
            yield from give()
    yield from give()


def _estimate(chances: dict[tuple[str, str], float], total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (seen, printed, n): expected misreadings among unknown words and what they may stand for."""
        held: Counter = Counter()
        for batch in batches:
            for word, n, originals in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = [(x[0] + math.log(o["n"]), x[1]) for o in originals if (x := explain(word, o["w"], chances)) and sure(word, o["n"], total)]
                whole = math.log(UNSEEN + sum(math.exp(p) for p, _ in got))
                for p, what in got:
                    for op in what:
                        held[op] += n * math.exp(p - whole)
        seen, printed = zip(*held, strict=True) if held else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(printed, pa.string()), pa.array(list(held.values()), pa.float64())], names=["seen", "printed", "n"])

    return run


def _scored_rows(chances: dict[tuple[str, str], float]):
    """Each unknown word with the originals that confusions explain, likeliest first."""
    kind = pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64()), ("s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, out = [], []
            for w, originals in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = [{"w": o["w"], "n": o["n"], "s": x[0]} for o in sorted(originals, key=lambda o: (-o["n"], o["w"])) if (x := explain(w, o["w"], chances))]
                if got:
                    word.append(w), out.append(got)
            none = pa.nulls(len(word), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), none, none, pa.array(out, kind)], names=["word", "n", "titled", "originals"])

    return run


def _chances(doubtful: DataFrame, met: DataFrame, total: float, rounds: int = 2) -> dict[tuple[str, str], float]:
    """P(seen | printed) of each confusion. One row a confusion reaches the driver."""
    letters = sorted({p for v in CONFUSIONS.values() for p in v.split()})
    times = [F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(c), F.lit(""))))).alias(str(i)) for i, c in enumerate(letters)]
    printed = dict(zip(letters, met.agg(*times).first() or [0] * len(letters), strict=True))
    chances: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        got = {(r["seen"], r["printed"]): r["n"] for r in doubtful.mapInArrow(_estimate(chances, total), "seen string, printed string, n double").groupBy("seen", "printed").agg(F.sum("n").alias("n")).collect()}
        chances = {(s, p): (got.get((s, p), 0.0) + PRIOR[0]) / ((printed[p] or 0) + got.get((s, p), 0.0) + PRIOR[1]) for s, v in CONFUSIONS.items() for p in v.split()}
    return chances


OPTIONS = "array<array<struct<w:string,n:bigint,s:double>>>"
_OPTIONS = pa.list_(pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64()), ("s", pa.float64())])))


def _read_pages(pages: DataFrame, typed: DataFrame, common: frozenset[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(read, fixes): read has key, block, out (a kind of damage) or text (the paragraphs), fixes key, old, new."""
    rows = pages.where("text is not null").select("key", "text", "title", "page")
    spark = rows.sparkSession
    blocks = max(1, -(-rows.count() // block_rows))
    tasks = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("bigint"))
    counts = cut(typed.where("text is not null").select("text", "heading").mapInArrow(_count_rows, "word string, pair bigint, n bigint, titled bigint"))
    # what stands once in all typed text says nothing: a word seen once is as unknown, a pair as likely
    words = cut(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("titled").alias("titled")).where("n > 1 or titled > 0"))
    pairs = counts.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
    sums = words.agg(F.sum("n"), F.sum("titled")).first()
    total, titled = float(sums[0] or 0) + 1.0, float(sums[1] or 0)

    asked = cut(rows.select("block", "text").mapInArrow(_asked_rows, "block bigint, word string, n bigint").groupBy("block", "word").agg(F.sum("n").alias("n")))
    met = asked.groupBy("word").agg(F.sum("n").alias("n"))
    new = met.join(words.where("n >= 2"), "word", "left_anti").where(F.length("word") >= 2)
    known = words.where("n >= 2").select(F.col("word").alias("w"), F.col("n").alias("k"), shape(F.col("word")).alias("shape"))
    near = new.withColumn("shape", shape(F.col("word"))).join(known, "shape").groupBy("word").agg(F.max("n").alias("n"), F.collect_list(F.struct("w", F.col("k").alias("n"))).alias("originals"))
    near = cut(near)
    chances = _chances(near, met, total)
    scored = near.select("word", "originals").mapInArrow(_scored_rows(chances), "word string, n bigint, titled bigint, originals array<struct<w:string,n:bigint,s:double>>")
    # a word has either counts of its own or originals; one seen once or in headings only may have both
    either = words.withColumn("originals", F.lit(None).cast(scored.schema["originals"].dataType)).unionByName(scored)
    facts = asked.select("block", "word").join(either, "word")

    def read(here: pa.Table, have: pa.Table) -> pa.Table:
        counted, headed, originals = {}, {}, {}
        for w, n, t, cs in zip(*(have.column(c).to_pylist() for c in ("word", "n", "titled", "originals")), strict=True):
            if cs is None:
                counted[w], headed[w] = n, t
            else:
                originals[w] = [(o["w"], o["n"], o["s"]) for o in cs]
        corpus = Corpus(counted, headed, originals, total, titled, common)
        row, out, text, options, asks = [], [], [], [], []
        for i, (t, title, page) in enumerate(zip(*(here.column(c).to_pylist() for c in ("text", "title", "page")), strict=True)):
            found, paragraphs, doubtful = damages(plain(t), title, page, corpus)
            got = [(k, None, None, None) for k in sorted(found)] + [(None, "\n\n".join(paragraphs), None, None)]
            got += [(None, None, [[dict(zip("wns", o, strict=True)) for o in os] for os in d], links(d)) for d in doubtful]
            row += [i] * len(got)
            for a, b, c, e in got:
                out.append(a), text.append(b), options.append(c), asks.append(e)
        take = pa.array(row, pa.int64())
        return pa.table({"key": here.column("key").take(take), "block": here.column("block").take(take), "out": pa.array(out, pa.string()), "text": pa.array(text, pa.string()), "options": pa.array(options, _OPTIONS), "links": pa.array(asks, pa.list_(pa.int64()))})

    here, have = rows.repartition(tasks, "block"), facts.repartition(tasks, "block")
    done = cut(here.groupBy("block").cogroup(have.groupBy("block")).applyInArrow(read, f"key bigint, block bigint, out string, text string, options {OPTIONS}, links array<bigint>"))

    doubts = done.where("options is not null").select("key", "block", "options", "links").dropDuplicates(["key", "options"])
    # the pairs that a block's stretches ask for
    asks = doubts.select(F.col("block").alias("of_block"), F.explode("links").alias("pair")).distinct()
    met_pairs = asks.join(pairs, "pair")

    def settle(these: pa.Table, have: pa.Table) -> pa.Table:
        linked = dict(zip(have.column("pair").to_pylist(), have.column("n").to_pylist(), strict=True))
        row, old, new = [], [], []
        for i, d in enumerate(these.column("options").to_pylist()):
            for a, b in changed([[(o["w"], o["n"], o["s"]) for o in os] for os in d], linked, total).items():
                row.append(i), old.append(a), new.append(b)
        return pa.table({"key": these.column("key").take(pa.array(row, pa.int64())), "old": pa.array(old, pa.string()), "new": pa.array(new, pa.string())})

    these, have = doubts.repartition(tasks, "block"), met_pairs.repartition(tasks, "of_block")
    return done, these.groupBy("block").cogroup(have.groupBy("of_block")).applyInArrow(settle, "key bigint, old string, new string")


def page_damage(pages: DataFrame, typed: DataFrame, common: frozenset[str], block_rows: int = 8000) -> DataFrame:
    """key, damage: each kind of damage of each page, once. pages: key BIGINT, text,
    title STRING, page INT; typed: text STRING, heading BOOLEAN. Null texts have no row;
    a null title or page only takes that evidence away; repeated rows count once."""
    done, fixes = _read_pages(pages, typed, common, block_rows)
    misread = fixes.select("key", F.lit("misread").alias("damage"))
    return done.where("out is not null").select("key", F.col("out").alias("damage")).unionByName(misread).distinct()


def _fix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [apply_fixes(t, {x["old"]: x["new"] for x in f}) if f else t for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["key", "text"])


def repaired_pages(pages: DataFrame, typed: DataFrame, common: frozenset[str], block_rows: int = 8000) -> DataFrame:
    """key, text: continuous paragraphs without the page's frame, words whole and rightly spelled."""
    done, fixes = _read_pages(pages, typed, common, block_rows)
    by = fixes.where("new <> ''").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("old", "new"))).alias("fixes"))
    texts = done.where("text is not null").select("key", "text").join(by, "key", "left")
    return texts.mapInArrow(_fix_rows, "key bigint, text string")
