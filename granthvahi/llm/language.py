"""Languages of documents and of the stretches of mixed ones (problem 1).

Hyperdimensional profiles. Each letter has a random vector of +1 and -1; an
n-gram's vector is the product of its letters' vectors, each permuted by its
place; a language's prototype is the weighted bundle of the n-grams (inside
words, and whole words) that tell it from the other languages. A sentence and a text
are the bundles of their n-grams and are compared with every prototype by cosine:
the dot product over both lengths. A bundle being a sum, its dot products are the sums
of its words' own, which are kept for words seen before; its length is measured on a
slice of the bundle. Cosines are read as multiples of what vectors met by chance give,
and the confidence follows the gap between the nearest two.

Prototypes are fitted on a bounded sample (``sample_rows``) of labelled rows;
labels being partly wrong, the sample's sentences are labelled anew by the first
fit and the fit is repeated. Every row is then split into sentences, and each
sentence is given a language; neighbouring sentences of one language are a stretch.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import TO_LATIN

# Codes and English names of the languages that labels may give.
NAMES = {
    "hi": "hi hin hindi", "sa": "sa san sanskrit", "mr": "mr mar marathi", "ne": "ne nep npi nepali", "gu": "gu guj gujarati",
    "bn": "bn ben bengali bangla", "ta": "ta tam tamil", "ur": "ur urd urdu", "en": "en eng english", "de": "de deu ger german",
    "fr": "fr fra fre french", "ja": "ja jpn japanese jp", "zh": "zh zho chi cmn chinese mandarin",
}
CODE_OF = {name: code for code, names in NAMES.items() for name in names.split()}
LANGUAGES = list(NAMES)

MARKS = "\\u0300-\\u036f\\u064b-\\u065f\\u0670\\u0900-\\u0903\\u093a-\\u094f\\u0955-\\u0957\\u0962\\u0963\\u0981-\\u0983\\u09bc-\\u09cd\\u09d7\\u0a81-\\u0a83\\u0abc-\\u0acd\\u0b82\\u0bbe-\\u0bcd\\u0bd7\\u200c\\u200d"
CJK = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff"
# Letters and marks of the scripts of LANGUAGES, as one class: a word is found in one run.
LETTERS = (
    "a-z\\u00e0-\\u00f6\\u00f8-\\u024f\\u0300-\\u036f\\u0610-\\u061a\\u0620-\\u065f\\u066e-\\u06d3\\u06d5-\\u06dc\\u06df-\\u06e8\\u06ea-\\u06ef\\u06fa-\\u06ff\\u0900-\\u0963\\u0971-\\u09e3"
    "\\u09f0-\\u09f1\\u0a81-\\u0ae3\\u0b82-\\u0be5"
)
WORD = re.compile(f"[{LETTERS}]+|[{CJK}]")  # in lower-case text
ENDS = re.compile("[।॥?!؟۔。！？|]+[\"'”’»)\\]」』]*|\\.+[\"'”’»)\\]]*(?=\\s|$|[^\\s\\w.,])|…[\"'”’»)\\]]*(?=\\s*$)")
TAG = re.compile(r"<metadata_page>[^<]*</metadata_page>|</?[A-Za-z_][\w-]*>|={3,}PAGE_BREAK={3,}|&nbsp;|\(cid:\d+\)")
INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200d\\u2060\\ufeff\\u200e\\u200f]")
SPACES = re.compile("[\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]")
BLOCK, PARAGRAPH = re.compile(r"[^\n]+"), re.compile(r"(?:[^\n]|\n(?!\s*\n))+")
LIST = re.compile(r"(?m)(?:^\s*(?:[-*•‣▪☐–·]|\(?\d{1,4}[.)])\s+\S.*(?:\n|$)\s*){2,}")
ITEM = re.compile(r"^\s*(?:[-*•‣▪☐–·]|\(?[\d]{1,4}[.)])\s+\S")


#: Words of at most so many letters are n-grams of their own.
WHOLE = 7


_TWINS = str.maketrans(TO_LATIN)
FOREIGN_LETTER = re.compile("[\\u0370-\\u03ff\\u0400-\\u052f]")
CODE = re.compile(r"[A-Za-z0-9+/=_.\-]{40,}")
STREWN = re.compile(f"[A-Za-z0-9][\\u0900-\\u0dff]|[\\u0900-\\u0dff][A-Za-z0-9]|(?<![\\u0900-\\u0dff])[{MARKS}]")


def label_language(label: str | None) -> str:
    """The code a label names; "" if it names none; another word if it names a language beyond LANGUAGES."""
    t = (label or "").strip().lower()
    if t in ("", "-", "und", "unknown", "none", "null", "n/a", "na", "?", "mul", "zxx", "mis", "other", "xx"):
        return ""
    return CODE_OF.get(re.split(r"[-_\s(]", t)[0], t)


def sentences(text: str, lines_are_units: bool = True) -> list[tuple[int, int, bool, bool]]:
    """(start, end, ended by a mark, item of a list) of the stretches of a text between end marks."""
    out = []
    for block in BLOCK.finditer(text) if lines_are_units or LIST.search(text) else PARAGRAPH.finditer(text):
        a, last = block.start(), block.end()
        item = bool(ITEM.match(block[0]))
        for m in ENDS.finditer(text, a, last):
            if m.end() > a:
                out.append((a, m.end(), True, item))
                a = m.end()
        if text[a:last].strip():
            out.append((a, last, False, item))
    return out


def grams(word: str) -> list[str]:
    """What a word is bundled from: the word itself and its letter n-grams with the word's edges."""
    if len(word) == 1:
        return [f"<{word}>", word]
    w = f"<{word}>"
    own = [w[i : i + 3] for i in range(len(w) - 2)]
    return [w, *own] if 3 < len(w) <= WHOLE + 2 else own


class Profiles:
    """Prototypes of languages and the comparison with them by cosine.

    A text's vector is the bundle (sum) of the vectors of its n-grams. Its dot product
    with a prototype is the sum of its words' own products, and its length is measured
    on the first ``measured`` components of the bundle itself."""

    def __init__(self, languages: list[str], weights: list[dict[str, float]], dimensions: int = 16384, measured: int = 256, seed: int = 7):
        self.languages, self.dimensions, self.seed = languages, dimensions, seed
        self.measured = min(measured, dimensions)
        self._letters: dict[tuple[str, int], np.ndarray] = {}
        self.prototypes = np.zeros((len(languages), dimensions), np.float32)
        for k, own in enumerate(weights):
            for g, w in own.items():
                self.prototypes[k] += np.float32(w) * self.vector(g)
        self.norms = np.maximum(np.linalg.norm(self.prototypes, axis=1), 1e-6)
        #: Standard deviation of the cosine of vectors that have nothing in common.
        self.chance = 1.0 / math.sqrt(dimensions)
        self._reset()

    def _reset(self) -> None:
        self._gram: dict[str, int] = {}
        self._gram_dots = np.zeros((4096, len(self.languages)), np.float32)
        self._gram_parts = np.zeros((4096, self.measured), np.float32)
        self._word: dict[str, int] = {}
        self._dots = np.zeros((4096, len(self.languages)), np.float32)
        self._parts = np.zeros((4096, self.measured), np.float32)

    def __getstate__(self):  # noqa: ANN204
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):  # noqa: ANN001, ANN204
        self.__dict__.update(state)
        self._letters = {}
        self._reset()

    def letter(self, c: str, place: int) -> np.ndarray:
        v = self._letters.get((c, place))
        if v is None:
            if place:
                v = np.roll(self.letter(c, 0), place)
            else:
                bits = np.random.Generator(np.random.PCG64([self.seed, ord(c)])).integers(0, 2, self.dimensions, dtype=np.int8)
                v = (2 * bits - 1).astype(np.int8)
            if len(self._letters) < 4096:
                self._letters[c, place] = v
        return v

    def vector(self, gram: str) -> np.ndarray:
        """The n-gram's vector: letters permuted by place and bound by product."""
        v = self.letter(gram[-1], 0)
        for i, c in enumerate(reversed(gram[:-1]), 1):
            v = v * self.letter(c, i)
        return v

    def _learn_grams(self, new: list[str], together: int = 256) -> None:
        """Products of new n-grams with all prototypes, many at once."""
        self._gram_dots, self._gram_parts = (_room(a, len(self._gram) + len(new)) for a in (self._gram_dots, self._gram_parts))
        for lo in range(0, len(new), together):
            v = np.stack([self.vector(g) for g in new[lo : lo + together]])
            at = len(self._gram)
            self._gram.update((g, at + i) for i, g in enumerate(new[lo : lo + together]))
            self._gram_dots[at : at + len(v)] = v.astype(np.float32) @ self.prototypes.T
            self._gram_parts[at : at + len(v)] = v[:, : self.measured]

    def learn_words(self, new: list[str]) -> None:
        """Bundles of new words, each from its n-grams."""
        own = [grams(w) for w in new]
        self._learn_grams(list(dict.fromkeys(g for gs in own for g in gs if g not in self._gram)))
        flat = np.array([self._gram[g] for gs in own for g in gs], np.int64)
        sizes = np.array([len(gs) for gs in own], np.int64)
        at = len(self._word)
        self._dots, self._parts = (_room(a, at + len(new)) for a in (self._dots, self._parts))
        self._dots[at : at + len(new)] = _sums(self._gram_dots, flat, sizes)
        self._parts[at : at + len(new)] = _sums(self._gram_parts, flat, sizes)
        self._word.update((w, at + i) for i, w in enumerate(new))

    def bundles(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each list of words its bundle: the dot products with the prototypes and the
        measured components. Bundles of parts add up to the bundle of the whole."""
        if len(self._word) > 400_000 or len(self._gram) > 400_000:
            self._reset()
        words = [w for ws in texts for w in ws]
        new = [w for w in dict.fromkeys(words) if w not in self._word]
        if new:
            self.learn_words(new)
        dots, parts = np.zeros((len(texts), len(self.languages)), np.float32), np.zeros((len(texts), self.measured), np.float32)
        if words:
            ids = np.fromiter(map(self._word.__getitem__, words), np.int64, len(words))
            sizes = np.array([len(ws) for ws in texts], np.int64)
            dots, parts = _sums(self._dots, ids, sizes), _sums(self._parts, ids, sizes)
        return dots, parts

    def cosines(self, dots: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Cosine of each bundle with each prototype; 0 for an empty bundle."""
        length = np.sqrt(np.square(parts, dtype=np.float64).sum(axis=1) * (self.dimensions / self.measured))
        return dots / np.maximum(length, 1.0)[:, None] / self.norms


def _sums(rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, together: int = 48) -> np.ndarray:
    """Sum of the rows of each run of ids: first of all runs' first ids, then of their second ones and so on."""
    out = np.zeros((len(sizes), rows.shape[1]), np.float32)
    by = np.argsort(-sizes, kind="stable")
    starts, ordered = (np.cumsum(sizes) - sizes)[by], sizes[by]
    total = np.zeros_like(out)
    for j in range(min(int(ordered[0]) if len(ordered) else 0, together)):
        n = len(ordered) - int(np.searchsorted(ordered[::-1], j, side="right"))
        total[:n] += rows[ids[starts[:n] + j]]
    for k in np.flatnonzero(ordered > together):
        total[k] += rows[ids[starts[k] + together : starts[k] + ordered[k]]].sum(axis=0)
    out[by] = total
    return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    while len(a) < n:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


def _tell_apart(counts: dict[str, Counter], keep: int) -> list[dict[str, float]]:
    """For each language the n-grams that mark it, weighted by their log odds."""
    totals = {k: sum(c.values()) + 1.0 for k, c in counts.items()}
    rate: dict[str, dict[str, float]] = defaultdict(dict)
    for k, c in counts.items():
        for g, n in c.items():
            if n > 1:
                rate[g][k] = n / totals[k]
    out = []
    for k in counts:
        floor = 2.0 / totals[k]
        own = {}
        for g, r in rate.items():
            if k in r:
                rest = (sum(r.values()) - r[k]) / max(1, len(counts) - 1)
                top = max((x for j, x in r.items() if j != k), default=0.0)
                w = math.log(r[k] / (max(top, rest) + floor))
                if w > 0.4:
                    own[g] = (w, r[k] * min(w, 4.0))
        best = sorted(own, key=lambda g: -own[g][1])[:keep]
        out.append({g: min(own[g][0], 4.0) for g in best})
    return out


def fit(sample: list[tuple[str, str]], rounds: int = 2, keep: int = 350, dimensions: int = 16384) -> Profiles:
    """Profiles from (language, text) pairs whose languages are partly wrong. ``keep`` bounds
    a prototype: it bundles so many n-grams, those that tell most."""
    rows: list[tuple[str, list[str]]] = []
    for lang, text in sample:
        text = clean(text).lower()
        for a, b, _, _ in sentences(text):
            words = [sys.intern(w) for w in WORD.findall(text, a, b)]
            if len(words) >= 3:
                rows.append((lang, words))
    langs = [lang for lang, _ in rows]
    profiles = None
    for _ in range(rounds):
        by_word: dict[str, Counter] = defaultdict(Counter)
        for lang, (_, words) in zip(langs, rows, strict=True):
            by_word[lang].update(words)
        counts = {}
        for lang in sorted(by_word):
            c: Counter = Counter()
            for w, n in by_word[lang].items():
                for g in grams(w):
                    c[g] += n
            counts[lang] = c
        profiles = Profiles(sorted(counts), _tell_apart(counts, keep), dimensions)
        if rows:
            got = profiles.cosines(*profiles.bundles([w for _, w in rows]))
            langs = [profiles.languages[k] if got[i, k] > 2.0 * profiles.chance else langs[i] for i, k in enumerate(got.argmax(axis=1))]
    return profiles or Profiles(["en"], [{}], dimensions)


def clean(text: str) -> str:
    """Same length as the stored text where tags and invisible marks are none; both go."""
    if "<" in text or "&" in text or "(cid" in text or "=" in text:
        text = TAG.sub("\n", text)
    if FOREIGN_LETTER.search(text):
        text = text.translate(_TWINS)  # no language here is written in these letters
    if CODE.search(text):
        text = CODE.sub(" ", text)
    return SPACES.sub(" ", INVISIBLE.sub("", text))


#: Cosines, as multiples of what chance gives: by how much another language must be ahead
#: of the text's own, be ahead of all others and be there at all, for a sentence to be its.
AHEAD, APART, NEAR = 5.0, 2.0, 4.0


def judge(profiles: Profiles, texts: list[str], known: frozenset[str]) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text its sentences as (start, end, language, confidence, whole).

    Sentences and the whole text are bundled and compared with the prototypes by cosine.
    A sentence takes the text's language unless another is ahead by AHEAD; the confidence
    grows with the gap between the nearest two. It is whole if it is no item of a list, ends
    in a mark (or is long in a text that has no marks at all), is near enough to its language
    and apart from the others, and, as an exact check, has the length of a sentence and a
    common word of some language."""
    spans: list[tuple[int, int, int, bool, bool]] = []
    words: list[list[str]] = []
    marked, strewn = [False] * len(texts), [False] * len(texts)  # letters and marks strewn about make no sentences
    for i, text in enumerate(texts):
        strewn[i] = len(STREWN.findall(text)) * 8 > text.count(" ") + 8
        low = text.lower()
        if len(low) != len(text):
            low = text
        for a, b, ended, item in sentences(text, False):
            spans.append((i, a, b, ended, item))
            words.append(WORD.findall(low, a, b))
            marked[i] |= ended
    out: list[list[tuple[int, int, str, float, bool]]] = [[] for _ in texts]
    if not spans:
        return out
    dots, parts = profiles.bundles(words)
    owner = np.array([s[0] for s in spans], np.int64)
    sizes = np.bincount(owner, minlength=len(texts))  # a text's bundle is that of its sentences together
    whole_text = profiles.cosines(_sums(dots, row := np.arange(len(spans)), sizes), _sums(parts, row, sizes)).argmax(axis=1)
    cosine = profiles.cosines(dots, parts) / profiles.chance
    own, pick = whole_text[owner], cosine.argmax(axis=1)
    pick = np.where(cosine[row, pick] - cosine[row, own] < AHEAD, own, pick)
    top = cosine[row, pick]
    rest = cosine.copy()
    rest[row, pick] = -1e9
    gap = top - (rest.max(axis=1) if len(profiles.languages) > 1 else 0.0)
    confidence = np.where(top > 0, 1.0 / (1.0 + np.exp(-np.clip(gap, -60.0, 60.0) / 3.0)), 0.0).tolist()
    fits = ((gap > APART) & (top > NEAR)).tolist()
    seen = (top > 0).tolist()
    for (i, a, b, ended, item), ws, k, fit_, sure, some in zip(spans, words, pick.tolist(), fits, confidence, seen, strict=True):
        lang = profiles.languages[k]
        whole = fit_ and not item and not strewn[i] and (ended or not marked[i])
        if whole:
            cjk = lang in ("ja", "zh")
            n = sum("\u3040" <= w <= "\u9fff" for w in ws) if cjk else len(ws)
            commons = sum(w in known for w in ws)
            whole = n >= (5 if cjk else 3) and commons >= 1 or n >= (8 if cjk else 4)
            if not cjk:  # long codes are no sentence
                whole = whole and b - a <= 24 * (texts[i].count(" ", a, b) + texts[i].count("\n", a, b) + 1)
            if not ended:
                whole = whole and n >= (20 if cjk else 10) and commons >= max(2, n // 16)
        out[i].append((a, b, lang if some else "und", sure, whole))
    return out


def _sample_text(labelled: DataFrame, sample_rows: int) -> list[tuple[str, str]]:
    """About ``sample_rows`` labelled rows, those whose hash lies below a threshold: the
    same rows at every layout of the data, and no more of them when it grows. The
    driver gets these rows and no others. Texts below 20 and above 20,000 characters are
    not sampled; they are judged like all others."""
    rows = labelled.where("lang is not null and key is not null")
    share = min(1.0, sample_rows / max(1, rows.count()))
    unit = F.shiftrightunsigned(F.xxhash64("kind", "key"), 11).cast("double") / F.lit(float(1 << 53))
    got = rows.where((unit < share) & F.expr("length(trim(text)) between 20 and 20000")).select("lang", "text").limit(2 * sample_rows).collect()
    return [(code, r["text"]) for r in got if (code := label_language(r["lang"])) in NAMES]


def _judge_rows(profiles: Profiles, known: frozenset[str], found_only: bool):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                texts = [clean(t) for t in part.column(2).to_pylist()]
                labels = [label_language(x) for x in part.column(3).to_pylist()]
                row, lang, start, end, conf = [], [], [], [], []
                for i, got in enumerate(judge(profiles, texts, known)):
                    if found_only:
                        for x in sorted({g[2] for g in got if g[4]} - {labels[i], "und"}):
                            row.append(i), lang.append(x)
                        continue
                    for k, (a, e, x, c, _) in enumerate(got):
                        if k and lang and row[-1] == i and lang[-1] == x:
                            end[-1], conf[-1] = e, min(conf[-1], c)
                        else:
                            row.append(i), lang.append(x), start.append(a), end.append(e), conf.append(c)
                take = pa.array(row, pa.int64())
                cols, names = [part.column(0).take(take), part.column(1).take(take), pa.array(lang, pa.string())], ["kind", "key", "lang"]
                if not found_only:
                    cols += [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(conf, pa.float64())]
                    names += ["start_at", "end_at", "confidence"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return found


def _profiles(rows: DataFrame, common_words: DataFrame, sample_rows: int, max_common: int = 20_000) -> tuple[Profiles, frozenset[str]]:
    known = [r["word"] for r in common_words.select(F.lower("word").alias("word")).where("word is not null").distinct().limit(max_common + 1).collect()]
    if len(known) > max_common:
        raise ValueError(f"more than {max_common} common words")
    return fit(_sample_text(rows, sample_rows)), frozenset(known)


def languages_beside_label(rows: DataFrame, common_words: DataFrame, sample_rows: int = 9_000) -> DataFrame:
    """kind, key, lang: each language in which a row holds a whole sentence and which
    its label does not name. rows: kind, key BIGINT, text, lang. Null and blank texts
    and texts without a sentence have no row; repeated rows count once."""
    rows = rows.select("kind", "key", "text", "lang")
    profiles, known = _profiles(rows, common_words, sample_rows)
    held = rows.where("key is not null and length(trim(text)) > 0")
    return held.mapInArrow(_judge_rows(profiles, known, True), "kind string, key bigint, lang string").distinct()


def language_stretches(rows: DataFrame, common_words: DataFrame, sample_rows: int = 9_000) -> DataFrame:
    """kind, key, lang, start_at, end_at, confidence: the stretches of one language of
    every row, in order; positions in the text without tags and invisible marks. What
    no profile knows is 'und'; null and blank texts have no row."""
    rows = rows.select("kind", "key", "text", "lang")
    profiles, known = _profiles(rows, common_words, sample_rows)
    held = rows.where("key is not null and length(trim(text)) > 0")
    return held.mapInArrow(_judge_rows(profiles, known, False), "kind string, key bigint, lang string, start_at bigint, end_at bigint, confidence double")
