"""Statistics of each document's text and its form by combined rules (problem 9).

Every line is judged by what it is made of (a row of cells, an item of a list,
prose, rubbish); the document's form is what most of its characters lie in.
Repetition statistics (shares of repeated lines and paragraphs, share of the
characters covered by the most frequent word n-gram) tell boilerplate and stuck
keys from writing; shares of common words and of lines that end in a mark tell
verse and short prose from lists.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<metadata_page>[^<]*</metadata_page>|</?[A-Za-z_][\w-]*>")
CONTROL = re.compile(r"={2,}\s*PAGE[_ ]?BREAK\s*={2,}|-{2,}\s*PAGE[_ ]?BREAK\s*-{2,}|&[a-z]+;|&#\d+;|\(cid:\d+\)|�+", re.I)
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
END = re.compile(r"[.!?…।॥۔؟。！？|]+[\"'”’»)\]」』]*$")
MARKER = re.compile(r"^\s*(?:[-*•‣◦▪■□☐☑✓–—·+>]|\(?[0-9०-९০-৯૦-૯௦-௯۰-۹٠-٩]{1,4}[.)\]:、।]|[०-९0-9]{1,3}\s*[-–]|\(?[a-zA-Zivx]{1,4}[.)]|[①-⑳])\s*(?=\S)")
LEADER = re.compile(r"(?:\.{4,}|(?:\. ){3,}|…{2,}|·{3,}|_{4,})\s*[\divxlc०-९০-৯૦-૯௦-௯۰-۹٠-٩]+\s*$", re.I)
DELIMITERS = [re.compile(p) for p in (r"\|", r"\t", r";", r",(?=\S)|,$", r" {2,}", r"[¦│｜║┃]", r"/", r"~", r"\^", r"#", r"·", r"→", r"::")]
RULE = re.compile(r"^[\s|:+=-]+$")
MOJIBAKE = re.compile(r"(?:[ÃÂà-ï][\x80-\xbfŒ-Ÿƒˆ˜‐-›€™]{1,2}){2,}")
MARKS = "ऀ-ः़-ॏॢॣঁ-ঃ়-্ઁ-ઃ઼-્ஂா-்"
BROKEN = re.compile(f"(?:^|[^ऀ-௿])[{MARKS}]|[{MARKS}][a-zA-Z0-9]|[a-zA-Z][ऀ-௿]|[ऀ-௿][a-zA-Z]|[ािीुूृेैोौ]{{2,}}")
LONG = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
HAN = re.compile("[぀-ヿ㐀-鿿]")
SYMBOL = re.compile(r"[^\w\s\u0900-\u0903\u093a-\u094f\u0955-\u0963\u0981-\u0983\u09bc-\u09d7\u09e2\u09e3\u0a81-\u0a83\u0abc-\u0acd\u0b82\u0bbe-\u0bd7\u064b-\u065f\u0670\u0300-\u036f]+|_+")

FIELDS = [
    ("n_words", "bigint"), ("mean_word_length", "double"), ("symbol_share", "double"), ("end_mark_share", "double"), ("common_word_share", "double"),
    ("digit_share", "double"), ("repeated_line_share", "double"), ("repeated_paragraph_share", "double"), ("top_ngram_cover", "double"),
    ("item_share", "double"), ("cell_share", "double"), ("rubbish_share", "double"), ("form", "string"),
]
NOTHING = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)


EDGES = ".,;:!?।॥\"'“”‘’()[]۔؟،、。！？，|"


def _symbols(text: str) -> int:
    return sum(map(len, SYMBOL.findall(text)))


def _repeated(parts: list[str]) -> float:
    """Share of the characters that lie in parts seen before."""
    total = sum(map(len, parts))
    if not total or len(parts) < 2:
        return 0.0
    seen: set[str] = set()
    again = 0
    for p in parts:
        if p in seen:
            again += len(p)
        seen.add(p)
    return again / total


def _ngram_cover(words: list[str]) -> float:
    """Largest share of the characters that one word n-gram (n = 1, 2, 4) covers, for texts of 20 words or more."""
    if len(words) < 20:
        return 0.0
    total, best = sum(map(len, words)), 0.0
    for n in (1, 2, 4):
        grams = Counter(zip(*(words[i:] for i in range(n)), strict=False)) if n > 1 else Counter(words)
        gram, k = grams.most_common(1)[0]
        if k > 1:
            best = max(best, min(1.0, k * (len(gram) if n == 1 else sum(map(len, gram))) / total / (1 if n == 1 else n if len(set(gram)) == 1 else 1)))
    return min(best, 1.0)


def _cells(lines: list[str]) -> list[bool]:
    """Which lines are rows of cells: one delimiter cuts most lines alike into short fields."""
    n = len(lines)
    best = [False] * n
    if n < 3:
        return best
    for d in DELIMITERS:
        counts = [len(d.findall(x.strip(" "))) for x in lines]
        common = Counter(c for c in counts if c > 0).most_common(1)
        if not common or common[0][1] < 3:
            continue
        width = common[0][0]
        rows = [bool(c) and abs(c - width) <= (1 if width > 1 else 0) or bool(RULE.match(x)) and bool(x.strip()) for c, x in zip(counts, lines, strict=True)]
        cells = [f for r, x in zip(rows, lines, strict=True) if r and not RULE.match(x) for f in d.split(x)]
        if not cells or width < 2 and d.pattern != r"\|" and d.pattern != r"\t" and not all(re.search(r"\d", x) for r, x in zip(rows, lines, strict=True) if r):
            continue
        if sum(len(c.split()) for c in cells) <= 3.0 * len(cells) and sum(map(len, cells)) <= 28 * len(cells) and sum(rows) > sum(best):
            best = rows
    return best


def measure(text: str | None, common: frozenset[str], common_cjk: frozenset[str]) -> tuple:
    """The values of FIELDS. Null, empty and blank texts have zeros and no form."""
    if text is None or not text.strip():
        return NOTHING
    plain = INVISIBLE.sub("", TAG.sub("\n", text))
    n_control = sum(len(m) for m in CONTROL.findall(plain))
    plain = CONTROL.sub(" ", plain).replace(" ", " ")
    lines = [x.rstrip() for x in plain.split("\n") if x.strip()]
    chars = sum(len(x.strip()) for x in lines)
    if not chars:
        return (*NOTHING[:11], 1.0, "junk")
    words = plain.split()
    cjk = len(HAN.findall(plain))
    stripped = [w.strip(EDGES).lower() for w in words]
    digits = sum(map(len, re.findall(r"\d+", plain)))
    solid = sum(map(len, words))
    symbols = _symbols(plain)
    letters = solid - symbols - digits
    # what few documents have is looked for line by line only where the document has it
    has_long, has_mojibake = bool(LONG.search(plain)), bool(MOJIBAKE.search(plain))
    has_broken = len(BROKEN.findall(plain)) > 0.1 * len(words)
    if cjk > letters // 2:
        n_words = max(len(words), cjk * 2 // 3)
        common_share = min(1.0, 1.5 * sum(plain.count(w) * len(w) for w in common_cjk) / max(1, cjk))
    else:
        n_words = len(words)
        common_share = sum(w in common for w in stripped) / max(1, len(words))
    ended = [bool(END.search(x)) for x in lines]
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", plain) if p.strip()]
    cover = _ngram_cover(words)
    cells = _cells(lines)
    any_cells = any(cells)
    item = cell = rubbish = 0
    for x, is_cell, is_end in zip(lines, cells, ended, strict=True):
        s = x.strip()
        size = len(s)
        ws = s.split()
        han = len(HAN.findall(s)) if cjk else 0
        good = sum(map(len, ws)) - _symbols(s)
        if is_cell and good or any_cells and RULE.match(s):
            cell += size
        elif has_long and not han and sum(map(len, LONG.findall(s))) > size // 2:
            rubbish += size
        elif good < 0.4 * sum(map(len, ws)) and not LEADER.search(s) and not (MARKER.match(s) and good):
            rubbish += size
        elif has_mojibake and sum(m.end() - m.start() for m in MOJIBAKE.finditer(s)) > 0.4 * size:
            rubbish += size
        elif has_broken and len(BROKEN.findall(s)) > max(2, 0.25 * len(ws)):
            rubbish += size
        elif LEADER.search(s):
            item += size
        else:
            body = MARKER.sub("", s).rstrip(",;、，；")
            few = len(body.split()) <= 6 and (not han or han <= 14)
            known = sum(w.strip(EDGES).lower() in common for w in body.split()) if few else 0
            closed = is_end and not re.match(r"^\S{1,3}\.$", s)
            if not re.search(r"[^\W\d_]", s):
                continue
            if few and not closed and (known <= 1 or MARKER.match(s)):
                item += size
            elif few and MARKER.match(s) and known == 0 and len(body.split()) <= 4:
                item += size
    total = max(1, chars)
    rubbish_share = (rubbish + n_control) / (total + n_control)
    repeated_line, repeated_par = _repeated([x.strip() for x in lines]), _repeated(paragraphs)
    varied = len(set(stripped)) / max(1, len(stripped))
    odd = symbols - plain.count(".") - plain.count("_") - plain.count("…") - plain.count("·")
    if rubbish_share > 0.5 or (odd > 0.4 * solid and not any_cells and solid > 20) or cover > 0.5 or (len(words) >= 30 and varied < 0.08 and not any_cells) or (repeated_line > 0.8 and len(lines) > 5 and cell <= 0.5 * total):
        form = "junk"
    elif cell > 0.5 * total:
        form = "table"
    elif item > 0.6 * total and len(lines) >= 4:
        form = "list"
    else:
        form = "prose"
    return (
        n_words, solid / max(1, n_words), symbols / max(1, solid), sum(ended) / len(lines), common_share, digits / max(1, solid),
        repeated_line, repeated_par, cover, item / total, cell / total, rubbish_share, form,
    )


def _rows(common: frozenset[str], common_cjk: frozenset[str], kind: str):
    types = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t, common, common_cjk) for t in b.column(1).to_pylist()]
            cols = [pa.array([g[i] for g in got], types[t]) for i, (_, t) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["_key", *(n for n, _ in FIELDS)])

    return run


def text_statistics(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", max_common: int = 20_000) -> DataFrame:
    """``key`` and FIELDS of every row, as many rows as there are documents.

    form is prose, list, table or junk, and null for null, empty and blank texts.
    common_words (lang, word) is a small fixed table; more than ``max_common`` words
    are refused. Repeated rows are measured each; extra columns are left behind."""
    words = [r["word"] for r in common_words.select(F.lower("word").alias("word")).where("word is not null").distinct().limit(max_common + 1).collect()]
    if len(words) > max_common:
        raise ValueError(f"more than {max_common} common words")
    cjk = frozenset(w for w in words if HAN.search(w))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {kind}, " + ", ".join(f"{n} {t}" for n, t in FIELDS)
    return rows.mapInArrow(_rows(frozenset(words) - cjk, cjk, kind), schema).withColumnRenamed("_key", key)
