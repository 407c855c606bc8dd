"""One form for text that looks the same (problem 4).

1. Normal form: canonical composition, plain widths and blanks, nothing
   invisible, one composition of each written sign.
2. Script-aware repair: a token that mixes scripts (or whose letters are all
   look-alikes foreign to its record) is rewritten in its dominant script, and
   takes the new form only if the corpus vocabulary holds it as a token of its own.
3. Records whose whole values come out alike but are stored differently are
   paired by a digest of the outcome, so no text is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters of the same shape, Cyrillic and Greek beside Latin.
FOREIGN = "АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϳ"
LATIN = "ABESIJKMHOPCTXYaesijopcxyhdqw" + "ABEZHIKMNOPTYXovij"
TO_LATIN = dict(zip(FOREIGN, LATIN, strict=True))
TO_CYRILLIC = {b: a for a, b in TO_LATIN.items() if "Ѐ" <= a <= "ԯ"}
TO_GREEK = {b: a for a, b in TO_LATIN.items() if "Ͱ" <= a <= "Ͽ"}
# The sign of breath of each script that a colon stands in for.
VISARGA = {"deva": "ः", "beng": "ঃ", "gujr": "ઃ"}
# Spellings of one written sign (independent vowels with a vowel sign, two vowel signs).
COMPOSED = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाे": "ो", "ाै": "ौ",
    "અા": "આ", "અો": "ઓ", "અૌ": "ઔ", "અે": "એ", "અૈ": "ઐ", "અૉ": "ઑ", "આે": "ઓ", "આૈ": "ઔ", "ાે": "ો", "ાૈ": "ૌ",
    "অা": "আ", "ஒள": "ஔ", "ெள": "ௌ",
}
RANGES = {"latn": ("A", "\u024f"), "grek": ("\u0370", "\u03ff"), "cyrl": ("\u0400", "\u052f"), "deva": ("\u0900", "\u097f"), "beng": ("\u0980", "\u09ff"), "gujr": ("\u0a80", "\u0aff"), "taml": ("\u0b80", "\u0bff"), "arab": ("\u0600", "\u06ff")}
# Blocks with marks, format characters or compositions; unified ideographs, Hangul syllables and private use have none.
_CODES = [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x12000), *range(0x1BC00, 0x1BD00), *range(0x1D000, 0x1F000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
INVISIBLE = "[" + "".join(chr(c) for c in _CODES if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)) + "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180e\ufe00-\ufe0f\U000e0100-\U000e01ef\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]"
BLANKS = "[\t\x0b\x0c\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
WIDTHS = "[\uff01-\uffee\ufb00-\ufb06\ufb50-\ufdff\ufe70-\ufefc]"
_ODD = re.compile(f"[{INVISIBLE[1:-1]}{BLANKS[1:-1]}{WIDTHS[1:-1]}]")
_INVISIBLE, _BLANKS, _WIDTHS, _COMPOSED = re.compile(INVISIBLE), re.compile(BLANKS), re.compile(WIDTHS), re.compile("|".join(COMPOSED))


#: Their characters one by one, and the pairs by their first: a text is asked for its different characters only.
_ODD_CHARS = frozenset(c for c in map(chr, range(0x110000)) if _ODD.match(c))
_PAIRS = {a: tuple(p for p in COMPOSED if p[0] == a) for a in {p[0] for p in COMPOSED}}


def normal_form(text: str) -> str:
    """Canonical composition with plain widths and blanks and nothing invisible."""
    t = text
    if t.isascii() and t.isprintable():
        return t
    chars = set(t)
    if not chars.isdisjoint(_ODD_CHARS):
        t = _WIDTHS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
        t = _BLANKS.sub(" ", _INVISIBLE.sub("", t))
    t = unicodedata.normalize("NFC", t)
    for first, pairs in _PAIRS.items():
        if first in chars and any(p in t for p in pairs):
            t = unicodedata.normalize("NFC", _COMPOSED.sub(lambda m: COMPOSED[m[0]], t))
            break
    return text if t == text else t


def _script(c: str) -> str | None:
    for name, (a, b) in RANGES.items():
        if a <= c <= b and (c.isalpha() or unicodedata.category(c)[0] == "M"):
            return name
    return None


def _dominant(text: str) -> str | None:
    count: dict[str, int] = {}
    for c in text:
        if s := _script(c):
            # a letter with a twin elsewhere says less about the script than one without
            count[s] = count.get(s, 0) + (1 if c in TO_LATIN or c in TO_CYRILLIC or c in TO_GREEK else 3)
    return max(count, key=lambda s: (count[s], s == "latn", s)) if count else None


def repair_token(token: str, record_script: str | None) -> str | None:
    """The token in its dominant script, or None if nothing in it has a twin there."""
    own = _dominant(token)
    table: dict[str, str] = {}
    if own in ("grek", "cyrl") and record_script == "latn" and all(c in TO_LATIN for c in token if _script(c) in ("grek", "cyrl")):
        own = "latn"
    if own == "latn" or own is None and record_script == "latn":
        table = TO_LATIN
    elif own == "cyrl":
        table = TO_CYRILLIC
    elif own == "grek":
        table = TO_GREEK
    out = "".join(table.get(c, c) if _script(c) in ("latn", "grek", "cyrl") else c for c in token)
    script = own or record_script
    if script in VISARGA:
        out = re.sub("(?<=[\u0900-\u0963\u0972-\u097f\u0980-\u09e3\u0a80-\u0ae3])[:\ua789]", VISARGA[script], out)
    if script in ("deva", "beng", "gujr"):
        out = re.sub(r"\|\|", "॥", out)
        out = out.replace("|", "।")
        out = re.sub("।।", "॥", out) if "।।" in out else out
    return out if out != token else None


#: Java regex for records that may hold a mixed token.
MIXED = "[\u0370-\u03ff\u0400-\u052f]|[\u0900-\u0963\u0972-\u09e3\u0a80-\u0ae3][:\ua789]|\\||\u0964\u0964"


def _digest(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


#: A partition's words are given out whenever so many different ones are held.
HELD_WORDS = 200_000


def _word_batch(words: set[str]) -> pa.RecordBatch:
    n = len(words)
    nothing = pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([nothing, pa.nulls(n, pa.int64()), nothing, nothing, nothing, pa.array(words, pa.string())], names=FORM_NAMES)


def _normal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of every row, the normal form of rows with mixed tokens, and each word of the normal forms."""
    words: set[str] = set()
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            part = b.slice(lo, 2048)
            raw, canon, form = [], [], []
            for x in part.column(2).to_pylist():
                t = normal_form(x)
                raw.append(_digest(x))
                canon.append(raw[-1] if t is x else _digest(t))
                form.append(t if _MIXED.search(t) else None)
                words.update(t.split())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.string()), pa.array(canon, pa.string()), pa.array(form, pa.string()), pa.nulls(len(raw), pa.string())], names=FORM_NAMES)
            if len(words) > HELD_WORDS:
                yield _word_batch(words)
                words = set()
    if words:
        yield _word_batch(words)


FORM_NAMES = ["kind", "key", "raw", "canon", "form", "word"]
_MIXED = re.compile(MIXED)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, at, token, result = [], [], [], []
        for i, text in enumerate(b.column(3).to_pylist()):
            script = _dominant(text)
            for k, line in enumerate(re.split(r"([ \n])", text)):
                if k % 2 == 0 and line and (_MIXED.search(line)):
                    r = repair_token(line, script)
                    if r is not None:
                        row.append(i), at.append(k), token.append(line), result.append(r)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(at, pa.int32()), pa.array(token, pa.string()), pa.array(result, pa.string())],
            names=["kind", "key", "raw", "at", "token", "result"],
        )


def _attested(results: DataFrame, words: DataFrame) -> DataFrame:
    """(token, result) pairs whose result the corpus vocabulary holds."""
    pairs = results.select("token", "result").distinct()
    return pairs.join(words.select(F.col("word").alias("result")).distinct(), "result", "left_semi")


def unify(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical forms of ``values`` (kind STRING, key BIGINT, text STRING).

    Returns (plain, repaired): plain has kind, key, raw (digest of the stored text),
    canon (digest of the outcome) of every row; repaired has kind, key, raw, form
    (the outcome's text) of the rows that held a mixed token. Rows with a null key
    or text take no part; repeated rows stay repeated."""
    rows = values.where("key is not null and text is not null").select("kind", "key", "text")
    forms = cut(rows.mapInArrow(_normal_rows, "kind string, key bigint, raw string, canon string, form string, word string"))
    words, forms = forms.where("word is not null").select("word"), forms.where("word is null").drop("word")
    mixed = forms.where("form is not null").select("kind", "key", "raw", "form").dropDuplicates(["kind", "key", "raw"])
    tokens = cut(mixed.mapInArrow(_token_rows, "kind string, key bigint, raw string, at int, token string, result string"))
    good = _attested(tokens, words)
    fixes = tokens.join(good, ["token", "result"]).groupBy("kind", "key", "raw").agg(F.map_from_entries(F.collect_list(F.struct("at", "result"))).alias("fix"))
    pieces = F.split(F.regexp_replace("form", "([ \n])", "\u0001$1\u0001"), "\u0001")
    fixed = F.array_join(F.transform(pieces, lambda p, i: F.coalesce(F.element_at("fix", i), p)), "")
    repaired = mixed.join(fixes, ["kind", "key", "raw"]).select("kind", "key", "raw", fixed.alias("form"))
    return forms, repaired


#: Parts into which one side of a class of records is cut.
SALTS = 8


def same_look(values: DataFrame) -> DataFrame:
    """kind, key_a, key_b of the records of a kind whose whole values come out alike
    but are stored differently; key_a < key_b, each pair once."""
    forms, repaired = unify(values)
    fixed = cut(repaired.select("kind", "key", "raw", F.md5("form").alias("canon")))
    plain = forms.select("kind", "key", "raw", "canon")
    out = plain.join(fixed.select("kind", "key", "raw"), ["kind", "key", "raw"], "left_anti").unionByName(fixed)
    out = out.distinct()
    groups = out.groupBy("kind", "canon").agg(F.min("raw").alias("_a"), F.max("raw").alias("_b")).where("_a <> _b").select("kind", "canon")
    near = cut(out.join(groups, ["kind", "canon"], "left_semi"))
    # the partners of a spelling are the records of the other spellings of its class: classes
    # are expanded last, and salted, so that a look shared by many records is many tasks' work
    salt = F.pmod(F.xxhash64("key", "raw"), F.lit(SALTS)).cast("int")
    a = near.select("kind", "canon", F.col("key").alias("key_a"), F.col("raw").alias("raw_a"), salt.alias("_salt"))
    b = near.select("kind", "canon", F.col("key").alias("key_b"), F.col("raw").alias("raw_b"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
    return a.join(b, ["kind", "canon", "_salt"]).where("key_a < key_b and raw_a <> raw_b").select("kind", "key_a", "key_b").distinct()
