"""Comparing texts: transcripts, phrases heard and written down, search."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.functions import pandas_udf

from ..functions.text import let, page_query, roman_note, romanize, tokens


@pandas_udf(ty.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / length of both by longest matching blocks; 0 beside a null."""
    ratio = lambda x, y: 0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio()
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])


@pandas_udf(ty.StructType([ty.StructField("omissions", ty.ArrayType(ty.StringType())), ty.StructField("additions", ty.ArrayType(ty.StringType())), ty.StructField("coverage", ty.DoubleType())]))
def token_difference(expected: pd.Series, heard: pd.Series) -> pd.DataFrame:
    """Words left out, words put in, and the share of expected words that were heard."""
    out = []
    for a, b in zip(expected, heard, strict=True):
        a, b = list(a) if a is not None else [], list(b) if b is not None else []
        left, put, kept = [], [], 0
        for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if op == "equal":
                kept += j - i
            else:
                left += a[i:j]
                put += b[k:m]
        out.append((left, put, round(kept / len(a), 4) if a else None))
    return pd.DataFrame(out, columns=["omissions", "additions", "coverage"])


def word_errors(expected: Column, heard: Column) -> Column:
    """Edits between two arrays of words: each word becomes one character of its own, so
    the built-in distance counts words, for any number of different words Unicode has room for;
    a pair with more (over a million) is an error."""
    pair = F.struct(expected.alias("a"), heard.alias("b"), F.array_distinct(F.concat(expected, heard)).alias("both"))
    coded = lambda x, ws: F.array_join(F.transform(ws, lambda w: _sign(F.array_position(x["both"], w))), "")
    return let(pair, lambda x: F.when(x["a"] == x["b"], 0).otherwise(F.levenshtein(coded(x, x["a"]), coded(x, x["b"]))))


def _sign(position: Column) -> Column:
    """A character of its own for each number from 1, beyond the surrogates; above Unicode's end an error."""
    code = position.cast("bigint") + 0xE000
    safe = F.when(code > 0x10FFFF, F.raise_error(F.lit("too many different words for a word distance")).cast("bigint")).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def error_rates(expected: Column, heard: Column) -> Column:
    """wer and cer (4 places) of texts; null where nothing was expected."""
    def rates(x: Column) -> Column:
        n, m = F.nullif(F.size(x["a"]), F.lit(0)), F.nullif(F.length(x["ja"]), F.lit(0))
        letters = F.when(x["ja"] == x["jb"], 0).otherwise(F.levenshtein(x["ja"], x["jb"]))
        return F.struct(F.round(word_errors(x["a"], x["b"]) / n, 4).alias("wer"), F.round(letters / m, 4).alias("cer"))

    words = F.struct(tokens(expected).alias("a"), tokens(heard).alias("b"))
    both = let(words, lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), F.array_join(w["a"], " ").alias("ja"), F.array_join(w["b"], " ").alias("jb")))
    return let(both, rates)


def search(passages: DataFrame, query: str, id_: str = "id", text: str = "text", page: str = "page", speech: str = "speech") -> DataFrame:
    """Passages a query names exactly: a page, else an id, else a phrase in the text or its
    spoken form, whatever its case. A blank query names all.

    A query that reads as a time belongs to ``points_in_intervals``; here it finds nothing."""
    q = F.lit(query.strip())
    asked = page_query(q)
    by_page = F.lower(F.col(page)) == F.lower(asked)
    said = F.concat_ws("\n", F.col(text), F.col(speech)) if speech in passages.columns else F.col(text)
    by_text = (F.col(id_) == q) | F.lower(said).contains(F.lower(q))
    timed = q.rlike(r"^\d+:\d{2}(?::\d{2})?(?:\.\d+)?$")
    return passages.where(F.coalesce(F.when(timed, F.lit(False)).when(asked.isNotNull(), by_page).otherwise(by_text), F.lit(False)))


def search_likely(passages: DataFrame, query: str, keys: list[str], text: str = "text", best: int = 10, least: float = 0.55) -> DataFrame:
    """keys, score of the ``best`` passages whose likeliest run of words resembles the query,
    for queries that name nothing exactly: runs of as many words as the query has, by matching
    blocks; a query in Latin letters is compared with romanised sentences too. Equal scores go by keys."""
    from .phrases import SENTENCE_END, best_of_block, ratios
    from .phrases import Starts

    width, q = max(1, len(query.split())), query.strip()

    @pandas_udf(ty.DoubleType())
    def windows(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = t.split() if t else []
            runs = list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(len(words))))
            out.append(float(ratios(q, runs).max()) if runs else 0.0)
        return pd.Series(out)

    @pandas_udf(ty.DoubleType())
    def heard(notes: pd.Series, sentences: pd.Series) -> pd.Series:
        out = []
        for note, have in zip(notes, sentences, strict=True):
            have = [s for s in have if s] if have is not None else []
            got = best_of_block(note, Starts(have), [(i,) for i in range(len(have))], 1, 0.0) if note and have else []
            out.append(got[0][0] if got else 0.0)
        return pd.Series(out)

    score = windows(F.col(text))
    if q.isascii():
        spoken = F.transform(F.split(F.col(text), SENTENCE_END), lambda s: roman_note(romanize(s)))
        score = F.greatest(score, heard(roman_note(F.lit(q)), spoken))
    rows = passages.where(F.col(text).isNotNull()).select(*keys, F.round(score, 3).alias("score"))
    return rows.where(F.col("score") >= least).orderBy(F.desc("score"), *keys).limit(best)


def transcript_findings(pairs: DataFrame, keys: list[str], expected: str, heard: str, confidence: str, least_coverage: float = 0.90) -> DataFrame:
    """keys, code: what a listener has to look at. A transcript in Latin letters of a text that has none
    is judged by its length; others by the share of the text they cover, then by any word left out or
    put in; a recogniser that was not sure is a finding of its own. Null transcripts count as empty."""
    a, b = tokens(F.coalesce(F.col(expected), F.lit(""))), tokens(F.coalesce(F.col(heard), F.lit("")))
    devanagari = lambda ws: F.exists(ws, lambda w: w.rlike("[ऀ-ॿ]"))
    rows = pairs.select(*keys, a.alias("_a"), b.alias("_b"), F.coalesce(F.col(confidence), F.lit(0.0)).alias("_c"))
    rows = rows.withColumn("_latin", devanagari(F.col("_a")) & (F.size("_b") > 0) & ~devanagari(F.col("_b"))).withColumn("_ratio", F.size("_b") / F.greatest(F.size("_a"), F.lit(1)))
    # equal word lists never reach Python
    same = rows.where("_a = _b").withColumn("_d", F.lit(None).cast("struct<omissions:array<string>,additions:array<string>,coverage:double>"))
    other = rows.where("_a <> _b").withColumn("_d", token_difference(F.col("_a"), F.col("_b")))
    rows = same.unionByName(other)
    apart = F.when(F.col("_latin"), F.when((F.col("_ratio") < 0.75) | (F.col("_ratio") > 1.35), "transcript_length_anomaly")).otherwise(
        F.when(F.coalesce(F.col("_d.coverage"), F.lit(1.0)) < least_coverage, "transcript_mismatch").when(F.col("_a") != F.col("_b"), "transcript_difference")
    )
    unsure = F.when(F.col("_c") < 0.45, "asr_low_confidence")
    return rows.select(*keys, F.explode(F.array_compact(F.array(apart, unsure))).alias("code"))
