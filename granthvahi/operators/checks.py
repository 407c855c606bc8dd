"""Contracts of segments and of what is made from them, as rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNCLEAR, finding_id, word_count

# Limits of pauses and of pace, and the two marks of unreadable text.
LONGEST_PAUSE = 30_000
PACE_AT_SYNTHESIS, PACE_IN_REVIEW, PACE_OF_BOOK = (115, 175), (90, 200), (110, 180)
UNREADABLE = "[???????]"
# Misreadings that reviewers have confirmed.
CONFIRMED_MISREADINGS = {"साधिपए": "साधिये"}


def _found(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks]))


def segment_faults(segments: DataFrame, key: str) -> DataFrame:
    """key, id, fault: one row per broken rule of a segment. An id that repeats in a
    document is found by counting, not by a window, so no document has to fit into a task."""
    text = F.coalesce(F.col("source_text"), F.lit(""))
    pause = F.coalesce(F.col("pause_after_ms"), F.lit(0))
    have = set(segments.columns)
    shape = lambda c, p: ~F.coalesce(F.col(c), F.lit("+0%" if c != "pitch" else "+0Hz")).rlike(p)
    checks = [
        ("invalid_id", ~F.coalesce(F.col("id"), F.lit("")).rlike(r"^[A-Za-z0-9_-]{1,80}$")),
        ("empty_text", F.trim(text) == ""),
        ("unclear_text", text.contains(UNCLEAR) | text.contains(UNREADABLE)),
        ("pause_out_of_range", ~pause.between(0, LONGEST_PAUSE)),
        *[(f"invalid_{c}", shape(c, p)) for c, p in (("rate", r"^[+-][0-9]+%$"), ("pitch", r"^[+-][0-9]+Hz$"), ("volume", r"^[+-][0-9]+%$")) if c in have],
    ]
    rows = segments.select(key, "id", F.explode(_found(checks)).alias("fault"))
    twice = segments.groupBy(key, "id").agg(F.count("*").alias("_n")).where("_n > 1").select(key, "id", F.lit("duplicate_id").alias("fault"))
    return rows.unionByName(twice)


def text_anomalies(segments: DataFrame) -> DataFrame:
    """finding_id, id, code, severity of confirmed misreadings, unreadable marks and tokens of two scripts."""
    text = F.coalesce(F.col("source_text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([ऀ-ॿ]+)"), F.lit(1))
    checks = [
        ("known_ocr_anomaly", F.arrays_overlap(words, F.array(*[F.lit(w) for w in CONFIRMED_MISREADINGS]))),
        ("unresolved_ocr", text.contains(UNREADABLE)),
        ("mixed_script_token", text.rlike(r"[ऀ-ॿ]{2,}[A-Za-z]{2,}|[A-Za-z]{2,}[ऀ-ॿ]{2,}")),
    ]
    rows = segments.select("id", text.alias("_t"), F.explode(_found(checks)).alias("code"))
    severity = F.when(F.col("code") == "unresolved_ocr", "blocker").otherwise("review")
    return rows.select(finding_id(F.col("id").cast("string"), F.col("code"), F.col("_t")).alias("finding_id"), "id", "code", severity.alias("severity"))


def drift(segments: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fault: what was made from other text than the segment's (source_drift), from no
    segment (orphan), or not at all (missing). Both have source_text; rows with one key are compared once."""
    s = segments.groupBy(*keys).agg(F.max("source_text").alias("_s"), F.lit(True).alias("_in_s"))
    m = made.groupBy(*keys).agg(F.max("source_text").alias("_m"), F.lit(True).alias("_in_m"))
    both = s.join(m, keys, "full_outer")
    fault = F.when(F.col("_in_m").isNull(), "missing").when(F.col("_in_s").isNull(), "orphan").when(F.col("_m").isNotNull() & ~F.col("_s").eqNullSafe(F.col("_m")), "source_drift")
    return both.withColumn("fault", fault).where("fault is not null").select(*keys, "fault")


def words_per_minute(text: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(word_count(text) * 60.0 / seconds, 1))


def pace_fault(words: Column, wpm: Column, limits: tuple[int, int] = PACE_IN_REVIEW, least_words: int = 12) -> Column:
    return (words >= least_words) & ((wpm < limits[0]) | (wpm > limits[1]))


def verdict(blockers: Column, warnings: Column) -> Column:
    return F.when(blockers > 0, "fail").when(warnings > 0, "review_required").otherwise("pass")


def signal_statistics(samples: Column) -> Column:
    """Peak, root mean square, share of silence and of clipping of an array of samples in -1..1."""
    n = F.size(samples)
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    share = lambda f: F.size(F.filter(samples, f)) / n
    return F.struct(
        F.round(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), 4).alias("peak"), F.round(F.sqrt(total / n), 4).alias("rms"),
        F.when(n == 0, 1.0).otherwise(F.round(share(lambda x: F.abs(x.cast("double")) < 164 / 32768), 4)).alias("silence_ratio"),
        F.when(n == 0, 0.0).otherwise(F.round(share(lambda x: F.abs(x.cast("double")) >= 32700 / 32768), 4)).alias("clipped_ratio"),
    )


def risk_sample(rows: DataFrame, id_: str, risky: Column, percent: float, most: int, seed: str) -> DataFrame:
    """Risky rows first, filled up to max(risky, percent of all) but never beyond ``most``,
    in the order of a hash of seed and id. A top-k, so no rows are sorted that can't be in it."""
    counts = rows.agg(F.count("*").alias("n"), F.sum(risky.cast("int")).alias("r")).first()
    n, r = counts["n"] or 0, counts["r"] or 0
    target = min(most, max(r, int(-(-(n * percent / 100 - 0.5) // 1)) if n else 0))
    order = [risky.cast("int").desc(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256), F.col(id_)]
    return rows.withColumn("risky", risky).orderBy(*order).limit(target)


def count_faults(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """key and both counts of the groups that don't have as many rows in one stage as in the other."""
    one, other = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in zip((a, b), names, strict=True))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0).cast("bigint")).alias(n)
    return one.join(other, key, "full_outer").select(key, *map(zero, names)).where(F.col(names[0]) != F.col(names[1]))


def audio_findings(chunks: DataFrame, keys: list[str], clipped: str | None = None, silence: str | None = None) -> DataFrame:
    """keys, code, severity of spoken chunks (source_text, seconds, and shares of clipped samples and
    of silence where there are columns for them). What is incomplete or invalid is not looked at further."""
    words = word_count(F.col("source_text"))
    incomplete = F.col("seconds").isNull() | F.col("source_text").isNull()
    valid = ~incomplete & (F.col("seconds") > 0)
    found = [("audio_incomplete", incomplete), ("audio_invalid", ~incomplete & (F.col("seconds") <= 0))]
    if clipped:
        found.append(("clipping", valid & (F.col(clipped) > 0.001)))
    if silence:
        found.append(("excessive_silence", valid & (words >= 8) & (F.col(silence) > 0.65)))
    found.append(("pace_outlier", valid & pace_fault(words, words_per_minute(F.col("source_text"), F.col("seconds")))))
    warning = F.col("code").isin("excessive_silence", "pace_outlier")
    return chunks.select(*keys, F.explode(_found(found)).alias("code")).withColumn("severity", F.when(warning, "warning").otherwise("blocker"))
