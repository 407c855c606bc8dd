"""Rules that change segments: which apply, what they replace, what they remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMOVALS = ("exclude", "delete", "remove")
REWRITES = ("ocr_correction", "source_correction")
RULE_SCHEMA = (
    "rule_id bigint, stage string, kind string, page int, paragraph int, segment_type string, find string, find_text string, "
    "replace string, tts_override string, approved boolean, enabled boolean, status string, reason string, pause_after_ms int"
)


def approved() -> Column:
    """Whether a rule may act: not switched off; else by its own flag; removals and segment
    rules without a status need one; else its status."""
    return (
        F.when(F.col("enabled") == F.lit(False), False)
        .when(F.col("approved").isNotNull(), F.col("approved"))
        .when(F.col("kind").isin(*REMOVALS), False)
        .when(F.col("status").isNull() & F.coalesce(F.col("stage") == "segment", F.lit(False)), False)
        .otherwise(F.coalesce(F.col("status"), F.lit("approved")).isin("approved", "applied"))
    )


def rules_for(rules: DataFrame, stage: str) -> DataFrame:
    return rules.where((F.col("stage") == stage) & F.coalesce(approved(), F.lit(False)))


def needle() -> Column:
    return F.coalesce(F.nullif(F.col("find"), F.lit("")), F.nullif(F.col("find_text"), F.lit("")))


def _prefixed(rules: DataFrame) -> DataFrame:
    return rules.withColumn("_needle", needle()).select(*[F.col(c).alias(c if c == "_needle" else f"r_{c}") for c in [*rules.columns, "_needle"]])


def _with_rules(segments: DataFrame, rules: DataFrame, max_rules: int) -> DataFrame:
    """Each segment with the rules as one array: the rules are a hand-written table, its
    size is checked before it goes to every task."""
    n = rules.count()
    if n > max_rules:
        raise ValueError(f"{n} rules are more than the {max_rules} that may be sent to every task")
    return segments.crossJoin(F.broadcast(_prefixed(rules).agg(F.array_sort(F.collect_list(F.struct("r_rule_id", *[f"r_{c}" for c in rules.columns if c != "rule_id"], "_needle"))).alias("_rules"))))


def _rule_matches(rule: Column, text: Column) -> Column:
    same = lambda c: rule[f"r_{c}"].isNull() | F.coalesce(rule[f"r_{c}"] == F.col(c), F.lit(False))
    return same("page") & same("paragraph") & same("segment_type") & (rule["_needle"].isNull() | F.coalesce(text.contains(rule["_needle"]), F.lit(False)))


def remove_segments(segments: DataFrame, rules: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """Segments that no approved removal matches (kind exclude, delete, remove, or no kind and nothing to put in)."""
    acting = rules_for(rules, "segment").where(F.col("kind").isin(*REMOVALS) | (F.col("kind").isNull() & F.col("replace").isNull() & F.col("tts_override").isNull()))
    rows = _with_rules(segments, acting, max_rules)
    return rows.where(~F.exists("_rules", lambda r: _rule_matches(r, F.col("source_text")))).drop("_rules")


def correct_source(segments: DataFrame, rules: DataFrame, max_rules: int = 10_000) -> DataFrame:
    """Segments with approved rewrites applied in order of rule_id, each on the text the
    one before left, and ``audit``: an entry for each that changed something."""
    acting = rules_for(rules, "segment").where(F.col("kind").isin(*REWRITES) & needle().isNotNull() & F.col("replace").isNotNull())
    entry = "array<struct<stage:string,kind:string,source:string,replacement:string,reason:string>>"

    def apply(a: Column, r: Column) -> Column:
        after = F.replace(a["text"], r["_needle"], r["r_replace"])
        acts = _rule_matches(r, a["text"]) & (after != a["text"])
        note = F.struct(F.lit("segment").alias("stage"), r["r_kind"].alias("kind"), r["_needle"].alias("source"), r["r_replace"].alias("replacement"), F.coalesce(r["r_reason"], F.lit("Approved source correction")).alias("reason"))
        return F.struct(F.when(acts, after).otherwise(a["text"]).alias("text"), F.when(acts, F.array_append(a["audit"], note)).otherwise(a["audit"]).alias("audit"))

    zero = F.struct(F.col("source_text").alias("text"), F.array().cast(entry).alias("audit"))
    done = _with_rules(segments, acting, max_rules).withColumn("_done", F.aggregate("_rules", zero, apply)).drop("_rules")
    return done.withColumn("source_text", F.col("_done.text")).withColumn("audit", F.col("_done.audit")).drop("_done")


def correct_speech(segments: DataFrame, rules: DataFrame, spoken: str, max_rules: int = 10_000) -> DataFrame:
    """Segments with the approved phonetics rules applied to ``spoken`` in order of rule_id, where the
    source has what a rule looks for: its replacement (or the spoken form given) is put in, noted in
    ``audit`` whether or not it changed anything, and the rule's pause, if any, takes the segment's place."""
    acting = rules_for(rules, "phonetics")
    entry = "array<struct<stage:string,kind:string,source:string,replacement:string,reason:string>>"

    def apply(a: Column, r: Column) -> Column:
        new = F.coalesce(F.nullif(r["r_replace"], F.lit("")), r["r_tts_override"], r["r_replace"])
        acts = _rule_matches(r, F.col("source_text"))
        puts = acts & r["_needle"].isNotNull() & new.isNotNull()
        note = F.struct(F.lit("phonetics").alias("stage"), F.coalesce(r["r_kind"], F.lit("pronunciation")).alias("kind"), r["_needle"].alias("source"), new.alias("replacement"), F.coalesce(r["r_reason"], F.lit("Approved project correction")).alias("reason"))
        return F.struct(
            F.when(puts, F.replace(a["text"], r["_needle"], new)).otherwise(a["text"]).alias("text"),
            F.when(puts, F.array_append(a["audit"], note)).otherwise(a["audit"]).alias("audit"),
            F.when(acts, F.coalesce(r["r_pause_after_ms"], a["pause"])).otherwise(a["pause"]).alias("pause"),
        )

    zero = F.struct(F.col(spoken).alias("text"), F.array().cast(entry).alias("audit"), F.col("pause_after_ms").cast("int").alias("pause"))
    done = _with_rules(segments, acting, max_rules).withColumn("_done", F.aggregate("_rules", zero, apply)).drop("_rules")
    return done.withColumn(spoken, F.col("_done.text")).withColumn("audit", F.col("_done.audit")).withColumn("pause_after_ms", F.col("_done.pause")).drop("_done")


def unapproved(rules: DataFrame) -> DataFrame:
    """rule_id, requested, reason of proposed segment changes that nobody has approved."""
    return rules.where((F.col("stage") == "segment") & ~F.coalesce(approved(), F.lit(False))).select("rule_id", needle().alias("requested"), F.coalesce("reason", F.lit("")).alias("reason"))


def unmet_pronunciations(segments: DataFrame, rules: DataFrame, spoken: str, max_rules: int = 10_000) -> DataFrame:
    """Segments whose source holds what an approved phonetics rule looks for but whose spoken text lacks its replacement."""
    acting = rules_for(rules, "phonetics").where(needle().isNotNull() & F.col("replace").isNotNull())
    rows = _with_rules(segments, acting, max_rules)
    missed = F.filter("_rules", lambda r: _rule_matches(r, F.col("source_text")) & ~F.coalesce(F.col(spoken).contains(r["r_replace"]), F.lit(False)))
    return rows.withColumn("rule_id", F.explode(F.transform(missed, lambda r: r["r_rule_id"]))).drop("_rules")


def replace_first(text: Column, find: Column, new: Column) -> Column:
    """The text with the first ``find`` replaced, null unless it occurs exactly once."""
    n = (F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)
    at = F.instr(text, find)
    once = F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(find)))
    return F.when((F.length(find) > 0) & (n == 1), once)
