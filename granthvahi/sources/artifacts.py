"""Reading and writing artifacts: segments, rules, lexicons, histories, scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = "array<struct<stage:string,kind:string,source:string,replacement:string,reason:string>>"
SEGMENTS = (
    f"id string, source_text string, normalized_text string, pronunciation_text string, segment_type string, rate string, pitch string, volume string, "
    f"pause_before_ms int, pause_after_ms int, page int, paragraph int, integrity_audit {AUDIT}"
)


def read_json_list(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSON list of objects as rows. Tolerant: what is missing or can't be read gives
    nulls, no file no rows. Strict: it is an error."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if strict or _exists(spark, path):
        return reader.json(path)
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_segments(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return read_json_list(spark, path, SEGMENTS, strict)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a lexicon file: a list, or an object whose ``rules`` is one."""
    entry = "source string, tts_alias string, language string, context string, confidence string, category string, notes string"
    rows = read_json_list(spark, path, f"{entry}, rules array<struct<{', '.join(c.replace(' ', ':') for c in entry.split(', '))}>>")
    names = [c.split(" ")[0] for c in entry.split(", ")]
    one = F.when(F.col("rules").isNotNull(), F.col("rules")).otherwise(F.array(F.struct(*names)))
    return rows.select(F.posexplode(one).alias("position", "e")).select("position", "e.*")


def read_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The corrections of a ledger file; no file means no corrections."""
    inner = ", ".join(c.strip().replace(" ", ":", 1) for c in schema.split(","))
    return read_json_list(spark, path, f"version int, corrections array<struct<{inner}>>").select(F.explode("corrections").alias("r")).select("r.*")


def append_history(df: DataFrame, path: str, stage: str) -> None:
    """A copy of an artifact in an append-only table by stage; Spark's commit makes it all or nothing."""
    df.withColumn("stage", F.lit(stage)).withColumn("created_at", F.current_timestamp()).write.mode("append").partitionBy("stage").parquet(path)


def selected_pages(pages: DataFrame, wanted: list[int] | None = None, first: int | None = None) -> DataFrame:
    """The pages asked for (from 1), else the first so many, else all."""
    if wanted is not None:
        return pages.where(F.col("page").isin(wanted))
    return pages if first is None else pages.where(F.col("page") <= first)


def join_pages(pages: DataFrame, key: str) -> DataFrame:
    """key, text: non-blank pages in order, each behind its page mark."""
    one = F.concat(F.lit("<metadata_page>"), F.col("page").cast("string"), F.lit("</metadata_page>\n"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("page", one.alias("t"))))
    return pages.where(F.col("text").rlike(r"\S")).groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"))


def checkpoint_manifest(pages: DataFrame, key: str) -> DataFrame:
    """key, n_pages, pages: what of each document has been read."""
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.sort_array(F.collect_set("page")).alias("pages"))


def repeated_overlays(blocks: DataFrame, key: str, text: str, page: str) -> DataFrame:
    """key, text of margin texts on at least max(2, min(5, a third of the document's pages)) pages' blocks."""
    pages = blocks.groupBy(key).agg(F.count_distinct(page).alias("_n"))
    least = F.greatest(F.lit(2), F.least(F.lit(5), F.floor((F.col("_n") + 2) / 3)))
    counts = blocks.where(F.col(text).rlike(r"\S")).groupBy(key, text).agg(F.count("*").alias("_c"))
    return counts.join(pages, key).where(F.col("_c") >= least).select(key, text)


def boxes_meet(a: str, b: str) -> Column:
    """Whether two boxes (structs x0, y0, x1, y1) overlap."""
    c = F.col
    return (c(f"{a}.x0") < c(f"{b}.x1")) & (c(f"{b}.x0") < c(f"{a}.x1")) & (c(f"{a}.y0") < c(f"{b}.y1")) & (c(f"{b}.y0") < c(f"{a}.y1"))
