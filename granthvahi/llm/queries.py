"""The queries of the problems 1 to 9 and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .language import language_stretches, languages_beside_label
from .lookalikes import same_look, unify
from .nearest_time import nearest, read_seconds
from .packing import pack
from .scans import page_damage, repaired_pages
from .quality import text_statistics
from .sentences import sentence_cuts, sentence_units
from .splitting import split_oversized
from .tokenize import token_counts, token_ids

Query = Callable[[SparkSession, str], DataFrame]


def limit_of(spark: SparkSession, d: str, name: str) -> tuple[str, int, int]:
    """unit, max_size and overlap_size of a row of size_limits (a fixed table of four)."""
    r = load(spark, d, "size_limits").where(F.col("limit_name") == name).first()
    return r["unit"], int(r["max_size"]), int(r["overlap_size"])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    seg, doc = load(spark, d, "segments"), load(spark, d, "documents")
    a = seg.select(F.lit("segment").alias("kind"), F.col("segment_key").alias("key"), F.col("source_text").alias("text"), "lang")
    return a.unionByName(doc.select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), "text", "lang"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages in which a record holds a sentence and which its label does not name."""
    got = languages_beside_label(_labelled(spark, d), load(spark, d, "common_words"))
    return got.select("kind", F.col("key").alias("rec_key"), "lang")


def p1_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every record's stretches of one language with a confidence."""
    return language_stretches(_labelled(spark, d), load(spark, d, "common_words")).withColumnRenamed("key", "rec_key")


def _pieces(spark: SparkSession, d: str, oversized_only: bool) -> DataFrame:
    parts = []
    for kind, name, table, text in (("segment", "segment_size", "segments", "source_text"), ("passage", "passage_size", "passages", "text")):
        unit, size, overlap = limit_of(spark, d, name)
        got = split_oversized(load(spark, d, table), ["doc_id", "id"], text, size, overlap, unit, oversized_only)
        parts.append(got.withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that come out in more than one piece."""
    return _pieces(spark, d, True).where("piece = 1").select("kind", "doc_id", "id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every segment and passage as pieces within its limit."""
    return _pieces(spark, d, False).select("kind", "doc_id", "id", "piece", "start_at", "end_at", "piece_text")


def _typed_segments(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "segments").where("origin is distinct from 'ocr'").select("segment_key", "source_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Where each sentence but the first of a segment begins."""
    return sentence_cuts(_typed_segments(spark, d), "segment_key", "source_text")


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every segment in order, whatever its origin. A scanned page's line ends
    are no ends of sentences: where no mark stands before one it is read as a blank, places unchanged."""
    rows = load(spark, d, "segments").select("segment_key", "source_text", "origin").distinct()
    flowing = F.regexp_replace("source_text", r"(?<=[^\n।॥.?!؟۔。！？|\"”’])\n(?=[^\n])", " ")
    text = F.when(F.coalesce(F.col("origin") == "ocr", F.lit(False)), flowing).otherwise(F.col("source_text"))
    return sentence_units(rows.select("segment_key", text.alias("source_text")), "segment_key", "source_text")


def _named_values(spark: SparkSession, d: str) -> DataFrame:
    seg, lex = load(spark, d, "segments"), load(spark, d, "lexicon")
    parts = [(seg, "segment", "segment_key", "source_text"), (lex, "lexicon_source", "entry_id", "source"), (lex, "lexicon_alias", "entry_id", "tts_alias")]
    got = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(text).alias("text")) for df, kind, key, text in parts]
    return got[0].unionByName(got[1]).unionByName(got[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that look the same but are stored with other characters."""
    return same_look(_named_values(spark, d))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every value in which scripts were mixed."""
    return unify(_named_values(spark, d))[1].select("kind", "key", "form").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each readable note with the chunk that starts nearest to it."""
    _, tolerance, _ = limit_of(spark, d, "note_distance")
    notes = load(spark, d, "feedback").select(F.col("doc_id").alias("entity"), F.col("issue_id").alias("id"), read_seconds(F.col("timestamp")).alias("t"))
    chunks = load(spark, d, "offsets").select(F.col("doc_id").alias("entity"), F.col("chunk_id").alias("id"), F.col("start_seconds").alias("t"))
    got = nearest(notes, chunks, tolerance)
    return got.select(F.col("entity").alias("doc_id"), F.col("id").alias("issue_id"), F.col("target_id").alias("chunk_id"))


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scanned pages with their book's title, and typed text with titles and headings."""
    seg = load(spark, d, "segments")
    books = load(spark, d, "projects").groupBy("id").agg(F.max("display_name").alias("title"))
    pages = seg.where("origin = 'ocr'").select(F.col("segment_key").alias("key"), "doc_id", F.col("source_text").alias("text"), "page")
    # Catalyst broadcasts the books while they are small and sorts both sides beyond
    pages = pages.join(books, F.col("doc_id") == F.col("id"), "left").select("key", "text", "title", "page")
    heading = F.coalesce(F.col("segment_type").isin("heading", "subheading"), F.lit(False))
    typed = seg.where("origin is distinct from 'ocr'").select(F.col("source_text").alias("text"), heading.alias("heading"))
    return pages, typed.unionByName(books.select(F.col("title").alias("text"), F.lit(True).alias("heading")))


def _common(spark: SparkSession, d: str, most: int = 20_000) -> frozenset[str]:
    """The words of common_words, a fixed table; more than ``most`` are refused."""
    words = [r["word"] for r in load(spark, d, "common_words").select(F.lower("word").alias("word")).where("word is not null").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} common words")
    return frozenset(words)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of damage of each scanned segment."""
    pages, typed = _scanned(spark, d)
    return page_damage(pages, typed, _common(spark, d)).withColumnRenamed("key", "segment_key")


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of each scanned segment."""
    pages, typed = _scanned(spark, d)
    return repaired_pages(pages, typed, _common(spark, d)).distinct().withColumnRenamed("key", "segment_key")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(load(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of container_size tokens."""
    _, capacity, _ = limit_of(spark, d, "container_size")
    return pack(token_counts(load(spark, d, "documents")), "doc_id", "n_tokens", capacity)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly a list, a table or junk."""
    got = text_statistics(load(spark, d, "documents"), load(spark, d, "common_words"))
    return got.where("form in ('list', 'table', 'junk')").select("doc_id", "form").distinct()


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and form of every document."""
    return text_statistics(load(spark, d, "documents"), load(spark, d, "common_words"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_stretches, p2_found, p2_pieces, p3_found, p3_sentences, p4_found, p4_repaired, p5_found, p6_found, p6_repaired, p7_ids, p8_containers, p9_found, p9_statistics)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT DISTINCT 'segment' AS kind, s.doc_id, s.id FROM segments s, size_limits l
            WHERE l.limit_name = 'segment_size' AND length(s.source_text) > l.max_size
            UNION
            SELECT DISTINCT 'passage' AS kind, p.doc_id, p.id FROM passages p, size_limits l
            WHERE l.limit_name = 'passage_size' AND strlen(p.text) > l.max_size""",
        "p5_found": r"""
            WITH x AS (SELECT DISTINCT doc_id, issue_id, lower(trim(translate(timestamp, '०१२३४५६७८९', '0123456789'))) AS s FROM feedback),
            p AS (SELECT *, regexp_extract(s, '^(\d+)[:.](\d{1,2})[:.](\d{1,2})$', ['h', 'm', 's']) AS a, regexp_extract(s, '^(\d+)[:.](\d{1,2})$', ['m', 's']) AS b,
                  regexp_extract(s, '^(?:(\d+)\s*h)?\s*(?:(\d+)\s*m)?\s*(?:(\d+)\s*s)?$', ['h', 'm', 's']) AS c FROM x),
            n AS (SELECT doc_id, issue_id, CASE WHEN regexp_full_match(s, '\d+') THEN CAST(s AS DOUBLE)
                  WHEN a.h <> '' AND CAST(a.m AS INT) < 60 AND CAST(a.s AS INT) < 60 THEN CAST(a.h AS DOUBLE) * 3600 + CAST(a.m AS DOUBLE) * 60 + CAST(a.s AS DOUBLE)
                  WHEN b.m <> '' AND CAST(b.s AS INT) < 60 THEN CAST(b.m AS DOUBLE) * 60 + CAST(b.s AS DOUBLE)
                  WHEN c.h || c.m || c.s <> '' THEN coalesce(TRY_CAST(c.h AS DOUBLE), 0) * 3600 + coalesce(TRY_CAST(c.m AS DOUBLE), 0) * 60 + coalesce(TRY_CAST(c.s AS DOUBLE), 0) END AS t FROM p),
            o AS (SELECT DISTINCT doc_id, chunk_id, start_seconds FROM offsets WHERE start_seconds IS NOT NULL AND chunk_id IS NOT NULL)
            SELECT doc_id, issue_id, chunk_id FROM (
                SELECT n.doc_id, n.issue_id, o.chunk_id, row_number() OVER (PARTITION BY n.doc_id, n.issue_id ORDER BY round(abs(o.start_seconds - n.t), 6), o.start_seconds, o.chunk_id) AS r
                FROM n JOIN o ON o.doc_id = n.doc_id JOIN size_limits l ON l.limit_name = 'note_distance'
                WHERE n.t IS NOT NULL AND round(abs(o.start_seconds - n.t), 6) <= l.max_size) WHERE r = 1""",
    }
