"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SEGMENT_COLUMNS = ["segment_key", "doc_id", "seq", "id", "source_text", "segment_type", "pause_after_ms", "page", "paragraph", "origin"]
#: Segments once each: a row delivered again differs in loaded_at only.
SEGMENTS_SQL = f"(SELECT DISTINCT {', '.join(SEGMENT_COLUMNS)} FROM segments)"
OFFSETS_SQL = "(SELECT DISTINCT doc_id, chunk_id, start_seconds, end_seconds, source_text FROM offsets)"
FEEDBACK_SQL = "(SELECT DISTINCT doc_id, issue_id, reviewer_number, timestamp, page, category, reviewer_text, verification_status FROM feedback)"
PASSAGES_SQL = "(SELECT DISTINCT doc_id, id, text, page, pdf_page, speech, mode, kind, pause, rate, pitch, volume, take, parents FROM passages)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as the query of its name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def segments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Segments once each, with the columns asked for only: the distinct shuffles no more than it must."""
    wanted = list(columns) or SEGMENT_COLUMNS
    key = ["segment_key"] if "segment_key" not in wanted else []
    return load(spark, d, "segments").select(*key, *wanted).dropDuplicates(["segment_key"]).select(*wanted)


def offsets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "offsets").select("doc_id", "chunk_id", "start_seconds", "end_seconds", "source_text").distinct()


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "feedback").drop("received_at").distinct()


def passages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "passages").distinct()

