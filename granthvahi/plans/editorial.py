"""Queries over corrections, contracts, titles, transcripts, states and search.

The SQL writes its patterns and constants out: a wrong one here would not be wrong there too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, corrections, matching, timeline, versions
from ..operators.ordered import numbered
from ..session import load
from .documents import _RULES_SQL, _rules
from .registry import FEEDBACK_SQL, PASSAGES_SQL, SEGMENTS_SQL, feedback, offsets, passages, query, segments


@query(f"""SELECT segment_key, md5(replace(source_text, 'कर्म', 'करम')) AS spoken, CAST(CASE WHEN contains(source_text, 'कर्म') THEN 1 ELSE 0 END AS INTEGER) AS n_audits, pause_after_ms FROM {SEGMENTS_SQL}""")
def speech_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Approved phonetics rules put into the spoken text of every segment, with their audits."""
    rows = segments(spark, d, "segment_key", "source_text", "segment_type", "page", "paragraph", "pause_after_ms").withColumn("spoken", F.col("source_text"))
    got = corrections.correct_speech(rows, _rules(spark), "spoken")
    return got.select("segment_key", F.md5("spoken").alias("spoken"), F.size("audit").alias("n_audits"), "pause_after_ms")


@query(f"""SELECT segment_key, CAST(7 AS BIGINT) AS rule_id FROM {SEGMENTS_SQL} WHERE contains(source_text, 'कर्म') AND NOT contains(replace(source_text, 'कर्म ', 'करम '), 'करम')""")
def pronunciation_contract(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose source asks for an approved pronunciation that the spoken text lacks (here
    one in which only words before a blank were replaced)."""
    spoken = F.replace("source_text", F.lit("कर्म "), F.lit("करम "))
    rows = segments(spark, d, "segment_key", "source_text", "segment_type", "page", "paragraph").withColumn("spoken", spoken)
    return corrections.unmet_pronunciations(rows, _rules(spark), "spoken").select("segment_key", "rule_id")


@query(f"""SELECT rule_id, coalesce(nullif(find, ''), nullif(find_text, '')) AS requested, coalesce(reason, '') AS reason FROM {_RULES_SQL} WHERE stage = 'segment' AND NOT
    CASE WHEN enabled = false THEN false WHEN approved IS NOT NULL THEN approved WHEN kind IN ('exclude', 'delete', 'remove') THEN false WHEN status IS NULL THEN false ELSE status IN ('approved', 'applied') END""")
def unapproved_changes(spark: SparkSession, d: str) -> DataFrame:
    return corrections.unapproved(_rules(spark))


@query(f"""WITH s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, segment_key) AS n, id FROM {SEGMENTS_SQL}),
    o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_seconds, chunk_id) AS n, chunk_id FROM (SELECT DISTINCT doc_id, chunk_id, start_seconds FROM offsets WHERE start_seconds IS NOT NULL AND chunk_id IS NOT NULL)),
    j AS (SELECT coalesce(s.doc_id, o.doc_id) AS doc_id, s.id IS DISTINCT FROM o.chunk_id AS apart, s.n AS sn, o.n AS o_n FROM s FULL JOIN o ON s.doc_id = o.doc_id AND s.n = o.n)
    SELECT doc_id, CAST(sum(CASE WHEN apart THEN 1 ELSE 0 END) AS BIGINT) AS n_apart FROM j GROUP BY doc_id HAVING count(o_n) > 0 AND sum(CASE WHEN apart THEN 1 ELSE 0 END) > 0""")
def timeline_order(spark: SparkSession, d: str) -> DataFrame:
    """Books with a timeline whose chunks don't follow the segments' order, and at how many places."""
    s = numbered(segments(spark, d, "segment_key", "doc_id", "seq", "id"), ["doc_id"], "seq", "n", ["segment_key"]).select("doc_id", "n", "id")
    o = offsets(spark, d).where("start_seconds is not null and chunk_id is not null").select("doc_id", "chunk_id", "start_seconds").distinct()
    o = numbered(o, ["doc_id"], "start_seconds", "n", ["chunk_id"]).select("doc_id", "n", "chunk_id")
    return timeline.order_faults(s, o, "doc_id")


@query(f"""SELECT coalesce(s.doc_id, o.doc_id) AS doc_id, coalesce(s.n, 0) AS n_segments, coalesce(o.n, 0) AS n_spoken FROM (SELECT doc_id, count(*) AS n FROM {SEGMENTS_SQL} GROUP BY 1) s
    FULL JOIN (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM offsets GROUP BY 1) o ON s.doc_id = o.doc_id WHERE coalesce(s.n, 0) <> coalesce(o.n, 0)""")
def count_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Books whose stages don't have the same number of rows."""
    return checks.count_faults(segments(spark, d, "doc_id"), load(spark, d, "offsets").select("doc_id", "chunk_id").distinct().where("chunk_id is not null"), "doc_id", ("n_segments", "n_spoken"))


@query(f"""WITH x AS (SELECT doc_id, chunk_id, len(list_filter(regexp_split_to_array(source_text, '\\s+'), lambda w: w <> '')) AS words, round(end_seconds - start_seconds, 3) AS s, source_text
      FROM (SELECT DISTINCT doc_id, chunk_id, start_seconds, end_seconds, source_text FROM offsets)),
    y AS (SELECT *, round(words * 60.0 / s, 1) AS wpm FROM x)
    SELECT doc_id, chunk_id, 'audio_incomplete' AS code, 'blocker' AS severity FROM y WHERE s IS NULL OR source_text IS NULL
    UNION ALL SELECT doc_id, chunk_id, 'audio_invalid', 'blocker' FROM y WHERE s <= 0 AND source_text IS NOT NULL
    UNION ALL SELECT doc_id, chunk_id, 'pace_outlier', 'warning' FROM y WHERE s > 0 AND source_text IS NOT NULL AND words >= 12 AND (wpm < 90 OR wpm > 200)""")
def audio_findings(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each chunk that was spoken: incomplete, invalid, or too slow or fast."""
    rows = offsets(spark, d).withColumn("seconds", F.round(F.col("end_seconds") - F.col("start_seconds"), 3))
    return checks.audio_findings(rows, ["doc_id", "chunk_id"])


_PATTERN = r"""regexp_replace(regexp_replace(trim(display_name), '([.^$*+?()\[\]{}|\\-])', '\\\1', 'g'), '[\sंँेै]+', '[\\sंँेै]*', 'g')"""


@query(f"""WITH b AS (SELECT id, nullif({_PATTERN}, '') AS p FROM (SELECT id, max(display_name) AS display_name FROM projects GROUP BY id))
    SELECT segment_key, regexp_matches(trim(source_text), '^(?:[\\)\\]\\(\\[\\s—\\-–|।॥]+[०-९\\d]{{1,4}}[\\)\\]\\(\\[\\s—\\-–|।॥]+|[०-९\\d]{{1,4}})$')
      OR coalesce(regexp_matches(trim(source_text), '(?i)^[\\s)\\]\\[(—\\-–|।॥०-९\\d]*(?:' || p || '[\\s)\\]\\[(—\\-–|।॥०-९\\d]*)+$'), false) AS header,
      md5(CASE WHEN p IS NULL OR trim(regexp_replace(source_text, '(?i)[\\s,।॥—\\-–]*(?:' || p || ')[\\s)\\]\\[(—\\-–|।॥०-९\\d]*$', ''), ' ') = '' THEN source_text
        ELSE trim(regexp_replace(source_text, '(?i)[\\s,।॥—\\-–]*(?:' || p || ')[\\s)\\]\\[(—\\-–|।॥०-९\\d]*$', ''), ' ') END) AS kept
    FROM {SEGMENTS_SQL} s LEFT JOIN b ON b.id = s.doc_id WHERE source_text IS NOT NULL""")
def running_headers(spark: SparkSession, d: str) -> DataFrame:
    """Segments that are their book's running header, and their text without one leaked in at the end."""
    books = load(spark, d, "projects").groupBy("id").agg(F.max("display_name").alias("title")).withColumnRenamed("id", "doc_id")
    rows = segments(spark, d, "segment_key", "doc_id", "source_text").where("source_text is not null").join(books, "doc_id", "left")
    return rows.select("segment_key", T.is_running_header(F.col("source_text"), F.col("title")).alias("header"), F.md5(T.drop_trailing_header(F.col("source_text"), F.col("title"))).alias("kept"))


@query(f"""SELECT segment_key, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS listed FROM (SELECT segment_key, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    source_text, '([।॥!?])\\s+', '\\1' || chr(57345), 'g'), '(\\.)\\s+([A-Zऀ-ॿ])', '\\1' || chr(57345) || '\\2', 'g'), chr(57345)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM {SEGMENTS_SQL})""")
def simple_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by marks alone, abbreviations unprotected."""
    parts = F.split("source_text", r"(?<=[।॥!?])\s+|(?<=\.)\s+(?=[A-Zऀ-ॿ])")
    s = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return segments(spark, d, "segment_key", "source_text").select("segment_key", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|")).alias("listed"))


@query("""SELECT user_id, n, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3""")
def versions_up_to(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events numbered as versions, up to the third."""
    rows = load(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return numbered(rows, ["user_id"], "t", "n", ["event_id"], span=86_400_000_000).where("n <= 3").select("user_id", "n", "event_id")


@query("""WITH c AS (SELECT user_id, arg_max(props, (ts, event_id)) AS state FROM events GROUP BY 1)
    SELECT c.user_id, arg_max(e.event_type, (e.ts, e.event_id)) AS status, count(*) AS n FROM c JOIN events e ON e.user_id = c.user_id AND e.props = c.state GROUP BY 1""")
def latest_of_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest event that was made on what a user's state is now."""
    e = load(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "props")
    now = e.groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("state"))
    return versions.latest_applicable(e.withColumnRenamed("props", "state"), now, ["user_id"], "state", "event_type", ["ts", "event_id"])


@query(f"""SELECT doc_id, bool_or(verification_status = 'rejected') AS changes_requested, CAST(sum(CASE WHEN verification_status = 'verified' THEN 1 ELSE 0 END) AS BIGINT) AS n_approved,
    bool_and(verification_status IN ('verified', 'rejected')) AS all_closed FROM {FEEDBACK_SQL} GROUP BY doc_id""")
def approval_state(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("verification_status")
    return feedback(spark, d).groupBy("doc_id").agg(F.bool_or(s == "rejected").alias("changes_requested"), F.sum((s == "verified").cast("bigint")).alias("n_approved"), F.bool_and(s.isin("verified", "rejected")).alias("all_closed"))


@query(f"""WITH m AS (SELECT doc_id, chunk_id AS id, max(sha256(source_text)) AS k, bool_or(start_seconds IS NOT NULL) AS done FROM offsets WHERE source_text IS NOT NULL GROUP BY 1, 2)
    SELECT s.doc_id, s.id, coalesce(m.done AND m.k = sha256(s.source_text), false) AS up_to_date FROM {SEGMENTS_SQL} s LEFT JOIN m ON m.doc_id = s.doc_id AND m.id = s.id""")
def current_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Whether each segment's recording is complete and was made from the text as it is."""
    made = load(spark, d, "offsets").where("source_text is not null").groupBy("doc_id", F.col("chunk_id").alias("id")).agg(F.max(F.sha2("source_text", 256)).alias("fingerprint"), F.bool_or(F.col("start_seconds").isNotNull()).alias("complete"))
    rows = segments(spark, d, "doc_id", "id", "source_text").select("doc_id", "id", F.sha2("source_text", 256).alias("fingerprint"))
    return versions.up_to_date(rows, made, ["doc_id", "id"]).select("doc_id", "id", "up_to_date")


@query(f"""WITH m AS (SELECT sha256(source_text) AS k, min((doc_id, chunk_id)) AS f FROM offsets WHERE source_text IS NOT NULL AND start_seconds IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1)
    SELECT s.segment_key, m.f[1] AS from_doc, m.f[2] AS from_chunk FROM {SEGMENTS_SQL} s JOIN m ON m.k = sha256(s.source_text)""")
def earlier_recordings(spark: SparkSession, d: str) -> DataFrame:
    """For each segment the first recording, of any book, that was made from the same text."""
    made = load(spark, d, "offsets").where("source_text is not null and start_seconds is not null and chunk_id is not null")
    first = made.groupBy(F.sha2("source_text", 256).alias("k")).agg(F.min(F.struct("doc_id", "chunk_id")).alias("f"))
    rows = segments(spark, d, "segment_key", "source_text").select("segment_key", F.sha2("source_text", 256).alias("k"))
    return rows.join(first, "k").select("segment_key", F.col("f.doc_id").alias("from_doc"), F.col("f.chunk_id").alias("from_chunk"))


def _heard(spark: SparkSession, d: str) -> DataFrame:
    """What a recogniser that misses some short words would have heard, with how sure it was."""
    heard = F.regexp_replace("source_text", " (में|के|the|and|der|et|है) ", " ")
    sure = F.when(F.col("segment_key") % 7 == 0, 0.4).otherwise(0.9)
    return segments(spark, d, "segment_key", "source_text").select("segment_key", "source_text", heard.alias("heard"), sure.alias("confidence"))


_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[।॥,.!?;:''\"“”‘’()\\[\\]{{}}—–\\-…]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_HEARD_SQL = f"""(SELECT segment_key, {_WORDS.format(c='source_text')} AS a, {_WORDS.format(c="regexp_replace(source_text, ' (में|के|the|and|der|et|है) ', ' ', 'g')")} AS b FROM {SEGMENTS_SQL} WHERE source_text IS NOT NULL)"""


@query(f"""SELECT segment_key, round((len(a) - len(b)) / nullif(len(a), 0)::DOUBLE, 4) AS wer, round((length(array_to_string(a, ' ')) - length(array_to_string(b, ' '))) / nullif(length(array_to_string(a, ' ')), 0)::DOUBLE, 4) AS cer FROM {_HEARD_SQL}""")
def omission_rates(spark: SparkSession, d: str) -> DataFrame:
    """Error rates of transcripts that only lack words: the distance is the number of words, and of letters, left out."""
    e = matching.error_rates(F.col("source_text"), F.col("heard"))
    return _heard(spark, d).where("source_text is not null").select("segment_key", e.alias("e")).select("segment_key", "e.wer", "e.cer")


@query()
def listener_findings(spark: SparkSession, d: str) -> DataFrame:
    """What a listener has to look at. Coverage is by matching blocks, which SQL lacks; tested on vectors."""
    return matching.transcript_findings(_heard(spark, d), ["segment_key"], "source_text", "heard", "confidence")


@query(f"""SELECT 'जीवन में' AS query, doc_id, id FROM {PASSAGES_SQL} WHERE contains(lower(concat_ws(chr(10), text, speech)), 'जीवन में') UNION ALL
    SELECT 'THE LAMP', doc_id, id FROM {PASSAGES_SQL} WHERE contains(lower(concat_ws(chr(10), text, speech)), 'the lamp')""")
def search_spoken(spark: SparkSession, d: str) -> DataFrame:
    """Exact search in text and speech whatever the case."""
    p = passages(spark, d)
    got = [matching.search(p, x).select(F.lit(x).alias("query"), "doc_id", "id") for x in ("जीवन में", "THE LAMP")]
    return got[0].unionByName(got[1])


@query()
def search_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten likeliest passages for a phrase that no passage holds. By matching blocks, which SQL lacks."""
    return matching.search_likely(passages(spark, d), "the lamb of the village", ["doc_id", "id"])
