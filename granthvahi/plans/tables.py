"""Queries over ledgers, timelines and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock_seconds, digest, page_query
from ..operators import checks, timeline, versions
from ..operators.ordered import last_known, numbered, running_sum, with_neighbour
from ..session import load
from .registry import FEEDBACK_SQL, PASSAGES_SQL, SEGMENTS_SQL, feedback, offsets, passages, query, segments


@query(f"""
    SELECT p.id, p.name, p.status, coalesce(s.n_segments, 0) AS n_segments, coalesce(o.n_done, 0) AS n_done,
           CASE WHEN coalesce(s.n_segments, 0) = 0 THEN 0 ELSE 100 * coalesce(o.n_done, 0) // s.n_segments END AS percent, coalesce(f.n_notes, 0) AS n_notes
    FROM projects p
    LEFT JOIN (SELECT doc_id, count(*) AS n_segments FROM {SEGMENTS_SQL} GROUP BY 1) s ON s.doc_id = p.id
    LEFT JOIN (SELECT doc_id, count(*) AS n_done FROM (SELECT DISTINCT doc_id, chunk_id FROM offsets WHERE start_seconds IS NOT NULL) GROUP BY 1) o ON o.doc_id = p.id
    LEFT JOIN (SELECT doc_id, count(*) AS n_notes FROM {FEEDBACK_SQL} GROUP BY 1) f ON f.doc_id = p.id""")
def dashboard_list(spark: SparkSession, d: str) -> DataFrame:
    """Every book with its progress; each side is aggregated before it is joined."""
    s = segments(spark, d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    o = load(spark, d, "offsets").where("start_seconds is not null").select("doc_id", "chunk_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_done"))
    f = feedback(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_notes"))
    p = load(spark, d, "projects").select(F.col("id").alias("doc_id"), "name", "status")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    rows = p.join(s, "doc_id", "left").join(o, "doc_id", "left").join(f, "doc_id", "left")
    percent = F.when(F.coalesce("n_segments", F.lit(0)) == 0, 0).otherwise(F.floor(100 * F.coalesce("n_done", F.lit(0)) / F.col("n_segments"))).cast("bigint")
    return rows.select(F.col("doc_id").alias("id"), "name", "status", zero("n_segments"), zero("n_done"), percent.alias("percent"), zero("n_notes"))


@query("""SELECT status, count(*) AS n_books, count(display_name) AS n_titled, CAST(sum(CASE WHEN book_identifier IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unidentified,
           max(version) AS latest_version FROM projects GROUP BY status""")
def dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    missing = F.sum(F.col("book_identifier").isNull().cast("bigint"))
    return load(spark, d, "projects").groupBy("status").agg(F.count("*").alias("n_books"), F.count("display_name").alias("n_titled"), missing.alias("n_unidentified"), F.max("version").alias("latest_version"))


@query(f"""SELECT doc_id, count(*) AS total, CAST(sum(CASE WHEN category = 'pronunciation' THEN 1 ELSE 0 END) AS BIGINT) AS pronunciation,
           CAST(sum(CASE WHEN category = 'missing_text' THEN 1 ELSE 0 END) AS BIGINT) AS missing_text, count(DISTINCT reviewer_number) AS reviewers
    FROM {FEEDBACK_SQL} GROUP BY doc_id""")
def issue_counts_pivot(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum((F.col("category") == c).cast("bigint")).alias(c)
    return feedback(spark, d).groupBy("doc_id").agg(F.count("*").alias("total"), n("pronunciation"), n("missing_text"), F.count_distinct("reviewer_number").alias("reviewers"))


@query("""SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each group by an aggregate: partial maxima before the shuffle, no sort, no skew."""
    best = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("b")
    return load(spark, d, "events").groupBy("user_id").agg(best).select("user_id", "b.*")


@query("""SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def newest_events(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: each task keeps its hundred newest."""
    return load(spark, d, "events").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query(f"""SELECT segment_key, round((e - step) / 1000.0, 3) AS start_seconds, round(e / 1000.0, 3) AS end_seconds FROM
    (SELECT segment_key, step, sum(step) OVER (PARTITION BY doc_id ORDER BY seq, segment_key ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM
        (SELECT segment_key, doc_id, seq, (60 * length(source_text) + pause_after_ms)::BIGINT AS step FROM {SEGMENTS_SQL}))""")
def timeline_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each segment starts if a character takes 60 ms."""
    rows = segments(spark, d, "segment_key", "doc_id", "seq", "source_text", "pause_after_ms").withColumn("ms", 60 * F.length("source_text")).drop("source_text")
    step = (F.col("ms") + F.col("pause_after_ms")).cast("bigint")
    out = running_sum(rows.withColumn("step", step), ["doc_id"], "seq", F.col("step"), "e", ["segment_key"])
    return out.select("segment_key", F.round((F.col("e") - F.col("step")) / F.lit(1000.0), 3).alias("start_seconds"), F.round(F.col("e") / F.lit(1000.0), 3).alias("end_seconds"))


_NOTES = """(SELECT doc_id, issue_id, list_aggregate(list_transform(string_split(trim(timestamp), ':'), lambda p: CAST(p AS DOUBLE)), 'sum') AS dummy,
    CAST(string_split(trim(timestamp), ':')[1] AS DOUBLE) * 3600 + CAST(string_split(trim(timestamp), ':')[2] AS DOUBLE) * 60 + CAST(string_split(trim(timestamp), ':')[3] AS DOUBLE) AS t
    FROM {f} WHERE regexp_full_match(trim(timestamp), '[0-9]+:[0-9]+:[0-9]+'))""".replace("{f}", FEEDBACK_SQL)


def _clock_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = feedback(spark, d).where(F.trim("timestamp").rlike("^[0-9]+:[0-9]+:[0-9]+$"))
    return rows.select("doc_id", "issue_id", clock_seconds(F.col("timestamp")).alias("t"))


@query(f"""SELECT n.doc_id, n.issue_id, n.t, o.chunk_id FROM {_NOTES} n JOIN (SELECT DISTINCT doc_id, chunk_id, start_seconds, end_seconds FROM offsets) o
    ON o.doc_id = n.doc_id AND o.start_seconds <= n.t AND n.t < o.end_seconds""")
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that play at each note's time."""
    o = offsets(spark, d).select("doc_id", "chunk_id", "start_seconds", "end_seconds").distinct()
    got = timeline.points_in_intervals(_clock_notes(spark, d), o, ["doc_id"], "t", "start_seconds", "end_seconds", 60.0)
    return got.select("doc_id", "issue_id", "t", "chunk_id")


@query(f"""WITH o AS (SELECT DISTINCT doc_id, chunk_id AS id, start_seconds, end_seconds FROM offsets WHERE start_seconds IS NOT NULL AND end_seconds IS NOT NULL),
    n AS (SELECT DISTINCT doc_id, issue_id, t FROM {_NOTES}),
    h AS (SELECT * FROM (SELECT n.*, o.id, row_number() OVER (PARTITION BY n.doc_id, n.issue_id, n.t ORDER BY o.start_seconds, o.id) AS r FROM n JOIN o
          ON o.doc_id = n.doc_id AND o.start_seconds <= n.t AND n.t <= o.end_seconds) WHERE r = 1)
    SELECT n.doc_id, n.issue_id, n.t, h.id AS matched_id, greatest(0.0::DOUBLE, coalesce(o.start_seconds * 0.5 - 1.0, n.t - 5.0)) AS from_seconds,
           coalesce(o.end_seconds * 0.5 + 1.0, n.t + 5.0) AS to_seconds, o.id IS NOT NULL AS remapped
    FROM n LEFT JOIN h ON h.doc_id = n.doc_id AND h.issue_id = n.issue_id AND h.t = n.t LEFT JOIN o ON o.doc_id = h.doc_id AND o.id = h.id""")
def timeline_remap(spark: SparkSession, d: str) -> DataFrame:
    """Notes on the old timeline as stretches of one played at double speed."""
    o = offsets(spark, d).select("doc_id", F.col("chunk_id").alias("id"), "start_seconds", "end_seconds").distinct().where("start_seconds is not null and end_seconds is not null")
    new = o.withColumn("start_seconds", F.col("start_seconds") * 0.5).withColumn("end_seconds", F.col("end_seconds") * 0.5)
    return timeline.remap(_clock_notes(spark, d).distinct(), o, new, ["doc_id"], "id", "t")


_RULES = [(1, 4, None), (5, 42, 3), (43, 60, None)]


@query(f"""SELECT segment_key, page, CASE WHEN page = 2 THEN 'iv' WHEN page BETWEEN 1 AND 4 THEN NULL WHEN page BETWEEN 5 AND 42 THEN CAST(page - 5 + 3 AS VARCHAR)
    WHEN page BETWEEN 43 AND 60 THEN NULL ELSE CAST(page - 4 AS VARCHAR) END AS printed_page FROM {SEGMENTS_SQL}""")
def page_label_map(spark: SparkSession, d: str) -> DataFrame:
    return timeline.printed_pages(segments(spark, d, "segment_key", "page"), "page", _RULES, {2: "iv"}, -4)


@query("""SELECT timestamp AS stored, CASE WHEN regexp_full_match(trim(timestamp), '[0-9]+(\\.[0-9]+)?(:[0-9]+(\\.[0-9]+)?){0,2}')
    THEN list_reduce(list_transform(string_split(trim(timestamp), ':'), lambda x: CAST(x AS DOUBLE)), lambda a, b: a * 60 + b) END AS seconds,
    count(*) AS n FROM feedback GROUP BY 1""")
def timestamp_parse(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "feedback").groupBy(F.col("timestamp").alias("stored")).agg(F.count("*").alias("n")).withColumn("seconds", clock_seconds(F.col("stored")))


@query("""SELECT q, coalesce(nullif(regexp_extract(q, '(?i)^page\\s+([0-9]+|[ivxlcdm]+)$', 1), ''), nullif(regexp_extract(q, '(?i)^p[.:]?\\s*([0-9]+|[ivxlcdm]+)$', 1), '')) AS page
    FROM (SELECT DISTINCT unnest(['p' || page, 'Page ' || page, 'p. ' || page, page, id]) AS q FROM passages WHERE page IS NOT NULL)""")
def page_queries(spark: SparkSession, d: str) -> DataFrame:
    """What every page label and id asks for when it is typed into a search."""
    p = load(spark, d, "passages").where("page is not null")
    rows = p.select(F.explode(F.array(F.concat(F.lit("p"), "page"), F.concat(F.lit("Page "), "page"), F.concat(F.lit("p. "), "page"), F.col("page"), F.col("id"))).alias("q")).distinct()
    return rows.select("q", page_query(F.col("q")).alias("page"))


@query(f"""SELECT segment_key, lag(segment_key) OVER w AS before_key, lead(segment_key) OVER w AS after_key FROM {SEGMENTS_SQL} WINDOW w AS (PARTITION BY doc_id ORDER BY seq, segment_key)""")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    rows = numbered(segments(spark, d, "segment_key", "doc_id", "seq"), ["doc_id"], "seq", "n", ["segment_key"])
    rows = with_neighbour(with_neighbour(rows, ["doc_id"], "n", ["segment_key"], -1, "_b"), ["doc_id"], "n", ["segment_key"], 1, "_a")
    return rows.select("segment_key", F.col("segment_key_b").alias("before_key"), F.col("segment_key_a").alias("after_key"))


@query(f"""SELECT segment_key, last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq, segment_key ROWS UNBOUNDED PRECEDING) AS page FROM {SEGMENTS_SQL}""")
def page_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d, "segment_key", "doc_id", "seq", "page").withColumnRenamed("page", "p")
    return last_known(rows, ["doc_id"], "seq", F.col("p"), "page", ["segment_key"]).select("segment_key", "page")


@query(f"""WITH s AS (SELECT doc_id, id, max(source_text) AS t FROM {SEGMENTS_SQL} GROUP BY 1, 2), o AS (SELECT doc_id, chunk_id AS id, max(source_text) AS t FROM offsets GROUP BY 1, 2)
    SELECT * FROM (SELECT coalesce(s.doc_id, o.doc_id) AS doc_id, coalesce(s.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'orphan'
        WHEN o.t IS NOT NULL AND s.t IS DISTINCT FROM o.t THEN 'source_drift' END AS fault FROM s FULL OUTER JOIN o ON s.doc_id = o.doc_id AND s.id = o.id) WHERE fault IS NOT NULL""")
def row_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Segments against what was spoken of them."""
    o = load(spark, d, "offsets").select("doc_id", F.col("chunk_id").alias("id"), "source_text")
    return checks.drift(segments(spark, d, "doc_id", "id", "source_text"), o, ["doc_id", "id"])


@query(f"""WITH o AS (SELECT id, ANY_VALUE(pause) AS pause, ANY_VALUE(rate) AS rate FROM {PASSAGES_SQL} WHERE take <= 1 GROUP BY id), n AS (SELECT id, ANY_VALUE(pause) AS pause, ANY_VALUE(rate) AS rate FROM {PASSAGES_SQL} WHERE take >= 1 GROUP BY id)
    SELECT * FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.pause IS DISTINCT FROM n.pause OR o.rate IS DISTINCT FROM n.rate THEN 'changed' END AS change
    FROM o FULL OUTER JOIN n ON o.id = n.id) WHERE change IS NOT NULL""")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """What differs between passages as first taken and as taken since."""
    p = passages(spark, d).select("id", "pause", "rate", "take")
    one = lambda f: p.where(f).select("id", "pause", "rate").dropDuplicates(["id"])
    return versions.changes(one("take <= 1"), one("take >= 1"), ["id"], ["pause", "rate"])


@query(f"""WITH p AS (SELECT doc_id, id, parents FROM {PASSAGES_SQL}), t AS (SELECT DISTINCT doc_id, unnest(parents) AS target FROM p)
    SELECT DISTINCT t.doc_id, t.target, p.id FROM t JOIN p ON p.doc_id = t.doc_id AND (p.id = t.target OR list_contains(p.parents, t.target))""")
def lineage_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = passages(spark, d).select("doc_id", "id", "parents")
    return versions.descends_from(p, p.select("doc_id", F.explode("parents").alias("target")), ["doc_id"]).select("doc_id", "target", "id")


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n_segments, count(DISTINCT k) AS n_spoken FROM (SELECT sha256(concat(coalesce(source_text, chr(0)), chr(31), coalesce(segment_type, chr(0)))) AS k FROM {SEGMENTS_SQL})""")
def unique_speech(spark: SparkSession, d: str) -> DataFrame:
    """How many recordings the segments need if what sounds alike is recorded once."""
    k = versions.fingerprint(["source_text", "segment_type"])
    return segments(spark, d, "source_text", "segment_type").select(k.alias("k")).agg(F.count("*").alias("n_segments"), F.count_distinct("k").alias("n_spoken"))


@query(f"""WITH s AS (SELECT doc_id, id, source_text AS fingerprint FROM {SEGMENTS_SQL}), o AS (SELECT doc_id, chunk_id AS id, max(source_text) AS fingerprint FROM offsets WHERE source_text IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT s.* FROM s JOIN o USING (doc_id, id, fingerprint)),
    rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fingerprint) AS r FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM e)),
    ro AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fingerprint) AS r FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM e))
    SELECT how, count(*) AS n FROM (SELECT 'exact' AS how FROM e UNION ALL SELECT CASE WHEN ro.id IS NULL THEN 'new' ELSE 'matched' END FROM rn LEFT JOIN ro USING (doc_id, fingerprint, r)) GROUP BY how""")
def reuse_matching(spark: SparkSession, d: str) -> DataFrame:
    """How many segments keep a recording, take over another's, or need a new one."""
    s = segments(spark, d, "doc_id", "id", "source_text").withColumnRenamed("source_text", "fingerprint")
    o = load(spark, d, "offsets").where("source_text is not null").groupBy("doc_id", F.col("chunk_id").alias("id")).agg(F.max("source_text").alias("fingerprint"))
    mark = lambda df: df.withColumn("fingerprint", F.sha2("fingerprint", 256))
    return versions.reuse(mark(o), mark(s), ["doc_id"]).groupBy("how").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e(a, b) AS (VALUES ('raw', 'clean'), ('clean', 'segments'), ('segments', 'phonetics'), ('phonetics', 'master')),
    c(changed, made_again) AS (SELECT a, b FROM e UNION SELECT c.changed, e.b FROM c JOIN e ON e.a = c.made_again) SELECT * FROM c""")
def invalidation_closure(spark: SparkSession, d: str) -> DataFrame:
    rows = [(a, b) for a in ("raw", "clean", "segments", "phonetics") for b in versions.invalidated(a)]
    return spark.createDataFrame(rows, "changed string, made_again string")


@query("""SELECT f.doc_id, f.issue_id, min(f.received_at) AS received_at FROM feedback f
    WHERE NOT EXISTS (SELECT 1 FROM feedback s WHERE s.issue_id = f.issue_id AND s.received_at < TIMESTAMP '2025-07-01') GROUP BY 1, 2""")
def idempotent_import(spark: SparkSession, d: str) -> DataFrame:
    """Notes that come in after July 2025 and were not there before, each once."""
    f = load(spark, d, "feedback").select("doc_id", "issue_id", "received_at")
    seen = f.where("received_at < timestamp_ntz'2025-07-01'")
    return versions.unseen(f, seen, ["issue_id"], [F.col("received_at")]).groupBy("doc_id", "issue_id").agg(F.min("received_at").alias("received_at"))


@query(f"""SELECT doc_id, reviewer_number, CAST(count(*) AS BIGINT) AS n, md5(string_agg(issue_id, ',' ORDER BY issue_id)) AS listed FROM {FEEDBACK_SQL} GROUP BY 1, 2""")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).groupBy("doc_id", "reviewer_number").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("issue_id")), ",")).alias("listed"))


@query(f"""SELECT s.segment_key FROM {SEGMENTS_SQL} s WHERE EXISTS (SELECT 1 FROM offsets o WHERE o.doc_id = s.doc_id AND o.chunk_id = s.id AND o.start_seconds IS NOT NULL)""")
def spoken_segments(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "offsets").where("start_seconds is not null").select("doc_id", F.col("chunk_id").alias("id"))
    return segments(spark, d, "segment_key", "doc_id", "id").join(o, ["doc_id", "id"], "left_semi").select("segment_key")


@query(f"""SELECT s.segment_key FROM {SEGMENTS_SQL} s WHERE NOT EXISTS (SELECT 1 FROM offsets o WHERE o.doc_id = s.doc_id AND o.chunk_id = s.id)""")
def unspoken_segments(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "offsets").select("doc_id", F.col("chunk_id").alias("id"))
    return segments(spark, d, "segment_key", "doc_id", "id").join(o, ["doc_id", "id"], "left_anti").select("segment_key")


@query(f"""WITH s AS (SELECT doc_id, segment_key, row_number() OVER (PARTITION BY doc_id ORDER BY seq, segment_key) AS n FROM {SEGMENTS_SQL}),
    o AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_seconds, chunk_id) AS n FROM (SELECT DISTINCT doc_id, chunk_id, start_seconds FROM offsets WHERE start_seconds IS NOT NULL))
    SELECT s.segment_key, o.chunk_id FROM s JOIN o USING (doc_id, n)""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    s = numbered(segments(spark, d, "segment_key", "doc_id", "seq"), ["doc_id"], "seq", "n", ["segment_key"]).select("doc_id", "n", "segment_key")
    o = load(spark, d, "offsets").where("start_seconds is not null").select("doc_id", "chunk_id", "start_seconds").distinct()
    o = numbered(o, ["doc_id"], "start_seconds", "n", ["chunk_id"]).select("doc_id", "n", "chunk_id")
    return s.join(o, ["doc_id", "n"]).select("segment_key", "chunk_id")


@query("""SELECT doc_id, chunk_id, words, seconds, round(words * 60.0 / seconds, 1) AS wpm, words >= 12 AND (round(words * 60.0 / seconds, 1) < 90 OR round(words * 60.0 / seconds, 1) > 200) AS outlier FROM
    (SELECT DISTINCT doc_id, chunk_id, len(list_filter(regexp_split_to_array(source_text, '\\s+'), lambda x: x <> '')) AS words, round(end_seconds - start_seconds, 3) AS seconds
     FROM offsets WHERE source_text IS NOT NULL AND end_seconds > start_seconds) WHERE seconds > 0""")
def pace_outliers(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import word_count

    rows = load(spark, d, "offsets").where("source_text is not null and end_seconds > start_seconds")
    rows = rows.select("doc_id", "chunk_id", word_count(F.col("source_text")).cast("bigint").alias("words"), F.round(F.col("end_seconds") - F.col("start_seconds"), 3).alias("seconds")).distinct().where("seconds > 0")
    rows = rows.withColumn("wpm", F.round(F.col("words") * 60.0 / F.col("seconds"), 1))
    return rows.withColumn("outlier", checks.pace_fault(F.col("words"), F.col("wpm")))


@query("""SELECT doc_id, round(median(s), 4) AS median_seconds, count(*) AS n FROM (SELECT DISTINCT doc_id, chunk_id, round(end_seconds - start_seconds, 3) AS s FROM offsets WHERE end_seconds > start_seconds) GROUP BY doc_id""")
def book_pace(spark: SparkSession, d: str) -> DataFrame:
    """The exact median of whole milliseconds: their histogram is merged, which has as many
    entries as there are different lengths, and no list of a book's rows."""
    rows = load(spark, d, "offsets").where("end_seconds > start_seconds").select("doc_id", "chunk_id", F.round(F.col("end_seconds") - F.col("start_seconds"), 3).alias("s")).distinct()
    return rows.groupBy("doc_id").agg(F.round(F.median("s"), 4).alias("median_seconds"), F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT doc_id, CAST(sum(CASE WHEN fault = 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS warnings, CAST(sum(CASE WHEN fault <> 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS blockers FROM
    (SELECT coalesce(s.doc_id, o.doc_id) AS doc_id, CASE WHEN o.id IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'orphan' WHEN o.t IS NOT NULL AND s.t IS DISTINCT FROM o.t THEN 'source_drift' END AS fault
     FROM (SELECT doc_id, id, max(source_text) AS t FROM {SEGMENTS_SQL} GROUP BY 1, 2) s FULL OUTER JOIN (SELECT doc_id, chunk_id AS id, max(source_text) AS t FROM offsets GROUP BY 1, 2) o ON s.doc_id = o.doc_id AND s.id = o.id)
    WHERE fault IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, blockers, warnings, CASE WHEN blockers > 0 THEN 'fail' WHEN warnings > 0 THEN 'review_required' ELSE 'pass' END AS verdict FROM f""")
def findings_rollup(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.sum(c.cast("bigint"))
    got = row_contracts(spark, d).groupBy("doc_id").agg(n(F.col("fault") != "missing").alias("blockers"), n(F.col("fault") == "missing").alias("warnings"))
    return got.withColumn("verdict", checks.verdict(F.col("blockers"), F.col("warnings")))


@query("""SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS peak, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 4) AS rms,
    round(len(list_filter(embedding, lambda x: abs(x::DOUBLE) < 164.0 / 32768)) / len(embedding), 4) AS silence_ratio FROM embeddings""")
def signal_statistics(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", checks.signal_statistics(F.col("embedding")).alias("s")).select("vec_id", "s.peak", "s.rms", "s.silence_ratio")


@query("""SELECT c_custkey AS key, 'customer' AS side, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, NULL FROM supplier""")
def schema_evolution_union(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("side"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("side"), F.col("s_acctbal").alias("balance"))
    return versions.union_versions([c, s])


@query("""SELECT o_orderkey, n_lines, quantity, c_name FROM (SELECT l_orderkey, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
    JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """Details aggregated before they meet their masters; the filter reaches the scan."""
    lines = load(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1995-01-01'").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    names = load(spark, d, "customer").select("c_custkey", "c_name")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(names, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "n_lines", "quantity", "c_name")


@query(f"""SELECT id AS segment, sha256(concat_ws(':', doc_id::VARCHAR, id, coalesce(source_text, ''))) AS digest FROM {SEGMENTS_SQL}""")
def digests(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, "doc_id", "id", "source_text").select(F.col("id").alias("segment"), digest(F.col("doc_id").cast("string"), F.col("id"), F.coalesce(F.col("source_text"), F.lit(""))).alias("digest"))


@query(f"""SELECT segment_key, risky FROM (SELECT segment_key, coalesce(segment_type IN ('shloka', 'quote'), false) AS risky FROM {SEGMENTS_SQL})
    ORDER BY risky DESC, sha256('book:' || segment_key::VARCHAR), segment_key LIMIT (SELECT least(500, greatest(sum(CASE WHEN segment_type IN ('shloka', 'quote') THEN 1 ELSE 0 END), round_even(count(*) * 5.0 / 100, 0)))::BIGINT FROM {SEGMENTS_SQL})""")
def risk_sample(spark: SparkSession, d: str) -> DataFrame:
    risky = F.coalesce(F.col("segment_type").isin("shloka", "quote"), F.lit(False))
    return checks.risk_sample(segments(spark, d, "segment_key", "segment_type"), "segment_key", risky, 5.0, 500, "book").select("segment_key", "risky")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.notes import counts_by_window

    return counts_by_window(load(spark, d, "events"), "ts", ["event_type"])


@query("""SELECT 'project' AS owner, id::VARCHAR AS key FROM projects EXCEPT SELECT 'project', doc_id::VARCHAR FROM offsets""")
def books_without_timeline(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "projects").select(F.lit("project").alias("owner"), F.col("id").cast("string").alias("key"))
    b = load(spark, d, "offsets").select(F.lit("project").alias("owner"), F.col("doc_id").cast("string").alias("key"))
    return a.join(b, ["owner", "key"], "left_anti").distinct()




@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before""")
def revision_stack(spark: SparkSession, d: str) -> DataFrame:
    """Of rows that repeat what stood before them, the first."""
    rows = numbered(load(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "n")
    rows = with_neighbour(rows, ["user_id"], "n", ["event_type"], -1, "_before")
    return rows.where(~F.col("event_type").eqNullSafe(F.col("event_type_before"))).select("user_id", "event_id", "event_type")


@query("""SELECT event_type, round(avg(least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100 - 1))), 4) AS confidence, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1""")
def confidence_mean(spark: SparkSession, d: str) -> DataFrame:
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100 - 1))
    return load(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.round(F.avg(clamped), 4).alias("confidence"), F.count("*").alias("n"))


@query("""SELECT doc_id, count(*) AS n_chunks, CAST(sum(round((end_seconds - start_seconds) * 1000)) AS BIGINT) AS total_ms, CAST(sum(CASE WHEN source_text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_text
    FROM (SELECT DISTINCT doc_id, chunk_id, start_seconds, end_seconds, source_text FROM offsets) GROUP BY doc_id""")
def build_totals(spark: SparkSession, d: str) -> DataFrame:
    ms = F.round((F.col("end_seconds") - F.col("start_seconds")) * 1000).cast("bigint")
    return offsets(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(ms).alias("total_ms"), F.sum(F.col("source_text").isNull().cast("bigint")).alias("n_without_text"))


@query(f"""SELECT c.segment_key, p.segment_key AS predecessor_key FROM {SEGMENTS_SQL} c LEFT JOIN {SEGMENTS_SQL} p ON p.doc_id = c.doc_id AND p.seq = c.seq - 1""")
def predecessors(spark: SparkSession, d: str) -> DataFrame:
    """A self join on the number before: an equi join, whatever the group's size."""
    c = segments(spark, d, "segment_key", "doc_id", "seq")
    p = c.select(F.col("segment_key").alias("predecessor_key"), F.col("doc_id").alias("_d"), (F.col("seq") + 1).alias("_s"))
    return c.join(p, (F.col("doc_id") == F.col("_d")) & (F.col("seq") == F.col("_s")), "left").select("segment_key", "predecessor_key")
