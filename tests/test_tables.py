import pytest
from pyspark.sql import functions as F

from granthvahi.operators import checks, corrections, matching, phrases, timeline, versions
from granthvahi.sources import artifacts, manuscript
from granthvahi.streaming import notes


def test_points_in_intervals_meet_once(spark):
    i = spark.createDataFrame([(1, "a", 0.0, 500.0), (1, "b", 500.0, 500.0), (1, "c", 500.0, 501.0), (2, "d", None, 3.0)], "k int, id string, s double, e double")
    p = spark.createDataFrame([(1, 0.0), (1, 499.9), (1, 500.0), (2, 1.0), (1, None)], "k int, t double")
    got = timeline.points_in_intervals(p, i, ["k"], "t", "s", "e", 10.0).select("t", "id").collect()
    assert sorted(map(tuple, got)) == [(0.0, "a"), (499.9, "a"), (500.0, "c")]
    closed = timeline.points_in_intervals(p, i, ["k"], "t", "s", "e", 10.0, closed=True)
    assert sorted(r["id"] for r in closed.where("t = 500").collect()) == ["a", "b", "c"]


def test_printed_pages(spark):
    df = spark.createDataFrame([(p,) for p in (1, 5, 41, 42, 43)], "page int")
    got = timeline.printed_pages(df, "page", [(1, 4, None), (5, 42, 3), (43, 99, None)]).orderBy("page").collect()
    assert [r["printed_page"] for r in got] == [None, "3", "39", "40", None]
    with pytest.raises(ValueError):
        timeline.printed_pages(df, "page", [(1, 5, None), (5, 9, 3)])


def rules(spark, *rows):
    names = [c.split(" ")[0] for c in corrections.RULE_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], corrections.RULE_SCHEMA)


def test_removals_need_approval(spark):
    s = spark.createDataFrame([("a", "परिचय", "prose", 1, 1), ("b", "कथा", "prose", 1, 2)], "id string, source_text string, segment_type string, page int, paragraph int")
    rule = {"rule_id": 1, "stage": "segment", "kind": "exclude", "find": "परिचय"}
    assert corrections.remove_segments(s, rules(spark, rule)).count() == 2
    assert [r["id"] for r in corrections.remove_segments(s, rules(spark, rule | {"approved": True})).collect()] == ["b"]
    with pytest.raises(ValueError):
        corrections.remove_segments(s, rules(spark, rule | {"approved": True}), max_rules=0).count()


def test_corrections_leave_audits_and_follow_each_other(spark):
    s = spark.createDataFrame([("a", "यह हो सकती संभव है।", "prose", 1, 1)], "id string, source_text string, segment_type string, page int, paragraph int")
    r = rules(
        spark,
        {"rule_id": 1, "stage": "segment", "kind": "ocr_correction", "find": "सकती", "replace": "सकनी", "approved": True},
        {"rule_id": 2, "stage": "segment", "kind": "ocr_correction", "find": "सकनी", "replace": "होनी", "approved": True, "page": 2},
    )
    got = corrections.correct_source(s, r).first()
    assert got["source_text"] == "यह हो सकनी संभव है।" and len(got["audit"]) == 1 and got["audit"][0]["source"] == "सकती"


def test_replace_first_needs_exactly_one(spark):
    df = spark.createDataFrame([("a b c", "b"), ("b b", "b"), ("x", "b")], "t string, f string")
    assert [r[0] for r in df.select(corrections.replace_first(F.col("t"), F.col("f"), F.lit("Z"))).collect()] == ["a Z c", None, None]


def test_segment_faults(spark):
    rows = [("a", "x", 0, "+0%"), ("a", "y", 0, "+0%"), ("../e", " ", -1, "bad"), ("c", "[अस्पष्ट]", None, None)]
    s = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, id string, source_text string, pause_after_ms int, rate string")
    got = {(r["id"], r["fault"]) for r in checks.segment_faults(s, "doc_id").collect()}
    assert got == {("a", "duplicate_id"), ("../e", "invalid_id"), ("../e", "empty_text"), ("../e", "pause_out_of_range"), ("../e", "invalid_rate"), ("c", "unclear_text")}


def test_transcripts(spark):
    df = spark.createDataFrame([("मन साधे जीवन सधै", "मन जीवन अतिरिक्त"), ("a b", "a b"), ("", "x")], "a string, b string")
    got = df.select(matching.token_difference(matching.tokens(F.col("a")), matching.tokens(F.col("b"))).alias("d"), matching.error_rates(F.col("a"), F.col("b")).alias("e")).collect()
    assert got[0]["d"]["omissions"] == ["साधे", "सधै"] and got[0]["d"]["additions"] == ["अतिरिक्त"] and got[0]["e"]["wer"] == 0.5
    assert got[1]["e"]["wer"] == 0.0 and got[1]["e"]["cer"] == 0.0 and got[2]["e"]["wer"] is None


def test_phrase_is_found_in_its_book(spark):
    n = spark.createDataFrame([(1, "n", "gali gali"), (1, "m", "")], "k int, note_id string, note string")
    p = spark.createDataFrame([(1, "a", "वह गली-गली घूमा। फिर सोया।"), (2, "b", "गली-गली"), (1, "c", None)], "k int, passage_id string, text string")
    got = phrases.phrase_matches(n, p, ["k"]).collect()
    assert got[0]["passage_id"] == "a" and got[0]["sentence_no"] == 0 and got[0]["score"] >= 0.72 and {r["note_id"] for r in got} == {"n"}


def test_reuse_takes_each_old_once(spark):
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y")], "k int, id string, fingerprint string")
    new = spark.createDataFrame([(1, "b", "x"), (1, "d", "x"), (1, "e", "x"), (1, "c", "z")], "k int, id string, fingerprint string")
    got = {r["id"]: (r["reused_id"], r["how"]) for r in versions.reuse(old, new, ["k"]).collect()}
    assert got == {"b": ("b", "exact"), "d": ("a", "matched"), "e": (None, "new"), "c": (None, "new")}


def test_lineage_and_changes(spark):
    items = spark.createDataFrame([(1, "x", ["a", "b"]), (1, "a", None), (1, "y", [])], "k int, id string, parents array<string>")
    t = spark.createDataFrame([(1, "a")], "k int, target string")
    assert {r["id"] for r in versions.descends_from(items, t, ["k"]).collect()} == {"x", "a"}
    a = spark.createDataFrame([(1, "p", None), (2, "q", 1)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "p", None), (2, "q", 2), (3, "r", 1)], "id int, s string, n int")
    assert {tuple(r) for r in versions.changes(a, b, ["id"], ["s", "n"]).collect()} == {(2, "changed"), (3, "added")}


def test_manuscript_round_trip_and_faults(spark):
    rows = [(1, "p1", "एक\n\nदो", "iv", "3", None, "SPEECH", "prose", 600, "+0%", "+0Hz", "+0%", 1, ["a", "b"])]
    schema = "doc_id int, id string, text string, page string, pdf_page string, speech string, mode string, kind string, pause int, rate string, pitch string, volume string, take int, parents array<string>"
    p = spark.createDataFrame(rows, schema)
    books = manuscript.render_manuscripts(p, "doc_id", "id")
    r = manuscript.parse_manuscripts(books, "doc_id", "text").first()
    assert (r["text"], r["page"], r["pdf_page"], r["pause"], r["take"], r["parents"], r["speech"], r["fault"]) == ("एक\n\nदो", "iv", "3", 600, 1, ["a", "b"], "(inherit)", None)
    bad = "=== Passage a ===\nPAGE: 1\nX: 2\n\nTEXT:\nt\n\nSPEECH:\ns\n=== Passage b ===\n\nTEXT:\nt\n=== Passage a ===\nTAKE: -1\n\nTEXT:\nt\n\nSPEECH:\ns\n"
    got = manuscript.parse_manuscripts(spark.createDataFrame([(1, bad)], "doc_id int, text string"), "doc_id", "text").orderBy("seq").collect()
    assert [r["fault"] for r in got] == ["unknown_field", "sections", "number"]


def test_markup(spark):
    df = spark.createDataFrame([("<sub alias='x'>y</sub>",), ("<break>",), ("<audio/>",), ("<!DOCTYPE x>",), (None,), ("<p a='1'>x</p>",)], "t string")
    assert [r[0] for r in df.select(manuscript.markup_fault(F.col("t"))).collect()] == [None, "malformed", "element audio", "declaration", "empty", "attribute of p"]


def test_sources(spark, tmp_path):
    assert artifacts.read_segments(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('[{"id": "a", "source_text": "x", "pause_after_ms": 5}, {"id": "b"}]')
    assert [r["pause_after_ms"] for r in artifacts.read_segments(spark, str(tmp_path / "s.json")).orderBy("id").collect()] == [5, None]
    with pytest.raises(Exception):
        artifacts.read_segments(spark, str(tmp_path / "none.json"), strict=True).count()
    (tmp_path / "l.json").write_text('{"rules": [{"source": "a", "tts_alias": "b"}]}')
    assert [(r["source"], r["tts_alias"]) for r in artifacts.read_lexicon(spark, str(tmp_path / "l.json")).collect()] == [("a", "b")]
    artifacts.append_history(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "h"), "clean")
    artifacts.append_history(spark.createDataFrame([(2,)], "x int"), str(tmp_path / "h"), "clean")
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_stream_imports_notes_once(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:05:00"), ("b", "2025-01-01 00:06:00")], "id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(src)
    stream = notes.new_notes(spark.readStream.schema(df.schema).parquet(src), ["id"], "at")
    out = str(tmp_path / "out")
    for _ in range(2):
        q = stream.writeStream.foreachBatch(lambda b, _: notes.append_new(b, out, ["id"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_risk_sample_takes_the_risky_first(spark):
    df = spark.range(100).withColumn("r", F.col("id") < 3)
    got = checks.risk_sample(df, "id", F.col("r"), 10.0, 50, "s").collect()
    assert len(got) == 10 and sum(x["risky"] for x in got) == 3
