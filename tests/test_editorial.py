"""Vectors of the operators behind the editorial queries."""

import pytest
from pyspark.sql import functions as F

from granthvahi.functions import lexicon
from granthvahi.functions import text as T
from granthvahi.operators import checks, corrections, documents, matching

FINDINGS = [
    ("अ ब स द", "अ ब स द", 0.9, set()),
    ("अ ब स द इ ई उ ऊ ए ऐ", "अ ब स द इ ई उ ऊ ए", 0.9, {"transcript_difference"}),
    ("अ ब स द", "अ ब", 0.4, {"transcript_mismatch", "asr_low_confidence"}),
    ("अ ब स द", "a b s d", 0.9, set()),
    ("अ ब स द", "a b", 0.9, {"transcript_length_anomaly"}),
    ("", "", 0.9, set()),
    (None, None, None, {"asr_low_confidence"}),
    ("अ ब", None, 0.9, {"transcript_mismatch"}),
]


def test_findings_of_transcripts(spark):
    rows = [(i, a, b, c) for i, (a, b, c, _) in enumerate(FINDINGS)]
    df = spark.createDataFrame(rows, "id int, source string, heard string, sure double").withColumn("code", F.lit("x"))
    got = matching.transcript_findings(df, ["id"], "source", "heard", "sure").collect()
    assert [{r["code"] for r in got if r["id"] == i} for i in range(len(rows))] == [f for *_, f in FINDINGS]
    assert matching.transcript_findings(df.limit(0), ["id"], "source", "heard", "sure").count() == 0


def test_word_distance_with_many_different_words(spark):
    words = " ".join(f"w{i}" for i in range(9000))
    df = spark.createDataFrame([(words, words.replace(" w8999", "").replace("w8500 ", "w8501 ")), ("a b c", "a x c"), ("a", "")], "a string, b string")
    got = [r[0] for r in df.select(matching.word_errors(F.split("a", " "), F.filter(F.split("b", " "), lambda w: w != ""))).collect()]
    assert got == [2, 1, 1]


def test_search_of_text_and_speech(spark):
    p = spark.createDataFrame([("a", "The Lamp", None, "1"), ("b", "घर", "the lamp burns", "iv"), ("c", None, None, None), ("d", "a lamp in a village", "x", "2")], "id string, text string, speech string, page string")
    find = lambda x: {r["id"] for r in matching.search(p, x).collect()}
    assert find("LAMP") == {"a", "b", "d"} and find("page IV") == {"b"} and find("c") >= {"c"} and find("1:02") == set() and find(" ") == {"a", "b", "c", "d"}
    got = [tuple(r) for r in matching.search_likely(p, "lamb in the villages", ["id"]).collect()]
    assert got[0][0] == "d" and got[0][1] >= 0.8 and all(s >= 0.55 for _, s in got)
    assert [r["id"] for r in matching.search_likely(p, "ghar", ["id"], best=1).collect()] == ["b"]
    assert matching.search_likely(p.limit(0), "x", ["id"]).count() == 0


TITLES = [("मन साधना", "१२ मनं  साधना ५", True), ("मन साधना", "मन साधना का अर्थ", False), ("a.b (c)", "A.B (C) 7", True), ("a.b", "axb", False), (None, "x", False), ("", "x", False), (None, "12", True)]


@pytest.mark.parametrize("title, text, header", TITLES)
def test_running_headers(spark, title, text, header):
    df = spark.createDataFrame([(title, text)], "title string, text string")
    assert df.select(T.is_running_header(F.col("text"), F.col("title"))).first()[0] is header


def test_titles_leave_blocks_of_their_document_only(spark):
    rows = [(1, 0, "heading", "मन साधना"), (1, 1, "prose", "वह गया। मन साधना १२"), (1, 2, "prose", "मन साधना"), (2, 0, "prose", "मन साधना"), (1, 3, "metadata_page", "3"), (2, 1, "prose", "४२")]
    df = spark.createDataFrame(rows, "id int, seq bigint, tag string, text string")
    got = sorted((r["id"], r["seq"], r["text"]) for r in documents.drop_running_headers(df, "id").collect())
    assert got == [(1, 0, "मन साधना"), (1, 1, "वह गया"), (1, 3, "3"), (2, 0, "मन साधना")]
    titles = spark.createDataFrame([(2, "मन साधना"), (2, "मन साधना")], "id int, title string")
    assert sorted((r["id"], r["seq"]) for r in documents.drop_running_headers(df, "id", titles).collect()) == [(1, 0), (1, 1), (1, 3)]


def test_control_characters_are_no_borders_of_blocks(spark):
    df = spark.createDataFrame([(1, "a\u0001b\u0002c <prose>d</prose>")], "id int, text string")
    assert [r["text"] for r in documents.parse_blocks(df, "id", "text").orderBy("seq").collect()] == ["abc", "d"]


def test_spoken_fixes_in_order_with_pauses(spark):
    rules = [(2, "phonetics", "alias", None, None, None, "ब", None, "स", None, True, None, None, None, 900), (1, "phonetics", None, None, None, None, "अ", None, "ब", None, True, None, None, "r", None), (3, "phonetics", "x", 9, None, None, "स", None, "z", None, True, None, None, None, None)]
    r = spark.createDataFrame(rules, corrections.RULE_SCHEMA)
    s = spark.createDataFrame([(1, "अ ब", "अ", "prose", 1, 1, 200), (2, "क", "क", "prose", 1, 1, 200), (3, None, None, None, None, None, None)], "id int, source_text string, spoken string, segment_type string, page int, paragraph int, pause_after_ms int")
    got = {x["id"]: (x["spoken"], len(x["audit"] or []), x["pause_after_ms"]) for x in corrections.correct_speech(s, r, "spoken").collect()}
    assert got == {1: ("स", 2, 900), 2: ("क", 0, 200), 3: (None, 0, None)}


def test_findings_of_audio(spark):
    rows = [(1, "a " * 20, 10.0, 0.0, 0.7), (2, "a " * 20, 60.0, 0.01, 0.1), (3, None, 5.0, 0.0, 0.0), (4, "a", 0.0, 0.0, 0.0), (5, "a b", 9.0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "id int, source_text string, seconds double, clipped double, silence double")
    got = {(r["id"], r["code"]) for r in checks.audio_findings(df, ["id"], "clipped", "silence").collect()}
    assert got == {(1, "excessive_silence"), (2, "clipping"), (2, "pace_outlier"), (3, "audio_incomplete"), (4, "audio_invalid")}


def test_decomposed_words_are_spoken_alike(spark):
    df = spark.createDataFrame([("दृढ़",), ("दृढ़",), ("गुरुः नमः ऋषिः",)], "t string")
    got = [r[0] for r in df.select(lexicon.pronounce(F.col("t"))).collect()]
    assert got[0] == got[1] and got[2].split()[0] == "गुरुहु" and got[2].split()[1] == "नमह"


def test_slugs_fold_accents(spark):
    assert spark.createDataFrame([("Über Ärger, é!",)], "t string").select(T.slug(F.col("t"))).first()[0] == "uber-arger-e"
