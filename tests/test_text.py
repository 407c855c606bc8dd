import pytest
from pyspark.sql import functions as F

from granthvahi.functions import lexicon as L
from granthvahi.functions import text as T
from granthvahi.operators.prosody import breath_marks


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


VECTORS = [
    (T.pipes_to_dandas, "गायत्री मंत्र|", "गायत्री मंत्र।"),
    (T.pipes_to_dandas, "ॐ भूर्भुवः स्वः||", "ॐ भूर्भुवः स्वः॥"),
    (T.anusvara, "अङ्क", "अंक"),
    (T.anusvara, "चञ्चल", "चंचल"),
    (T.anusvara, "खण्ड", "खंड"),
    (T.anusvara, "शान्त", "शांत"),
    (T.anusvara, "सम्पत्ति", "संपत्ति"),
    (T.anusvara, "ह ोता", "होता"),
    (T.anusvara, "म ेरी", "मेरी"),
    (T.is_front_matter, "लेखक", True),
    (T.is_front_matter, "प्रकाशक", True),
    (T.is_front_matter, "पं० श्रीराम शर्मा आचार्य", True),
    (T.is_front_matter, "( ५ )", True),
    (T.is_front_matter, "मनुष्य की वास्तविक शक्ति मनोबल ही है।", False),
    (T.drop_page_breaks, "पहला वाक्य===PAGE_BREAK===दूसरा वाक्य।", "पहला वाक्य\n\nदूसरा वाक्य।"),
    (T.is_artifact_block, "---", True),
    (T.is_artifact_block, "[", True),
    (T.is_artifact_block, "<->", True),
    (T.is_artifact_block, "The contents of the box were precious.", False),
    (T.ends_sentence, "यह है।", True),
    (T.ends_sentence, "पं.", False),
    (T.ends_sentence, "The end.", True),
    (T.ends_sentence, "", False),
    (T.clock_seconds, "01:02:03", 3723.0),
    (T.clock_seconds, "2:03", 123.0),
    (T.clock_seconds, "x", None),
    (T.page_query, "p35", "35"),
    (T.page_query, "pIV", "IV"),
    (T.page_query, "passage", None),
    (T.word_count, " a b  c ", 3),
    (T.romanize, "गली-गली", "gle gle"),
    (T.windows_path, "C:\\x\\y", "/mnt/c/x/y"),
    (T.speaking_rate, "+10%", 1.1),
    (T.speaking_rate, "bad", 1.0),
    (T.plain_speech, "a<break time='1s'/>b <x>c</x>", "a — b c"),
]


@pytest.mark.parametrize("f, given, expected", VECTORS)
def test_vectors(spark, f, given, expected):
    assert one(spark, f, given) == expected


SPOKEN = {
    "शान्तिः": "शान्तिहि", "हरिः।": "हरिहि।", "विष्णुः": "विष्णुहु", "नमः": "नमह", "बुधैः": "बुधैह", "दुःख": "दुख", "साधन-शक्ति": "साधन शक्ति", "भगवान्": "भगवान", "ब्रह्म": "ब्रम्ह",
    "ऋषि": "रिषि", "ॐ": "ओम्", "पञ्च": "पंच", "ॐ भूर्भुवः स्वः": "ओम् भूर्भुवह स्वाह", "त्र्यम्बकं यजामहे": "त्र्यम्बकम यजामहे", "धर्म": "धर्म", "सत्य": "सत्य", "अ\u200cत\u200dः": "अतह",
}


def test_spoken_forms(spark):
    df = spark.createDataFrame([(k, v) for k, v in SPOKEN.items()], "a string, b string")
    assert [r for r in df.select("b", L.pronounce(F.col("a")).alias("x")).collect() if r["b"] != r["x"]] == []


def test_lexicon_by_join_replaces_words_only(spark):
    rows = spark.createDataFrame([(1, "मन का मनन, मन।"), (2, None), (3, "")], "k int, t string")
    words = spark.createDataFrame([("मन", "मन्")], "source string, tts_alias string")
    got = {r["k"]: r["spoken"] for r in L.pronounce_by_join(rows, ["k"], "t", words).collect()}
    assert got == {1: "मन् का मनन, मन्।", 2: None, 3: ""}


def test_lexicon_by_join_replaces_phrases_longest_first(spark):
    words = {"ab": "1", "ab cd": "2", "cd ef gh": "3", "x-y": "4", "x": "5", "(q) r": "6", "ef": "7"}
    texts = ["ab cd.", "ab cd ef gh", "zx-y x-y x", "ab  cd", "(q) r ab cde", "ef\nab, ab", None, ""]

    def model(text):
        taken = []
        for s in sorted(words, key=lambda s: -len(s)):
            for at in range(len(text)):
                end = at + len(s)
                inside = text[at - 1 : at].isalnum() and s[0].isalnum() or text[end : end + 1].isalnum() and s[-1].isalnum()
                if text.startswith(s, at) and not inside and all(end <= b or e <= at for b, e, _ in taken):
                    taken.append((at, end, words[s]))
        for b, e, new in sorted(taken, reverse=True):
            text = text[:b] + new + text[e:]
        return text

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    lexicon = spark.createDataFrame(list(words.items()), "source string, tts_alias string")
    got = {r["k"]: r["spoken"] for r in L.pronounce_by_join(rows, ["k"], "t", lexicon).collect()}
    assert got == {i: t and model(t) for i, t in enumerate(texts)}
    assert got[0] == "2." and got[1] == "1 3" and got[2] == "zx-y 4 5"


def test_breath_marks(spark):
    f = lambda t, k: one(spark, breath_marks, t, k)
    assert ", किंतु" in f("वे होते हैं किंतु सब नहीं", "prose")
    assert f("यह क्या है।", "question").endswith("?")
    assert f("धर्मक्षेत्रे कुरुक्षेत्रे", "shloka").endswith("॥")
    assert f("उसने कहा कि वह आएगा।", "prose") == "उसने कहा, कि वह आएगा।"
    assert f(None, "prose") is None
