import hashlib
import random
import re

from pyspark.sql import functions as F

from granthvahi.operators import documents, segments
from granthvahi.operators.ordered import last_known, numbered, running_sum, with_neighbour


def test_parse_blocks(spark):
    docs = spark.createDataFrame([(1, "<Heading>A</Heading>x\n\ny<prose>b\nc</prose>"), (2, None), (3, " \n"), (4, "<a>open")], "doc_id int, text string")
    got = [(r["doc_id"], r["seq"], r["tag"], r["text"]) for r in documents.parse_blocks(docs, "doc_id", "text").orderBy("doc_id", "seq").collect()]
    assert got == [(1, 0, "heading", "A"), (1, 1, "prose", "x"), (1, 2, "prose", "y"), (1, 3, "prose", "b\nc"), (4, 0, "prose", "<a>open")]


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(rows)], "doc_id int, seq bigint, tag string, text string")


def test_front_matter_is_dropped_until_prose_that_is_none(spark):
    long = "यह बहुत लंबा गद्य है जो किसी भी प्रकार से प्रकाशन की सूचना नहीं है और आगे चलता ही जाता है, चलता ही जाता है।"
    rows = [("subheading", "लेखक"), ("prose", "राम"), ("prose", long), ("prose", "छोटा।"), ("heading", "अध्याय"), ("prose", "क।")]
    kept = [r["text"] for r in documents.drop_front_matter(blocks(spark, rows), "doc_id").orderBy("seq").collect()]
    assert kept == [long, "छोटा।", "अध्याय", "क।"]


def test_stitch_against_a_sequential_model(spark):
    rng = random.Random(5)
    rows = []
    for d in range(30):
        for i in range(rng.randint(1, 14)):
            words = " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(1, 4)))
            rows.append((d, i, rng.choice(["prose", "paragraph", "quote", "heading"]), words + rng.choice(["", "", ".", "!", "-"])))
    df = spark.createDataFrame(rows, "doc_id int, seq bigint, tag string, text string")
    got = {}
    for r in documents.stitch(df, "doc_id").orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append((r["tag"], r["text"]))
    joins = ("prose", "paragraph", "quote")
    for d in range(30):
        out = []
        for _, _, tag, text in sorted(r for r in rows if r[0] == d):
            if out and out[-1][0] in joins and tag in joins and before in joins and not re.search(r"[.!]$", last):  # noqa: F821
                old = out[-1][1]
                if re.search(r"\w-$", old):
                    new = old[:-1] + text
                else:
                    a, b = old.split()[-1], text.split()[0]
                    new = f"{old} {text[len(b):].strip() if a == b else text}"
                out[-1] = (out[-1][0], new)
            else:
                out.append((tag, text))
            last, before = text, tag
        assert [(t, " ".join(x.split())) for t, x in out] == [(t, " ".join(x.split())) for t, x in got[d]], d


def test_sentences_and_chunks(spark):
    df = spark.createDataFrame([("पं. श्रीराम डॉ. राम से मिले। मूल्य 3.14 है। ॐ शान्तिः॥ Mr. X went. He came.",)], "t string")
    got = df.select(segments.split_sentences(F.col("t")).alias("s")).first()["s"]
    assert got == ["पं. श्रीराम डॉ. राम से मिले।", "मूल्य 3.14 है।", "ॐ शान्तिः॥", "Mr. X went.", "He came."]
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) + rng.choice(["", "", "."]) for _ in range(60)) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segments.pack_pieces(F.col("t"), 2, 22).alias("c")).collect()
    for r in rows:
        assert all(len(c["text"]) <= 22 for c in r["c"])
        assert " ".join(c["text"] for c in r["c"]) == r["t"]


def test_a_word_beyond_the_limit_is_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="exceeds"):
        spark.createDataFrame([("x" * 50,)], "t string").select(segments.wrap_words(F.col("t"), 10).alias("w")).collect()


def test_a_word_beyond_the_limit_is_a_chunk_with_a_fault(spark):
    text = "aa bb " + "x" * 30 + " cc. Dd."
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(segments.pack_pieces(F.col("t"), 8, 10)).alias("c"))
    got = [tuple(r) for r in df.select("c.text", "c.closed", segments.chunk_fault(F.col("c.text"), 10)).collect()]
    assert got == [("aa bb", False, None), ("x" * 30, False, "word_too_long"), ("cc. Dd.", True, None)]


def test_registered_chunks_hold_both_limits(spark, tmp_path):
    """Against a sequential model: sentences longer than 1,400 characters are cut inside, with no pause there."""
    from granthvahi.plans import QUERIES

    sentence = " ".join(["word"] * 700) + "."
    texts = [sentence, " ".join(["one two."] * 400).replace(". o", ". O"), "z" * 1500]
    spark.createDataFrame([(1, f"<prose>{texts[0]}</prose><prose>{texts[1]}</prose><prose>{texts[2]}</prose>")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, 1, f"c{i}", i, t, "prose", 0, 1, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "segment_key bigint, doc_id int, id string, seq int, source_text string, segment_type string, pause_after_ms int, page int, paragraph int").write.parquet(f"{tmp_path}/segments.parquet")

    def model(text, most):
        chunks, now, ended = [], [], True
        for s in re.split(r"(?<=\.)\s+(?=[A-Z])", text):
            pieces, piece = [], ""
            for w in s.split():
                if piece and len(piece) + 1 + len(w) > 1400:
                    pieces.append(piece)
                    piece = ""
                piece = f"{piece} {w}".strip()
            pieces.append(piece)
            for i, p in enumerate(pieces):
                if now and (len(" ".join(now)) + 1 + len(p) > 1400 or len(now) >= most and ended):
                    chunks.append((" ".join(now), ended))
                    now = []
                now.append(p)
                ended = i == len(pieces) - 1
        return [*chunks, (" ".join(now), ended)]

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = [(r["text"], r["pause_after_ms"], r["fault"]) for r in QUERIES["document_segments"](spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(md5(t), 220 if closed else 0, "word_too_long" if len(t) > 1400 else None) for x in texts for t, closed in model(x, 8)]
    got = [(r["text"], r["closed"], r["fault"]) for r in QUERIES["greedy_chunks"](spark, str(tmp_path)).orderBy("segment_key", "chunk").collect()]
    assert got == [(md5(t), closed, "word_too_long" if len(t) > 1400 else None) for x in texts for t, closed in model(x, 3)]


def test_make_segments(spark):
    rows = [("metadata_page", "7"), ("heading", "अध्याय"), ("prose", "एक है। दो है?\n\nतीन है।"), ("metadata_page", "8"), ("shloka", "क ख ॥")]
    got = segments.make_segments(blocks(spark, rows), "doc_id").orderBy("seq").collect()
    assert [(r["id"], r["segment_type"], r["page"], r["paragraph"], r["pause_after_ms"]) for r in got] == [
        ("chunk_0001", "heading", 7, 1, 1000), ("chunk_0002", "question", 7, 2, 500), ("chunk_0003", "prose", 7, 3, 220), ("chunk_0004", "shloka", 8, 1, 800),
    ]


def test_ordered_operators_equal_plain_windows(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, rng.randint(0, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, o bigint, v int")
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("o")
    full = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("o", F.coalesce(F.sum("v").over(full), F.lit(0)).alias("s"), F.row_number().over(w).alias("n"), F.last("v", True).over(full).alias("l"), F.lag("v").over(w).alias("g"))
    got = running_sum(df, ["k"], "o", F.col("v"), "s", span=7)
    got = last_known(numbered(got, ["k"], "o", "n", span=7), ["k"], "o", F.col("v"), "l", span=7)
    got = with_neighbour(got, ["k"], "n", ["v"], -1, "_g").withColumnRenamed("v_g", "g").select("o", "s", "n", "l", "g")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_clean_documents_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "लेखक")], "doc_id int, text string")
    assert documents.clean_documents(docs, "doc_id", "text").count() == 0
