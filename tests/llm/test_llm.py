import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granthvahi.llm import language, lookalikes, nearest_time, packing, quality, scans, sentences, splitting, tokenize
from granthvahi.llm.queries import oracle_sql, queries
from tests.conftest import DATA

VOCABULARY = tokenize.DEFAULT_VOCABULARY
ALPHABETS = ["ab", "it's don't 're", "अआकखगम्ाि ", "云海了远北。", "a b  \n'", "é1, x"]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(ALPHABETS), st.integers(1, 700), st.integers(3, 90), st.integers(0, 10**6))
def test_joined_leaves_give_the_ids_of_the_whole(alphabet, n, leaf, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(alphabet) for _ in range(n))
    code = tokenize.codec(VOCABULARY)
    leaves = [(text[i : i + leaf], code.encode(text[i : i + leaf])) for i in range(0, n, leaf)]
    assert np.array_equal(tokenize.join_tree(code, leaves), code.encode(text))


def test_token_ids_of_nulls_empties_long_texts_and_clashing_names(spark):
    long = "यह मन है। " * 900 + "x" * 5000
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hello world", "c"), (4, long, "d")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenize.token_ids(df, leaf_chars=1000).collect()}
    code = tokenize.codec(VOCABULARY)
    assert got == {1: [], 2: [], 3: code.encode("hello world").tolist(), 4: code.encode(long).tolist()}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokenize.token_counts(df, leaf_chars=1000).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenize.token_ids(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_every_item_once_within_the_capacity(histogram):
    for tiers in (1, 4):
        patterns = packing.plan_patterns(dict(histogram), 64, tiers)
        held: dict[int, int] = {}
        for windows, n in patterns:
            assert sum(w for w, _ in windows) <= 64 and n > 0
            for w, inside in windows:
                assert sum(inside) <= w and max(inside) > 0
                for s in inside:
                    held[s] = held.get(s, 0) + n
        assert held == histogram
        if histogram:
            total = sum(s * n for s, n in histogram.items())
            assert sum(n for _, n in patterns) <= max(2 * -(-total // 64), 1) + tiers - 1


def test_tiers_have_windows_of_their_own_and_fill_longer_ones():
    histogram = {40: 3, 20: 4, 12: 5, 3: 30}
    one, four = packing.plan_patterns(histogram, 64, 1), packing.plan_patterns(histogram, 64, 4)
    assert one != four and {w for ws, _ in one for w, _ in ws} == {64}
    windows = [w for ws, n in four for w in ws * n]
    assert sorted(w for w, _ in windows if w == 64) == [64] * 3
    assert all(max(inside) > w // 2 or w == 8 for w, inside in windows)  # each window is opened by its own tier
    assert any(min(inside) <= w // 4 for w, inside in windows if w > 8)  # and filled from shorter ones
    assert sum(n for _, n in four) <= sum(n for _, n in one) + 1


def test_pack_rows(spark):
    rows = [(i, n) for i, n in enumerate([0, None, 5, 5, 5, 12, 25, 1, 3, 10, 10])] + [(2, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, n int").withColumn("container", F.lit("clash"))
    got = packing.pack(df, "doc_id", "n", 10, rank_buckets=3).collect()
    fill: dict[int, int] = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["piece_size"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == sum(n or 0 for _, n in rows)
    windows: dict[tuple, list] = {}
    for r in got:
        windows.setdefault((r["container"], r["window"]), [r["window_size"], 0])[1] += r["piece_size"]
    assert all(n <= w for w, n in windows.values())
    groups: dict[int, int] = {}
    for r in packing.pack(df, "doc_id", "n", 10, step=3).collect():
        groups[r["step_group"]] = groups.get(r["step_group"], 0) + r["piece_size"]
    assert max(groups.values()) - min(groups.values()) <= 2 * 10
    pieces = sorted((r["piece"], r["piece_size"]) for r in got if r["doc_id"] == 6)
    assert pieces == [(0, 10), (1, 10), (2, 5)]
    assert packing.pack(df.limit(0), "doc_id", "n", 10).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80), st.lists(st.integers(0, 300), max_size=30), st.integers(0, 9))
def test_nearest_equals_brute_force(times, asked, tolerance):
    t, q = np.sort(np.array(times, float) / 4), np.array(asked, float) / 4
    got = nearest_time.nearest_in_shard(t, q, tolerance, error=2)
    for x, k in zip(q, got, strict=True):
        d = np.abs(t - x)
        if not len(t) or d.min() > tolerance:
            assert k == -1
        else:
            assert d[k] == d.min() and k == np.flatnonzero(d == d.min())[0]


def test_nearest_across_shards_nulls_and_repeats(spark):
    t = spark.createDataFrame([(1, f"c{i:03d}", float(i * 7)) for i in range(200)] * 2 + [(1, None, 3.0), (1, "n", None), (None, "x", 1.0), (2, "nan", float("nan"))], "entity bigint, id string, t double")
    rng = random.Random(1)
    asked = [(1, f"q{i}", rng.uniform(-20, 1500)) for i in range(300)] + [(2, "z", 1.0), (3, "y", 1.0)]
    q = spark.createDataFrame(asked, "entity bigint, id string, t double")
    got = {r["id"]: r["target_id"] for r in nearest_time.nearest(q, t, 3.0, shard_seconds=20.0).collect()}
    for _, k, x in asked[:300]:
        best = min(range(200), key=lambda i: (abs(i * 7 - x), i))
        assert got.get(k) == (f"c{best:03d}" if abs(best * 7 - x) <= 3.0 else None)
    assert nearest_time.nearest(q.limit(0), t, 3.0).count() == 0


TIMES = {
    "00:01:02": 62.0, "1:02": 62.0, "102:16": 6136.0, " 0:00:03 ": 3.0, "00.12.15": 735.0, "10m00s": 600.0, "1h 13m 17s": 4397.0, "148": 148.0, "००:१२:१२": 732.0, "0m10s": 10.0,
    "": None, "?": None, "--:--": None, "00:xx:10": None, "page end": None, None: None, "0:75:10": None,
}


def test_times_written_by_hand(spark):
    df = spark.createDataFrame([(k,) for k in TIMES], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", nearest_time.read_seconds(F.col("s")).alias("t")).collect()} == TIMES


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n।中😀é", max_size=400), st.sampled_from(["characters", "utf8_bytes"]))
def test_pieces_cover_the_text_within_the_limit(text, unit):
    limit, overlap = 40, 8
    size = (lambda s: len(s)) if unit == "characters" else (lambda s: len(s.encode()))
    got = splitting.split_text(text, limit, overlap, unit)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:], strict=False):
        assert c <= b < d and size(text[c:b]) <= overlap < size(text[c:b]) + 4 + (unit == "characters")
    assert all(size(text[a:b]) <= limit for a, b in got) and (len(got) == 1) == (size(text) <= limit)


def test_cuts_lie_at_natural_places():
    text = ("Eins zwei drei. " * 12).strip()
    assert all(text[b - 1] == " " and text[b - 2] == "." for _, b in splitting.split_text(text, 100, 10)[:-1])


def test_same_look_pairs(spark):
    rows = [
        ("s", 1, "गुरुः मन"), ("s", 2, "गुरु: मन"), ("s", 3, "गुरू: मन"), ("s", 4, "force"), ("s", 5, "fοrce"), ("s", 6, "fоrce"), ("s", 7, "Force"), ("s", 8, "é"), ("s", 9, "é"), ("s", 10, "e"),
        ("s", 11, "a​b"), ("s", 12, "ab"), ("s", 12, "ab"), ("s", 13, None), ("s", 14, ""), ("s", 15, "है|"), ("s", 16, "है।"), ("s", 17, "है॥"), ("t", 18, "ab"), ("s", 19, "ａｂ"), ("s", 20, "कहा:"),
    ]
    df = spark.createDataFrame(rows, "kind string, key bigint, text string").withColumn("raw", F.lit(1))
    got = {(r["key_a"], r["key_b"]) for r in lookalikes.same_look(df).collect()}
    assert got == {(1, 2), (4, 5), (4, 6), (5, 6), (8, 9), (11, 12), (11, 19), (12, 19), (15, 16)}
    assert lookalikes.same_look(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_normal_form_is_stable(text):
    once = lookalikes.normal_form(text)
    assert lookalikes.normal_form(once) == once and unicodedata.is_normalized("NFC", once)


def events(lines, all_words=False):
    plain = [] if all_words else None
    got = sentences.count_lines(lines, plain)
    got.update(plain or ())
    counts = dict(got)
    totals = {}
    for (kind, _, b), n in counts.items():
        kind = -1 - kind if kind in (sentences.FIRST, sentences.INSIDE) and sentences.HAN.match(b) else kind
        totals[kind] = totals.get(kind, 0.0) + n
    for (kind, a, b), n in list(counts.items()):
        if kind in (sentences.PAIR, sentences.NEXT):
            types = sentences.PAIR_TYPES if kind == sentences.PAIR else sentences.NEXT_TYPES
            counts[types, a, ""] = counts.get((types, a, ""), 0) + 1
        if kind == sentences.MARKED:
            counts[sentences.FIRST, "", b] = counts.get((sentences.FIRST, "", b), 0) + n
    return sentences.HiddenEvents(counts, totals, {})


LINES = ["The man saw Dr. Smith today.", "He went e.g. home again now.", "The end came to us today.", "She said it was late now. The dog went home.", "We met Dr. Brown at noon. He went home."] * 30
CASES = [
    ("The man met Dr. Smith today. He went home.", ["He"]),
    ("एक है। दो है?तीन है!", ["दो", "तीन"]),
    ("“क है?” राम ने पूछा। वह गया।", ["वह"]),
    ("राम ने कहा, “क है।” वह गया।", ["वह"]),
    ("क है। (14.66) ख है। (९)", ["ख"]),
    ("क ख ।\nग घ ॥ ५ ॥ च", ["ग", "च"]),
    ("मूल्य 3.14 है... और वह गया।", []),
    ("没有。很好！「好？」", ["很", "「"]),
    ("no marks at all here", []),
    ("", []),
]


@pytest.mark.parametrize("text, starts", CASES)
def test_sentence_starts(text, starts):
    got = sentences.cuts(events(LINES), text)
    assert [text[k:].startswith(s) for k, s in zip(got, starts, strict=True)] == [True] * len(starts)


HINDI = ["वह घर में गया था।", "मन का दीपक जलता है।", "यह नदी बहती रहती है।", "उस गाँव में एक शिक्षक रहता था।", "हम सब साथ चलते हैं।", "यह फल मीठा है।", "वह मित्र आया था।", "जीवन में साधना चाहिए।"] * 12
HAN = ["他去了山上。", "我们在这里学习。", "老师说话很慢。", "这条河流很长。", "他有一个朋友。", "我们喜欢读书。", "这里没有人。", "老师住在村里。"] * 12
BREAKS = [("वह घर में गया था यह फल मीठा है हम सब साथ चलते हैं", ["यह", "हम"]), ("他去了山上我们喜欢读书这条河流很长", ["我们", "这条"]), ("यह", [])]


@pytest.mark.parametrize("text, starts", BREAKS)
def test_sentences_without_marks(text, starts):
    got = sentences.cuts(events(HINDI + HAN, True), text, True)
    assert [next((s for s in starts if text[k:].startswith(s)), text[k:]) for k in got] == starts


def test_marks_learn_what_follows_them():
    start, inside = [(2.0, 90.0), (-1.0, 10.0)], [(-2.0, 90.0), (0.5, 10.0)]
    assert sentences.share_of_boundaries(start, 0.5) > 0.9 and sentences.share_of_boundaries(inside, 0.5) < 0.15
    assert sentences.share_of_boundaries([], 0.8) == pytest.approx(0.8)


def test_sentence_units_in_blocks(spark):
    rows = [(i, t) for i, t in enumerate([a + b for a, b in zip(HINDI[:8], HINDI[1:9], strict=True)] + [t for t, _ in BREAKS])]
    df = spark.createDataFrame(rows, "segment_key bigint, source_text string").withColumn("sentence", F.lit("x"))
    learnt = spark.createDataFrame([(t,) for t in HINDI + HAN] + [(None,)], "text string")
    a = sorted(map(tuple, sentences.sentence_units(df, "segment_key", "source_text", learn_from=learnt, block_rows=2).collect()))
    b = sorted(map(tuple, sentences.sentence_units(df, "segment_key", "source_text", learn_from=learnt).collect()))
    assert a == b and [r[4] for r in a if r[0] == 9] == ["他去了山上", "我们喜欢读书", "这条河流很长"]
    for k, text in rows:
        assert "".join(text[x:y] for i, _, x, y, _ in a if i == k).replace(" ", "") == text.replace(" ", "")


def test_posteriors_against_enumeration():
    import itertools
    import math

    odds, gaps = [0.3, -1.0, 2.0, 0.1], [0, 1, 2, 5]
    link = {1: math.exp(-3), 2: math.exp(-1)}
    total, on = 0.0, [0.0] * 4
    for bits in itertools.product([0, 1], repeat=4):
        w = math.exp(sum(o for o, b in zip(odds, bits, strict=True) if b))
        for i in range(1, 4):
            if bits[i] and bits[i - 1]:
                w *= link.get(gaps[i], 1.0)
        total += w
        for i in range(4):
            on[i] += w * bits[i]
    assert np.allclose(sentences.posteriors(odds, gaps), [x / total for x in on])


def test_sentence_rows_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "क है। ख है।"), (3, "क है। ख है।")], "segment_key bigint, source_text string").withColumn("cut_at", F.lit("x"))
    assert [tuple(r) for r in sentences.sentence_cuts(df, "segment_key", "source_text").collect()] == [(3, 6)]
    assert [tuple(r) for r in sentences.sentence_cuts(df.replace("क है। ख है।", "a\nb"), "segment_key", "source_text").collect()] == [(3, 2)]
    assert sentences.sentence_cuts(df.limit(0), "segment_key", "source_text").count() == 0


SAMPLE = {
    "en": ["the man and the dog went to the house with a friend", "there was no reason for this and that", "he had to wait for the rain"],
    "de": ["der mann und die frau gehen nach hause mit dem hund", "das ist nicht für den freund", "wir haben die zeit und den weg"],
    "hi": ["यह मन का घर है और वह नहीं गया", "वह घर में है और यह नहीं", "इस घर का मन नहीं है"],
    "mr": ["हे घर आहे आणि ते नाही", "तो घरी आहे पण ती नाही", "या घराचे मन आहे आणि नाही"],
}


def test_languages_are_told_apart():
    profiles = language.fit([(k, t + ".") for k, ts in SAMPLE.items() for t in ts] * 5, dimensions=4096)
    known = frozenset("the and no this is nicht und है और का आहे आणि".split())
    got = language.judge(profiles, ["यह घर है और वह नहीं। the dog and the man had no house. वह मन का है।", "", "a1b2c3/" * 20], known)
    assert [g[2] for g in got[0]] == ["hi", "en", "hi"] and got[1] == []
    assert not any(g[4] for g in got[2])
    profiles.prototypes = np.roll(profiles.prototypes, 1, axis=0)  # the prototypes decide: others, other languages
    profiles.norms = np.roll(profiles.norms, 1)
    profiles._reset()
    assert [g[2] for g in language.judge(profiles, ["वह मन का है। वह घर है।", "the dog and the man had no house."], known)[1]] != ["en"]


def test_cosines_are_those_of_the_bundles():
    profiles = language.fit([(k, t + ".") for k, ts in SAMPLE.items() for t in ts] * 5, dimensions=2048)
    profiles.measured = profiles.dimensions
    profiles._reset()
    texts = [t.split() for ts in SAMPLE.values() for t in ts] + [[], ["x"] * 200]
    got = profiles.cosines(*profiles.bundles(texts))
    for words, row in zip(texts, got, strict=True):
        bundle = sum((profiles.vector(g).astype(float) for w in words for g in language.grams(w)), np.zeros(2048))
        want = profiles.prototypes @ bundle / max(np.linalg.norm(bundle), 1) / profiles.norms
        assert np.allclose(row, want, atol=1e-4)


@pytest.mark.parametrize("label, code", [("hi-IN", "hi"), ("Hindi", "hi"), ("hin", "hi"), ("en_GB", "en"), ("und", ""), (None, ""), ("", ""), ("te", "te")])
def test_labels(label, code):
    assert language.label_language(label) == code


TYPED = ["वह पुस्तक पढ़ता है और जीवन में साधना करता है। माता-पिता का ध्यान रखता है और मन में शक्ति है।"] * 40 + ["the mind and the teacher was not a pupil in the village with a lamp"] * 40
COMMON = frozenset("और है में का the and".split())
PAGES = [
    ("वह पुस्तक पढ़ता\nहै।", set()),
    ("वह पुस्-\nतक पढ़ता है।", {"hyphen"}),
    ("वह माता-\nपिता का है।", set()),
    ("वह जीबन में\nहै।", {"misread"}),
    ("the rnind and the teacher", {"misread"}),
    ("the vi11age and the teacher", {"misread"}),
    ("वह पुस्तक\n- १२ -\nपढ़ता है।", {"page_number"}),
    ("वह पुस्तक पढ़ता है और\n12 | जीवन साधना\nमन में शक्ति है।", {"header"}),
    ("वह पुस्-\n[ जीवन साधना ]\n१२\nतक पढ़ता है और जीबन\nमें शक्ति है।", {"hyphen", "header", "page_number", "misread"}),
    ("जीवन साधना", set()),
    ("", set()),
    (None, set()),
]


def scanned(spark, pages, typed=TYPED, headings=("जीवन साधना",) * 30, title="जीवन साधना"):
    p = spark.createDataFrame([(i, t, title, None) for i, t in enumerate(pages)] * 2, "key bigint, text string, title string, page int").withColumn("out", F.lit(1))
    t = spark.createDataFrame([(x, False) for x in typed] + [(x, True) for x in headings] + [(None, False)], "text string, heading boolean")
    return p, t


def test_damage_of_scans(spark):
    p, t = scanned(spark, [x for x, _ in PAGES])
    for block_rows in (2, 5000):
        got = scans.page_damage(p, t, COMMON, block_rows).collect()
        assert len(got) == len({tuple(r) for r in got})
        for i, (text, kinds) in enumerate(PAGES):
            assert {r["damage"] for r in got if r["key"] == i} == kinds, text
    assert scans.page_damage(p.limit(0), t, COMMON).count() == 0
    assert {r["damage"] for r in scans.page_damage(p, t.limit(0), COMMON).collect()} <= {"hyphen", "page_number", "header", "misread"}


def test_repaired_text(spark):
    p, t = scanned(spark, [x for x, _ in PAGES])
    got = {r["key"]: r["text"] for r in scans.repaired_pages(p, t, COMMON).collect()}
    assert got[8] == "वह पुस्तक पढ़ता है और जीवन में शक्ति है।" and got[5] == "the village and the teacher" and 11 not in got


def test_misreadings_are_what_decode_changes_at_any_corpus_size(spark):
    typed = ["the lamp is on the hill"] * 4 + ["the mind and the teacher was not a pupil in the village"] * 60
    for times in (1, 20):
        got = scans.repaired_pages(*scanned(spark, ["the lamp is on the bill", "the"], typed * times, ()), frozenset(["the"])).collect()
        assert {r["text"] for r in got} == {"the lamp is on the hill", "the"}


def test_a_larger_vocabulary_hides_no_misreading(spark):
    p, t = scanned(spark, ["वह जीबन में\nहै।"])
    padding = spark.range(300_000).select(F.concat(F.lit("q"), F.conv("id", 10, 36), F.lit("x q"), F.conv("id", 10, 36), F.lit("x")).alias("text"), F.lit(False).alias("heading"))
    typed = t.where("not heading").select(F.explode(F.array_repeat("text", 40)).alias("text"), "heading").unionByName(padding)
    assert [r["damage"] for r in scans.page_damage(p, typed, COMMON).collect()] == ["misread"]


def test_readings_are_explained_by_confusions():
    assert scans.explain("rnarne", "mame", {})[1] == [("rn", "m")] * 2 and scans.explain("dirnnu", "dimnu", {})[1] == [("rn", "m")]
    assert scans.explain("lamp", "lamp", {}) is None and scans.explain("1950", "l950", {}) is None and scans.explain("साघना", "साधना", {})[1] == [("घ", "ध")]


def test_decoding_equals_enumeration():
    import itertools
    import math

    rng = random.Random(3)
    for _ in range(20):
        options = [[(f"w{k}{i}", 5, rng.uniform(-9, -1)) for i in range(rng.randint(1, 3))] for k in range(4)]
        pairs = {scans.pair_key(a[0], b[0]): rng.randint(0, 9) for x, y in zip(options, options[1:], strict=False) for a in x for b in y}
        score = lambda path: sum(o[2] for o in path) + sum(math.log1p(pairs[scans.pair_key(a[0], b[0])]) for a, b in zip(path, path[1:], strict=False))  # noqa: E731,B023
        assert tuple(scans.decode(options, pairs)) == max(itertools.product(*options), key=score)


FORMS = [
    ("यह मन है और वह घर में है। वह गया।", "prose"), ("• मन\n• जीवन साधना\n• घर\n• फल\n• गुरु", "list"), ("(1) मन ....... 5\n(2) जीवन ....... 8\n(3) घर ........ 12\n(4) फल ..... 15", "list"),
    ("मन | 12 | 3.5\nघर | 14 | 9\nफल | 9 | 1\nगुरु | 8 | 2", "table"), ("a,12,x\nb,14,y\nc,15,z\nd,16,q", "table"), ("wind " * 60, "junk"), ("]~=/;>^.] .<$>*=]$_@<[_|$~^>@" * 4, "junk"),
    ("===PAGE_BREAK===\n&nbsp;\n<prose></prose>\n(cid:30)", "junk"), ("जो क्रोध है वह मन ही कहा गया है ।\nयह मौन बहुत करते हैं ॥ ५ ॥", "prose"), ("", None), (None, None), (" \n\t", None),
]


@pytest.mark.parametrize("text, form", FORMS)
def test_forms(text, form):
    assert quality.measure(text, frozenset("है और में वह यह ही".split()), frozenset())[-1] == form


def test_statistics_have_a_row_for_every_document(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FORMS)] + [(0, FORMS[0][0])], "doc_id bigint, text string").withColumn("form", F.lit(1))
    words = spark.createDataFrame([("hi", "है"), ("hi", None)], "lang string, word string")
    assert quality.text_statistics(df, words).count() == len(FORMS) + 1
    assert quality.text_statistics(df.limit(0), words).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, name):
    assert queries()[name](spark, DATA).count() >= 0


def test_found_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("segments", "passages", "size_limits", "offsets", "feedback", "lexicon", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, DATA)
        assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()), name
