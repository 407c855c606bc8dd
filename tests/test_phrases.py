"""Phrases against brute force over all windows with difflib."""

import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from granthvahi.operators import phrases


def brute(note, sentence):
    n, words = len(note.split(" ")), sentence.split(" ")
    windows = [" ".join(words[i : i + w]) for w in range(max(1, n - 1), min(len(words), n + 3) + 1) for i in range(len(words) - w + 1)] or [sentence]
    best = max(windows, key=lambda w: SequenceMatcher(None, note, w).ratio())
    bones = SequenceMatcher(None, phrases.skeleton(note), phrases.skeleton(best)).ratio()
    return round(max(SequenceMatcher(None, note, best).ratio(), bones), 4), best


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ei", max_size=20), st.lists(st.text("abcd ei", max_size=30), max_size=12))
def test_ratios_are_those_of_matching_blocks(a, texts):
    assert list(phrases.ratios(a, texts)) == [SequenceMatcher(None, a, t).ratio() for t in texts]


def test_best_of_a_block_is_the_best_of_all_windows():
    rng = random.Random(5)
    syllables = "ka ri mu to ne sha dra pi lo wen a ur bram jna".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    sentences = [line(14) for _ in range(150)] + ["x" * 230 + " ka", "a", "ka"]
    starts, ids = phrases.Starts(sentences), [(f"p{i:03d}", 0) for i in range(len(sentences))]
    for note in [line(4) for _ in range(40)] + ["a", line(30), "x" * 250]:
        want = sorted(((s, i, w) for i, t in zip(ids, sentences, strict=True) for s, w in [brute(note, t)] if s >= 0.55), key=lambda x: (-x[0], x[1]))[:3]
        assert phrases.best_of_block(note, starts, ids, 3, 0.55, chunk=16) == want


def test_phrases_of_odd_tables(spark):
    notes = [(1, "a", "jeevan shakti"), (1, "b", None), (1, "c", "?"), (2, "d", "shunya"), (1, "a", "jeevan shakti"), (3, "e", "man")]
    texts = [(1, "p1", "मन में जीवन शक्ति है। और घर"), (1, "p2", None), (1, "p3", "घर"), (2, "p4", "वह बी० ए० है। घर"), (1, "p1", "मन में जीवन शक्ति है। और घर")]
    n = spark.createDataFrame(notes, "doc_id bigint, note_id string, note string")
    p = spark.createDataFrame(texts, "doc_id bigint, passage_id string, text string").selectExpr("*", "1 as score", "2 as note")
    got = phrases.phrase_matches(n, p, ["doc_id"], note_block=1, sentence_block=1)
    rows = {(r["note_id"], r["rank"]): (r["passage_id"], r["sentence_no"], r["score"]) for r in got.collect()}
    assert rows["a", 1] == ("p1", 0, brute("jewan sakti", "mn men jiwn skti h")[0]) and rows["d", 1] == ("p4", 0, 1.0) and {k[0] for k in rows} == {"a", "d"}
    assert phrases.phrase_matches(n.limit(0), p, ["doc_id"]).count() == 0
    one = phrases.single_match(got, ["doc_id", "note_id"]).collect()
    assert [(r["note_id"], r["passage_id"]) for r in sorted(one)] == [("a", "p1"), ("d", "p4")]


def test_books_at_once_are_as_good_as_each_note_alone_and_cost_less():
    rng = random.Random(11)
    syllables = "ka ri mu to ne sha dra pi lo wen a ur bram jna".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    vocabulary = [word() for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    spent = [0.0, 0.0]
    for n in (1, 3):
        held = [(b, (f"p{i:04d}", 0), line(rng.randint(1, 14))) for b, size in ((1, 1500), (2, 1), (3, 40), (4, 130)) for i in range(size)]
        asked = [(b, " ".join(word() for _ in range(n))) for b, size in ((1, 200), (2, 2), (3, 1), (4, 9), (5, 1)) for _ in range(size)]
        asked += [(1, " ".join(["x" * 80] * n)), (4, " ".join(["a"] * n)), asked[0]]
        rng.shuffle(held)
        began = time.process_time()
        got = phrases.best_of_books(asked, held, 3, 0.55)
        spent[0] += time.process_time() - began
        rows = {}
        for i, score, k, window in got:
            rows.setdefault(i, []).append((score, held[k][1], window))
        began = time.process_time()
        blocks = {b: [x for x in held if x[0] == b] for b in range(1, 6)}
        starts = {b: phrases.Starts([x[2] for x in mine]) for b, mine in blocks.items() if mine}
        for i, (b, note) in enumerate(asked):
            want = phrases.best_of_block(note, starts[b], [x[1] for x in blocks[b]], 3, 0.55) if blocks[b] else []
            assert sorted(rows.get(i, []), key=lambda x: (-x[0], x[1])) == want
        spent[1] += time.process_time() - began
    assert spent[0] < spent[1] / 2
