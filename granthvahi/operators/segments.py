"""Blocks to narration segments: pages, paragraphs, sentences, bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATIONS, squeeze
from ..session import cut
from .ordered import last_known, numbered

# The pause after a chunk in milliseconds by kind.
PAUSES = {
    "heading": 1000, "subheading": 600, "book_title": 1400, "shloka": 800, "stanza": 800, "mantra": 800, "chant_refrain": 700, "gloss": 350,
    "question": 500, "quote": 400, "reflective": 400, "conclusion": 600, "prose": 220, "paragraph": 220, "sentence": 220,
}
STRUCTURAL = ("heading", "subheading", "book_title", "shloka", "stanza", "mantra")
# Words that open a turn of thought and a conclusion.
TURN = "किंतु|परंतु|लेकिन|इसके विपरीत|दूसरी घटना|दूसरी ओर"
CONCLUSION = "इस प्रकार|अतः|इसलिए मनुष्य|निष्कर्षतः"
_HOLD = ""
_BOUND = r"(?<![\p{L}\p{N}_])"


def carry_pages(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks that are read, with ``page``: the number of the last page mark before them."""
    mark = F.when(F.col("tag") == "metadata_page", F.trim("text").try_cast("int"))
    return last_known(blocks, [key], "seq", mark, "page").where("tag <> 'metadata_page'")


def paragraphs(blocks: DataFrame, key: str) -> DataFrame:
    """key, seq, part, tag, page, paragraph, text: blocks cut at blank lines and counted on each page."""
    cut = blocks.select(key, "seq", "tag", "page", F.posexplode(F.filter(F.split("text", r"\n\s*\n"), lambda p: p.rlike(r"\S"))).alias("part", "text"))
    cut = cut.withColumn("_o", F.col("seq") * 100_000 + F.col("part"))
    return numbered(cut, [key, "page"], "_o", "paragraph", span=5_000_000_000).drop("_o").withColumn("text", squeeze(F.col("text")))


def split_sentences(text: Column) -> Column:
    """Sentences of a paragraph as an array; stops after abbreviations, initials and list numbers end none."""
    abbreviation = rf"(?iu){_BOUND}({'|'.join(a.replace('.', chr(92) + '.') for a in ABBREVIATIONS)}|[A-Za-z]|[ऀ-ॿ])\."
    held = F.regexp_replace(F.trim(text), abbreviation, f"$1{_HOLD}")
    held = F.regexp_replace(held, r"(^|\s)([०-९\d]+)\.", f"$1$2{_HOLD}")
    parts = F.split(held, r"(?<=[।॥!?])\s+|(?<=\.)\s+(?=[A-Zऀ-ॿ])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit(_HOLD), F.lit(".")))), lambda s: s != "")


def wrap_words(sentence: Column, limit: int, strict: bool = True) -> Column:
    """Pieces of at most ``limit`` characters, cut at blanks. A longer word is an error,
    or where not ``strict`` a piece of its own."""
    words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")

    def add(a: Column, w: Column) -> Column:
        fits = (a["now"] == "") | (F.length(a["now"]) + 1 + F.length(w) <= limit)
        safe = w if not strict else F.when(F.length(w) > limit, F.raise_error(F.concat(F.lit(f"a word exceeds {limit} characters: "), w)).cast("string")).otherwise(w)
        return F.when(fits, F.struct(a["done"].alias("done"), F.trim(F.concat_ws(" ", a["now"], safe)).alias("now"))).otherwise(
            F.struct(F.array_append(a["done"], a["now"]).alias("done"), safe.alias("now"))
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    return F.aggregate(words, zero, add, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def pack_pieces(text: Column, sentences: int = 8, limit: int = 1400) -> Column:
    """Chunks of a paragraph: array of (text, pieces, closed). A chunk takes pieces while
    they fit ``limit`` characters, and at a sentence's end no more than ``sentences`` pieces.
    A longer word is a chunk of its own, which ``chunk_fault`` names."""
    per_sentence = F.transform(split_sentences(text), lambda s: wrap_words(s, limit, strict=False))
    pieces = F.flatten(F.transform(per_sentence, lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("p"), (i == F.size(ps) - 1).alias("end")))))
    chunk = lambda t, n, e: F.struct(t.alias("text"), n.alias("pieces"), e.alias("closed"))

    def add(a: Column, x: Column) -> Column:
        full = (F.length(a["t"]) + 1 + F.length(x["p"]) > limit) | ((a["n"] >= sentences) & a["e"])
        started = (a["n"] > 0) & full
        done = F.when(started, F.array_append(a["done"], chunk(a["t"], a["n"], a["e"]))).otherwise(a["done"])
        fresh = started | (a["n"] == 0)
        return F.struct(
            done.alias("done"), F.when(fresh, x["p"]).otherwise(F.concat_ws(" ", a["t"], x["p"])).alias("t"), F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"), x["end"].alias("e")
        )

    zero = F.struct(
        F.array().cast("array<struct<text:string,pieces:int,closed:boolean>>").alias("done"), F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("e")
    )
    return F.aggregate(pieces, zero, add, lambda a: F.when(a["n"] == 0, a["done"]).otherwise(F.array_append(a["done"], chunk(a["t"], a["n"], a["e"]))))


def chunk_fault(text: Column, limit: int = 1400) -> Column:
    """'word_too_long' for a chunk beyond the limit, which only a single word can be; else null."""
    return F.when(F.length(text) > limit, "word_too_long")


def speech_kind(text: Column, tag: Column) -> Column:
    """The kind a chunk is spoken as: prose is told apart by its marks and first words."""
    t = F.trim(text)
    after = r"(?![\p{L}\p{N}_])"
    quoted = (t.startswith("“") & t.endswith("”")) | (t.startswith('"') & t.endswith('"'))
    return (
        F.when(~tag.isin("prose", "paragraph", "sentence"), tag)
        .when(t.endswith("?"), "question")
        .when(t.endswith("!"), "emphasis")
        .when(quoted, "quote")
        .when(t.rlike(f"^(?:{TURN}){after}"), "reflective")
        .when(t.rlike(f"^(?:{CONCLUSION}){after}"), "conclusion")
        .otherwise(tag)
    )


def pause_after(kind: Column, tag: Column, closed: Column, last: Column) -> Column:
    """Milliseconds of silence after a chunk; none inside a sentence."""
    table = F.create_map(*[F.lit(x) for kv in PAUSES.items() for x in kv])
    default = F.when(last, F.lit(220)).otherwise(F.lit(350))
    chosen = F.when(tag.isin(*STRUCTURAL), F.try_element_at(table, tag)).otherwise(F.coalesce(F.try_element_at(table, kind), default))
    return F.when(closed, chosen).otherwise(F.lit(0))


def chunk_ids(rows: DataFrame, keys: list[str], order: str, name: str = "id") -> DataFrame:
    """``rows`` with ids chunk_0001, chunk_0002, ... in order within each group."""
    return numbered(rows, keys, order, "_n").withColumn(name, F.format_string("chunk_%04d", "_n")).drop("_n")


def make_segments(blocks: DataFrame, key: str, sentences: int = 8, limit: int = 1400) -> DataFrame:
    """key, seq, id, source_text, segment_type, pause_after_ms, page, paragraph, fault of the whole pipeline."""
    rows = paragraphs(carry_pages(cut(blocks), key), key).where("text <> ''")
    packed = cut(rows.select(key, "seq", "part", "tag", "page", "paragraph", pack_pieces(F.col("text"), sentences, limit).alias("_c")))
    chunks = packed.select("*", F.posexplode("_c").alias("k", "c"), F.size("_c").alias("_k"))
    kind = speech_kind(F.col("c.text"), F.col("tag"))
    out = chunks.select(
        key, (F.col("seq") * 100_000_000 + F.col("part") * 10_000 + F.col("k")).alias("_o"), F.col("c.text").alias("source_text"), kind.alias("segment_type"),
        pause_after(kind, F.col("tag"), F.col("c.closed"), F.col("k") == F.col("_k") - 1).alias("pause_after_ms"), "page", "paragraph",
        chunk_fault(F.col("c.text"), limit).alias("fault"),
    )
    out = numbered(out, [key], "_o", "seq", span=5_000_000_000_000)
    return out.withColumn("id", F.format_string("chunk_%04d", "seq")).drop("_o")


def breath_groups(text: Column) -> Column:
    """Array of (text, pause_ms): parts that end at a mark, with the pause it asks for."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[।॥?!,])"), lambda p: F.trim(p)), lambda p: p != "")
    pause = lambda p: F.when(F.substring(p, -1, 1).isin("।", "॥", "?", "!"), 700).when(p.endswith(","), 350).otherwise(150)
    return F.transform(parts, lambda p: F.struct(p.alias("text"), pause(p).alias("pause_ms")))
