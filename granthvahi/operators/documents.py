"""Tagged documents as rows of blocks: parse, clean, stitch, render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .ordered import last_known, numbered, running_sum, with_neighbour

# Tags that may be stitched, and those that head a section.
STITCHED = ("prose", "paragraph", "quote")
HEADINGS = ("heading", "subheading")


def parse_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, tag, text: one row per block in order; text outside tags is prose, cut at
    blank lines. Null and blank documents have no row; the tag is in lower case. The two
    control characters that part blocks here are dropped from the text first."""
    marked = F.regexp_replace(F.translate(F.col(text), "\u0001\u0002", ""), r"(?s)<([a-zA-Z0-9_]+)>(.*?)</\1>", "\u0001$1\u0002$2\u0001")
    parts = F.transform(
        F.split(marked, "\u0001"),
        lambda p: F.when(
            p.contains("\u0002"),
            F.array(F.struct(F.lower(F.substring_index(p, "\u0002", 1)).alias("tag"), F.trim(F.substring_index(p, "\u0002", -1)).alias("text"))),
        ).otherwise(F.transform(F.split(p, "\n\n"), lambda x: F.struct(F.lit("prose").alias("tag"), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("text")))),
    )
    kept = F.filter(F.flatten(parts), lambda b: b["text"].rlike(r"\S") | (b["tag"] != "prose"))
    return docs.where(F.col(text).rlike(r"\S")).select(F.col(key), F.posexplode(kept).alias("seq", "b")).select(key, F.col("seq").cast("bigint"), "b.tag", F.regexp_replace("b.text", r"^\s+|\s+$", "").alias("text"))


def with_titles(blocks: DataFrame, key: str, titles: DataFrame | None = None) -> DataFrame:
    """Blocks with ``title``: the given one (key, title), else the document's first heading.
    An aggregate and a join on the key, so no document has to fit into a task."""
    first = blocks.where("tag = 'heading'").groupBy(key).agg(F.min_by("text", "seq").alias("_h"))
    given = first.select(key, F.col("_h").alias("title"))
    if titles is not None:
        given = first.join(titles.groupBy(key).agg(F.max("title").alias("_t")), key, "full_outer").select(key, F.coalesce(F.nullif(F.trim("_t"), F.lit("")), "_h").alias("title"))
    return blocks.join(given, key, "left")


def drop_running_headers(blocks: DataFrame, key: str, titles: DataFrame | None = None) -> DataFrame:
    """Blocks without those that are nothing but the document's title or a page number, and
    without the title leaked in at a block's end. A heading that is the title stays."""
    rows = with_titles(blocks, key, titles)
    page, heading = F.col("tag") == "metadata_page", F.col("tag") == "heading"
    rows = rows.where(page | heading | ~F.coalesce(T.is_running_header(F.col("text"), F.col("title")), F.lit(False)))
    return rows.withColumn("text", F.when(page | heading, F.col("text")).otherwise(T.drop_trailing_header(F.col("text"), F.col("title")))).drop("title")


def drop_front_matter(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks without labels of front matter and the values that follow them.

    A label opens a skip that lasts over prose that looks like its value (a
    publishing note, an author, or fewer than 60 characters); a heading or other
    prose closes it. The state before each row is the last event before it."""
    label = F.col("text").rlike(T.HEADER_LABEL)
    value = F.col("text").rlike(T.PUBLISHING) | F.col("text").rlike(T.AUTHOR_LINE) | (F.length("text") < 60)
    event = F.when(label, "open").when(F.col("tag").isin(*HEADINGS) | ((F.col("tag") == "prose") & ~value), "close")
    state = last_known(blocks, [key], "seq", event, "_state", inclusive=False)
    skipped = label | ((F.col("tag") == "prose") & value & (F.coalesce(F.col("_state"), F.lit("close")) == "open"))
    kept = state.where((F.col("tag") == "metadata_page") | ~skipped).drop("_state")
    published = F.col("text").rlike(T.PUBLISHING) & (F.length("text") < 200)
    return kept.where((F.col("tag") == "metadata_page") | ~(F.col("text").rlike(T.AUTHOR_LINE) | published))


def drop_artifacts(blocks: DataFrame) -> DataFrame:
    """Blocks without contents lists, adverts and remnants; page remnants are trimmed."""
    page = F.col("tag") == "metadata_page"
    kept = blocks.where(page | ~T.is_artifact_block(F.col("text")))
    trimmed = T.drop_trailing_page_number(T.drop_page_remnants(F.col("text")))
    return kept.withColumn("text", F.when(page, F.col("text")).otherwise(trimmed)).where("text <> ''")


def drop_repeated_headings(blocks: DataFrame, key: str) -> DataFrame:
    """Of headings that follow each other and differ in blanks, vowel signs and dandas only, the first."""
    rows = numbered(blocks, [key], "seq", "_n").withColumn("_same", F.when(F.col("tag") == "heading", F.regexp_replace("text", r"[\sंँेै।॥]+", "")))
    rows = with_neighbour(rows, [key], "_n", ["_same"], -1, "_before")
    return rows.where(~F.coalesce(F.col("_same") == F.col("_same_before"), F.lit(False))).drop("_n", "_same", "_same_before")


def drop_artifact_lines(blocks: DataFrame) -> DataFrame:
    """Blocks without artifact lines, repeated or not."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: ~T.is_artifact_line(x))
    page = F.col("tag") == "metadata_page"
    return blocks.withColumn("text", F.when(page, F.col("text")).otherwise(F.array_join(F.transform(lines, lambda x: F.trim(x)), "\n"))).where("text <> ''")


def join_parts(parts: Column) -> Column:
    """Parts of a broken block: a hyphen at the end joins words, a catchword is dropped."""

    def add(done: Column, part: Column) -> Column:
        last, first = F.regexp_extract(done, r"(\S+)\s*$", 1), F.regexp_extract(part, r"^(\S+)", 1)
        rest = F.when(last == first, F.trim(F.substr(part, F.length(first) + 1))).otherwise(part)
        hyphen = F.concat(F.regexp_replace(done, r"-\s*$", ""), part)
        return F.when(done == "", part).when(done.rlike(r"[\p{L}\p{N}_]-\s*$"), hyphen).otherwise(F.concat_ws(" ", done, rest))

    return F.aggregate(parts, F.lit(""), add)


def stitch(blocks: DataFrame, key: str) -> DataFrame:
    """Neighbouring prose blocks of which the first doesn't end a sentence become one."""
    rows = numbered(blocks, [key], "seq", "_n").withColumn("_run", F.col("tag").isin(*STITCHED)).withColumn("_open", ~T.ends_sentence(F.col("text")))
    rows = with_neighbour(cut(rows), [key], "_n", ["_run", "_open"], -1, "_before")
    joins = F.col("_run") & F.coalesce(F.col("_run_before") & F.col("_open_before"), F.lit(False))
    rows = running_sum(rows, [key], "seq", F.when(joins, 0).otherwise(1), "_island")
    parts = F.array_sort(F.collect_list(F.struct("seq", "tag", "text")))
    out = rows.groupBy(key, "_island").agg(parts.alias("_p"))
    return out.select(key, F.col("_p")[0]["seq"].alias("seq"), F.col("_p")[0]["tag"].alias("tag"), join_parts(F.col("_p.text")).alias("text"))


def clean_documents(docs: DataFrame, key: str, text: str, titles: DataFrame | None = None) -> DataFrame:
    """The whole cleaning of tagged text: key, seq, tag, text of the blocks that are read aloud.
    titles (key, title) names the running headers; without it first headings do."""
    prepared = T.pipes_to_dandas(T.repair_tags(T.drop_page_breaks(F.col(text))))
    blocks = parse_blocks(docs.select(F.col(key), prepared.alias("_text")), key, "_text")
    # ordered steps read their input more than once: what is costly is written down between them
    blocks = cut(drop_artifacts(blocks))
    blocks = cut(drop_running_headers(drop_front_matter(blocks, key), key, titles))
    blocks = cut(drop_artifact_lines(drop_repeated_headings(blocks, key)))
    return stitch(blocks, key)


def render_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """key, text: the blocks of each document with their tags, in order."""
    one = F.concat(F.lit("<"), F.col("tag"), F.lit(">"), F.col("text"), F.lit("</"), F.col("tag"), F.lit(">"))
    listed = F.array_sort(F.collect_list(F.struct("seq", one.alias("b"))))
    return blocks.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("text"))
