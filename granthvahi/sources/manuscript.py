"""The editable manuscript: passages as a text and as rows, and what a voice may be given."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.functions import pandas_udf

from ..functions.text import escape_markup

# The grammar's fields with their defaults, and what voices take.
FIELDS = {
    "PAGE": ("page", "?"), "PDF_PAGE": ("pdf_page", "?"), "TYPE": ("kind", "prose"), "PAUSE_AFTER_MS": ("pause", "600"), "RATE": ("rate", "+0%"),
    "PITCH": ("pitch", "+0Hz"), "VOLUME": ("volume", "+0%"), "TAKE": ("take", "0"), "PARENTS": ("parents", ""),
}
MARKUP_VOICES = ("google", "gcloud", "gemini", "azure")
ELEMENTS = {
    "speak": "version lang", "p": "", "s": "", "break": "time strength", "prosody": "rate pitch volume", "phoneme": "alphabet ph", "sub": "alias",
    "say-as": "interpret-as format detail", "emphasis": "level",
}
KNOBS = {"edge": "rate pitch volume", "azure": "rate pitch volume", "google": "rate", "gcloud": "rate", "gemini": "rate", "sarvam": "rate", "sarvamai": "rate", "sarvam-ai": "rate"}


def parse_manuscripts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, id, the FIELDS, text, mode, speech, fault: one row per passage. fault names
    what is wrong with it (null if nothing): bad sections, an unknown or repeated field, a bad number."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?==== Passage [A-Za-z0-9_-]{1,80} ===[ \t]*(?:\n|$))")
    rows = docs.select(key, F.posexplode(parts).alias("seq", "_p")).where("seq > 0")
    body = F.regexp_replace("_p", r"^=== Passage [A-Za-z0-9_-]{1,80} ===[ \t]*\n?", "")
    form = r"(?s)^(.*?)(?:^|\n)TEXT:[ \t]*\n(.*?)\n(SPEECH|SSML):[ \t]*(?:\n(.*))?$"
    part = lambda i: F.regexp_extract(body, form, i)
    lines = F.filter(F.split(part(1), "\n"), lambda x: F.trim(x) != "")
    names = F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1)))
    bad = F.size(F.array_except(names, F.array(*[F.lit(f) for f in FIELDS]))) > 0
    value = lambda f, d: F.coalesce(F.trim(F.substr(F.get(F.filter(lines, lambda x: F.trim(F.substring_index(x, ":", 1)) == f), F.lit(0)), F.lit(len(f) + 2))), F.lit(d))
    cols = {c: value(f, d) for f, (c, d) in FIELDS.items()}
    sections = F.size(F.regexp_extract_all(body, F.lit(r"(?m)^(TEXT|SPEECH|SSML):[ \t]*$"), F.lit(1)))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    fault = (
        F.when((sections != 2) | ~body.rlike(form), "sections")
        .when(bad, "unknown_field")
        .when(F.size(names) != F.size(F.array_distinct(names)), "repeated_field")
        .when(cols["pause"].try_cast("int").isNull() | cols["take"].try_cast("int").isNull() | (cols["take"].try_cast("int") < 0), "number")
        .when((cols["pdf_page"] != "?") & ~cols["pdf_page"].rlike("^[1-9][0-9]*$"), "pdf_page")
        .when((strip(part(4)) == "") | (cols["page"] == ""), "empty")
    )
    named = {c: v.try_cast("int") if c in ("pause", "take") else v for c, v in cols.items()}
    named["parents"] = F.filter(F.split(cols["parents"], r"\s+"), lambda x: x != "")
    got = rows.select(key, "seq", F.regexp_extract("_p", r"^=== Passage ([A-Za-z0-9_-]{1,80})", 1).alias("id"), *[v.alias(c) for c, v in named.items()], strip(part(2)).alias("text"), part(3).alias("mode"), strip(part(4)).alias("speech"), fault.alias("fault"))
    twice = got.groupBy(key, "id").agg(F.count("*").alias("_n"))
    return got.join(twice, [key, "id"]).withColumn("fault", F.coalesce("fault", F.when(F.col("_n") > 1, "duplicate_id"))).drop("_n")


def passage_text() -> Column:
    """A passage's block in the manuscript."""
    line = lambda f, c: F.concat(F.lit(f"{f}: "), F.coalesce(F.array_join(c, " ") if f == "PARENTS" else F.col(c).cast("string"), F.lit(FIELDS[f][1])), F.lit("\n"))
    return F.concat(
        F.lit("=== Passage "), F.col("id"), F.lit(" ===\n"), *[line(f, c) for f, (c, _) in FIELDS.items()],
        F.lit("\nTEXT:\n"), F.col("text"), F.lit("\n\n"), F.col("mode"), F.lit(":\n"), F.coalesce(F.col("speech"), F.lit("(inherit)")), F.lit("\n"),
    )


def render_manuscripts(passages: DataFrame, key: str, order: str) -> DataFrame:
    """key, text: the passages of each book in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, passage_text().alias("_t"))))
    return passages.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["_t"]), "\n").alias("text"))


def _markup_fault(text: str | None) -> str | None:
    if text is None:
        return "empty"
    if re.search(r"<!|<\?", text):
        return "declaration"
    try:
        root = ET.fromstring(text if text.lstrip().startswith("<speak") else f"<speak>{text}</speak>")
    except ET.ParseError:
        return "malformed"
    for node in root.iter():
        tag = node.tag.rpartition("}")[2]
        if tag not in ELEMENTS:
            return f"element {tag}"
        if {a.rpartition("}")[2] for a in node.attrib} - set(ELEMENTS[tag].split()):
            return f"attribute of {tag}"
    return None if "".join(root.itertext()).strip() and root.tag.rpartition("}")[2] == "speak" else "empty"


@pandas_udf(ty.StringType())
def markup_fault(text: pd.Series) -> pd.Series:
    """What is wrong with a passage's markup, null if nothing: no parser of XML is built in that tells."""
    return text.map(_markup_fault)


def unsupported_knobs(passages: DataFrame, provider: Column) -> DataFrame:
    """id, knob of passages that set what their voice doesn't take."""
    table = F.create_map(*[x for p, k in KNOBS.items() for x in (F.lit(p), F.split(F.lit(k), " "))])
    takes = F.coalesce(F.try_element_at(table, provider), F.array().cast("array<string>"))
    knob = lambda c, d: F.when((F.col(c) != d) & ~F.array_contains(takes, c), F.lit(c))
    return passages.select("id", F.explode(F.array_compact(F.array(knob("rate", "+0%"), knob("pitch", "+0Hz"), knob("volume", "+0%")))).alias("knob"))


def render_markup(passages: DataFrame, key: str, order: str, line_break_ms: int = 450) -> DataFrame:
    """key, markup: the passages of each book as speech markup, in order."""
    text = F.replace(escape_markup(F.col("text")), F.lit("\n"), F.lit(f'<break time="{line_break_ms}ms"/>'))
    one = F.format_string('<prosody rate="%s" pitch="%s" volume="%s">%s</prosody><break time="%sms"/>', "rate", "pitch", "volume", text, F.col("pause").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct(order, one.alias("_m"))))
    return passages.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["_m"]), "\n").alias("markup"))
