"""Column functions over text: rewriting, predicates, digests. All of them stay in the JVM.

Every function takes and gives a Column; a null gives null (predicates: null).
Java's ``\\s`` and ``\\b`` differ from what these rules mean for Devanagari, so
classes and look-arounds are spelt out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transport marks of scanned text and misread tags.
PAGE_BREAKS = [r"(?i)={2,}\s*PAGE[_ -]?BREAK\s*={2,}", r"(?i)\bPAGE[_ -]?BREAK\b", r"(?i)(?:\bequals\b\s*){2,}\bpage\s*break\b"]
TAG_TYPOS = [("pro5e", "prose"), ("he4ding", "heading"), ("subhe4ding", "subheading")]
# Half consonants that are written as anusvara.
ANUSVARA = [("ङ्क", "ंक"), ("ञ्च", "ंच"), ("ण्ड", "ंड"), ("न्त", "ंत"), ("म्प", "ंप")]
# Labels, phrases and marks of front matter and of the page's frame.
HEADER_LABEL = (
    r"(?iu)^(?:लेखक|रचयिता|संपादक|संकलनकर्ता|प्रकाशक|मुद्रक|संस्करण|पुनर्मुद्रण|मूल्य|सहयोग\s*राशि|वितरक|आईएसबीएन|ISBN|"
    r"सर्वाधिकार\s*सुरक्षित|कॉपीराइट|प्रकाशकीय\s*(?:निवेदन|वक्तव्य)?)\s*[:：\-—]?\s*$"
)
PUBLISHING = (
    r"(?iu)(?:युग\s*निर्माण\s*योजना|गायत्री\s*तपोभूमि|अखण्ड\s*ज्योति\s*संस्थान|मथुरा\s*[-–—]\s*[२2][८8][१1][०0][०0][३3]|शांतिकुंज\s*,\s*हरिद्वार|"
    r"प्रथम\s*संस्करण|द्वितीय\s*संस्करण|पुनर्मुद्रण|पुनरावृत्ति|मूल्य\s*[:：]|सर्वाधिकार\s*प्रकाशकाधीन|मुद्रक\s*:\s*)"
)
AUTHOR_LINE = r"(?iu)^[—\-–]?\s*(?:पं०\s*|पंडित\s*|श्री\s*)?श्रीराम\s*शर्मा\s*आचार्य\s*$"
PAGE_NUMBER = r"^(?:[\)\]\(\[\s—\-–|।॥]+[०-९\d]{1,4}[\)\]\(\[\s—\-–|।॥]+|[०-९\d]{1,4})$"
ADVERT = (
    r"(?i)(?:free\s*read|download\s*&?\s*order|www\.|https?://|vicharkranti(?:books|pustakalay)?|literature\.awgp|awgp\.org|all\s+world\s+gayatri|"
    r"book\s+made\s+available|book\s+digitized|our\s+main\s+cent(?:er|re)s|phone\s*(?:no|number)?\s*:|\b(?:india|gujarat|surat|haridwar|mathura)\b\s*[-,])"
)
FIELD_LABEL = r"(?i)^\s*(?:author|editor|publisher|printer|edition|price|[ऀ-ॿ]{2,20})\s*[:：]?\s*$"
CONTENTS_HEADING = r"(?i)^\s*(?:(?:contents|table\s+of\s+contents)\s*[:：-]?|विषय\s*[-–—]?\s*सूची|अनुक्रमणिका)\s*$"
NUMBERED_ITEM = r"(?:^|\s)[०-९\d]{1,3}\s*[.)-]\s+"
MARKUP = r"(?:^\s{0,3}#{1,6}\s*|\*\*?|__?|`+|\s*\|\s*)"
UNCLEAR = "[अस्पष्ट]"
# Abbreviations after which a full stop does not end a sentence.
ABBREVIATIONS = ["पं", "डॉ", "प्रो", "श्री", "श्रीमती", "कु", "ले", "इ", "उदा", "सं", "वि", "स्व", "चि", "dr", "mr", "mrs", "ms", "prof", "st", "e.g", "i.e", "vs", "etc"]
# The romanisation of Devanagari letters.
ROMAN_VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
ROMAN_SIGNS = {"ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au"}
ROMAN_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
ROMAN_MARKS = {"ं": "n", "ँ": "n", "ः": "h", "ॐ": "om", "ऽ": "", "्": ""}
# Canonical forms of Devanagari letters with a dot below.
DOT_BELOW = [
    ("\u0928\u093c", "\u0929"), ("\u0930\u093c", "\u0931"), ("\u0933\u093c", "\u0934"),
    ("\u0958", "\u0915\u093c"), ("\u0959", "\u0916\u093c"), ("\u095a", "\u0917\u093c"), ("\u095b", "\u091c\u093c"),
    ("\u095c", "\u0921\u093c"), ("\u095d", "\u0922\u093c"), ("\u095e", "\u092b\u093c"), ("\u095f", "\u092f\u093c"),
]
# Punctuation that token comparison ignores.
TOKEN_PUNCTUATION = r"[।॥,.!?;:'\"“”‘’()\[\]{}—–\-…]"

Rewrite = tuple[str, str]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def chain(text: Column, rules: list[Rewrite]) -> Column:
    """Regex rewrites one after another; their order matters."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def swap(text: Column, rules: list[Rewrite]) -> Column:
    """Literal rewrites one after another; their order matters."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pipes_to_dandas(text: Column) -> Column:
    return swap(text, [("||", "॥"), ("|", "।")])


def drop_page_breaks(text: Column) -> Column:
    return chain(text, [(p, "\n\n") for p in PAGE_BREAKS])


def repair_tags(text: Column) -> Column:
    rules = [(rf"(?i)<\s*{bad}\s*>", f"<{good}>") for bad, good in TAG_TYPOS] + [(rf"(?i)<\s*/\s*{bad}\s*>", f"</{good}>") for bad, good in TAG_TYPOS]
    return chain(text, rules)


def anusvara(text: Column) -> Column:
    return F.regexp_replace(swap(text, ANUSVARA), r"\s+([ािीुूेैोौंँः])", "$1")


def line_without_tags(text: Column) -> Column:
    return squeeze(chain(text, [(r"</?[a-zA-Z0-9_]+>", ""), (MARKUP, " ")]))


def furniture_key(text: Column) -> Column:
    """What is the same in all copies of a running header: no page number, no case."""
    edge = r"[\s\[\](){}|\-]*[०-९\d]{1,4}[\s\[\](){}|\-]*"
    return F.lower(squeeze(chain(line_without_tags(text), [(f"^{edge}", ""), (f"{edge}$", "")])))


def drop_markdown(text: Column) -> Column:
    return F.trim(chain(text, [(r"^\s*#{1,6}\s*", ""), (r"\*\*?|__?|`+", "")]))


def drop_page_remnants(text: Column) -> Column:
    first = F.trim(F.regexp_replace(text, r"^\s*[०-९\d]{1,4}\s*\]\s*\[\s*", ""))
    return F.trim(F.regexp_replace(first, r"\s+[०-९\d]{1,4}\s*\]\s*\[\s*[^।॥!?]{3,120}\s*$", ""))


def drop_trailing_page_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s]+[\)\]]+\s*[\(\[]+\s*[०-९\d]+\s*$", ""))


def title_pattern(title: Column) -> Column:
    """A pattern for the title as pages repeat it: blanks, anusvara and vowel marks may differ. Null for a blank title."""
    escaped = F.regexp_replace(F.trim(title), r"([.^$*+?()\[\]{}|\\-])", r"\\$1")
    return F.nullif(F.regexp_replace(escaped, r"[\sंँेै]+", r"[\\sंँेै]*"), F.lit(""))


# What may stand around a running header.
AROUND_HEADER = r"[\s)\]\[(—\-–|।॥०-९\d]"


def is_running_header(text: Column, title: Column) -> Column:
    """A page number, or nothing but the book's title, marks and digits."""
    named = F.concat(F.lit(f"(?i)^{AROUND_HEADER}*(?:"), title_pattern(title), F.lit(f"{AROUND_HEADER}*)+$"))
    return F.trim(text).rlike(PAGE_NUMBER) | F.coalesce(F.rlike(F.trim(text), named), F.lit(False))


def drop_trailing_header(text: Column, title: Column) -> Column:
    """The text without the title and page number that leaked in at its end; never empty."""
    ending = F.concat(F.lit(r"(?i)[\s,।॥—\-–]*(?:"), title_pattern(title), F.lit(f"){AROUND_HEADER}*$"))
    kept = F.trim(F.regexp_replace(text, ending, F.lit("")))
    return F.when(title_pattern(title).isNull() | (kept == ""), text).otherwise(kept)


def is_front_matter(text: Column) -> Column:
    """Labels, author lines, publishing notes below 200 characters, page numbers, nothing at all."""
    return let(F.trim(text), lambda t: (t == "") | t.rlike(HEADER_LABEL) | t.rlike(AUTHOR_LINE) | (t.rlike(PUBLISHING) & (F.length(t) < 200)) | t.rlike(PAGE_NUMBER))


def is_artifact_line(text: Column) -> Column:
    return let(
        line_without_tags(text),
        lambda v: (v == "")
        | ~v.rlike(r"[A-Za-zऀ-ॿ]")
        | v.rlike(ADVERT)
        | v.rlike(PAGE_NUMBER)
        | v.rlike(r"^[_?\- .|]{5,}$")
        | (v.rlike(PUBLISHING) & (F.length(v) <= 220)),
    )


def is_contents_block(text: Column) -> Column:
    return let(line_without_tags(text), lambda v: v.rlike(CONTENTS_HEADING) | (F.size(F.regexp_extract_all(v, F.lit(NUMBERED_ITEM), F.lit(0))) >= 5))


def is_artifact_block(text: Column) -> Column:
    whole = let(
        line_without_tags(text),
        lambda v: F.when(v == "", True)
        .when(v.rlike(CONTENTS_HEADING) | (F.size(F.regexp_extract_all(v, F.lit(NUMBERED_ITEM), F.lit(0))) >= 5), True)
        .when((F.length(v) <= 260) & F.exists(F.split(text, r"\r?\n"), lambda x: line_without_tags(x).rlike(FIELD_LABEL)), True)
        .when(v.rlike(ADVERT) & ~v.rlike(r"[ऀ-ॿ]"), True)
        .otherwise(False),
    )
    return whole | F.forall(F.split(text, r"\r?\n"), is_artifact_line)


def ends_sentence(text: Column) -> Column:
    """Danda, question or exclamation mark, or a full stop after no abbreviation and more than an initial."""
    stops = [f"{a}." for a in ABBREVIATIONS]
    last = lambda t: F.lower(F.regexp_replace(F.regexp_extract(t, r"(\S+)$", 1), "['\"”’]$", ""))
    full = lambda t: let(last(t), lambda w: ~(w.isin(stops) | (F.length(w) <= 2)))
    return let(F.trim(text), lambda t: F.when(t.rlike("[।॥!?]['\"”’]?$"), True).when(t.rlike("\\.['\"”’]?$"), full(t)).otherwise(False))


def usable_embedded_text(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) >= 40) & ~t.contains("�") & ~t.contains("(cid:") & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 20)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation, for transcript comparison (text in NFC)."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), TOKEN_PUNCTUATION, " "), r"\s+"), lambda w: w != "")


def clock_seconds(value: Column) -> Column:
    """ss, mm:ss or hh:mm:ss as seconds; null for anything else."""
    parts = F.split(F.trim(value), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.try_cast("double"))
    return F.when((F.size(parts) <= 3) & F.trim(value).rlike(r"^\d+(?:\.\d+)?(?::\d+(?:\.\d+)?)*$"), total)


def page_query(query: Column) -> Column:
    """The page a search asks for (p35, p:x, page iv); null if it asks for something else."""
    t = F.trim(query)
    named = F.regexp_extract(t, r"(?i)^page\s+([0-9]+|[ivxlcdm]+)$", 1)
    short = F.regexp_extract(t, r"(?i)^p[.:]?\s*([0-9]+|[ivxlcdm]+)$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(short, F.lit("")))


def mark_counts(text: Column) -> Column:
    """Counts of the Devanagari marks that pronunciation review looks at."""
    n = lambda m: F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))
    return F.struct(
        n("ँ").alias("chandrabindu"), n("ं").alias("anusvara"), n("ः").alias("visarga"), n("ऽ").alias("avagraha"), n("्").alias("virama"),
        (F.length(text) - F.length(F.regexp_replace(text, "[ािीुूृॄॅॆेैॉॊोौ]", ""))).alias("vowel_signs"),
        text.rlike("[ँःऽ॒॓॑॔ॐ]").alias("has_sanskrit_marks"),
    )


def nfc_devanagari(text: Column) -> Column:
    """Composed form of Devanagari: letters with a dot below that Unicode composes are one
    character, those it excludes are two. Text of other scripts is left as it is."""
    return swap(text, DOT_BELOW)


def romanize(text: Column) -> Column:
    """Devanagari in Latin letters without schwa; vowel runs give their first vowel, all else a blank."""
    letters = ROMAN_VOWELS | ROMAN_SIGNS | ROMAN_CONSONANTS | ROMAN_MARKS
    t = swap(F.lower(text), list(letters.items()))
    return squeeze(chain(t, [(r"[^\x00-\x7f]", " "), (r"([aeiou])[aeiou]*", "$1"), (r"[^a-z0-9]+", " ")]))


def roman_note(text: Column) -> Column:
    """A reviewer's romanised note in one spelling."""
    t = swap(F.lower(text), [("sh", "s"), ("ph", "f")])
    return squeeze(F.replace(chain(t, [(r"[^a-z0-9]+", " "), (r"([aeiou])[aeiou]*", "$1")]), F.lit("v"), F.lit("w")))


def consonants(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), "[aeiou]", "")


def comma_before_conjunctions(text: Column) -> Column:
    """No blank before marks, no comma before coordinating conjunctions."""
    return squeeze(chain(text, [(r"\s+([।॥,])", "$1"), (r",\s*(और|तथा|एवं|या)\s+", " $1 ")]))


def plain_speech(text: Column) -> Column:
    """Markup for a voice that takes none: pauses as dashes, tags gone."""
    return squeeze(chain(text, [(r"<break[^>]*/?>", " — "), (r"<[^>]+>", "")]))


def speaking_rate(rate: Column, low: float = 0.25) -> Column:
    """'+10%' as 1.1, clamped to low..2; 1.0 if it can't be read."""
    n = F.regexp_extract(F.coalesce(rate, F.lit("")), r"^([+-]?\d+)%$", 1).try_cast("double")
    return F.when(n.isNull(), 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(low), 1 + n / 100)))


def escape_markup(text: Column) -> Column:
    return swap(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def same_letters(source: Column, markup: Column) -> Column:
    """Whether marked-up text keeps every letter and digit of its source, in order."""
    bare = swap(F.regexp_replace(markup, r"<[^>]+>", ""), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")])
    keep = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    return keep(source) == keep(bare)


#: Latin letters with the plain letter that their decomposition begins with.
FOLDED = {chr(c): d[0] for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(c))) != chr(c) and d[0].isascii() and d[0].isalpha()}


def file_stem(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_]", "")


def slug(text: Column, size: int = 48) -> Column:
    """Lower-case letters and digits joined by dashes; accents are folded, other letters dropped."""
    folded = F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))
    t = F.regexp_replace(F.lower(F.regexp_replace(folded, r"[^\x00-\x7f]", "")), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(t, r"^-+|-+$", ""), 1, size), r"-+$", "")


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit("")).cast("int")


def windows_path(text: Column) -> Column:
    """C:\\x\\y as /mnt/c/x/y; other paths as they are."""
    drive = F.regexp_extract(text, r"^([A-Za-z]):[\\/]", 1)
    rest = F.replace(F.regexp_replace(text, r"^[A-Za-z]:[\\/]", ""), F.lit("\\"), F.lit("/"))
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), rest)).otherwise(text)


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ':'."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def finding_id(key: Column, code: Column, text: Column) -> Column:
    return F.substring(digest(key, code, text), 1, 16)
