"""Queries over text: cleaning, segmentation, speech, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as T
from ..operators import checks, corrections, documents, matching, phrases, prosody
from ..operators import segments as seg
from ..session import load
from ..sources import artifacts, manuscript
from .registry import FEEDBACK_SQL, PASSAGES_SQL, SEGMENTS_SQL, feedback, passages, query, segments


def q(pattern: str) -> str:
    """A pattern as an SQL literal (RE2 takes no u flag and needs none)."""
    return "'" + pattern.replace("(?iu)", "(?i)").replace("'", "''") + "'"


def _nested(column: str, rules: list[tuple[str, str]]) -> str:
    for a, b in rules:
        column = f"replace({column}, '{a}', '{b}')"
    return column


_BARE = f"trim(regexp_replace(regexp_replace(regexp_replace(x, '</?[a-zA-Z0-9_]+>', '', 'g'), {q(T.MARKUP)}, ' ', 'g'), '\\s+', ' ', 'g'))"
_ARTIFACT = (
    f"(v = '' OR NOT regexp_matches(v, '[A-Za-zऀ-ॿ]') OR regexp_matches(v, {q(T.ADVERT)}) OR regexp_matches(v, {q(T.PAGE_NUMBER)}) "
    f"OR regexp_matches(v, '^[_?\\- .|]{{5,}}$') OR (regexp_matches(v, {q(T.PUBLISHING)}) AND length(v) <= 220))"
)


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '||', '॥'), '|', '।'), {q(T.PAGE_BREAKS[0])}, chr(10) || chr(10), 'g'),
    {q(T.PAGE_BREAKS[1])}, chr(10) || chr(10), 'g'), {q(T.PAGE_BREAKS[2])}, chr(10) || chr(10), 'g')) AS cleaned FROM documents""")
def transport_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.md5(T.drop_page_breaks(T.pipes_to_dandas(F.col("text")))).alias("cleaned"))


@query(f"""SELECT doc_id, md5(regexp_replace({_nested('text', T.ANUSVARA)}, '\\s+([ािीुूेैोौंँः])', '\\1', 'g')) AS spelled FROM documents""")
def anusvara_rules(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.md5(T.anusvara(F.col("text"))).alias("spelled"))


@query(f"""SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN {_ARTIFACT} THEN 1 ELSE 0 END) AS BIGINT) AS n_artifacts FROM
    (SELECT doc_id, {_BARE} AS v FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) GROUP BY doc_id""")
def artifact_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(T.is_artifact_line(F.col("x")).cast("bigint")).alias("n_artifacts"))


@query(f"""SELECT doc_id, regexp_matches(v, {q(T.CONTENTS_HEADING)}) OR len(regexp_extract_all(v, {q(T.NUMBERED_ITEM)})) >= 5 AS contents,
    trim(x) = '' OR regexp_matches(trim(x), {q(T.HEADER_LABEL)}) OR regexp_matches(trim(x), {q(T.AUTHOR_LINE)}) OR (regexp_matches(trim(x), {q(T.PUBLISHING)}) AND length(trim(x)) < 200)
    OR regexp_matches(trim(x), {q(T.PAGE_NUMBER)}) AS front_matter FROM (SELECT doc_id, text AS x, {_BARE} AS v FROM (SELECT doc_id, text, text AS x FROM documents))""")
def block_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", T.is_contents_block(t).alias("contents"), T.is_front_matter(t).alias("front_matter"))


@query(f"""SELECT v AS line, count(*) AS n FROM (SELECT lower({_BARE}) AS v FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)) WHERE v <> '' AND length(v) <= 180 GROUP BY v HAVING count(*) >= 3""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand three times or more; partial counts before the shuffle."""
    lines = load(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("x"))
    counts = lines.select(F.lower(T.line_without_tags(F.col("x"))).alias("line")).where("line <> '' and length(line) <= 180").groupBy("line").agg(F.count("*").alias("n"))
    return counts.where("n >= 3")


@query("""SELECT doc_id, coalesce(length(trim(text)) >= 40 AND NOT contains(text, chr(65533)) AND NOT contains(text, '(cid:') AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 20, false) AS usable FROM documents""")
def usable_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.coalesce(T.usable_embedded_text(F.col("text")), F.lit(False)).alias("usable"))


@query("""SELECT doc_id, seq, tag, md5(t) AS block FROM (SELECT doc_id, CAST(generate_subscripts(bs, 1) - 1 AS BIGINT) AS seq, unnest(bs) AS b FROM (
      SELECT doc_id, list_filter(flatten(list_transform(string_split(regexp_replace(regexp_replace(text, '<(metadata_page|prose|heading|subheading|paragraph|quote|shloka|list)>', chr(1) || '\\1' || chr(2), 'g'), '</(?:metadata_page|prose|heading|subheading|paragraph|quote|shloka|list)>', chr(1), 'g'), chr(1)),
        lambda p: CASE WHEN contains(p, chr(2)) THEN [{'tag': lower(string_split(p, chr(2))[1]), 'text': p[instr(p, chr(2)) + 1:]}]
                       ELSE list_transform(string_split(p, chr(10) || chr(10)), lambda x: {'tag': 'prose', 'text': x}) END)),
        lambda b: regexp_matches(b.text, '\\S') OR b.tag <> 'prose') AS bs FROM documents WHERE regexp_matches(text, '\\S'))), LATERAL (SELECT b.tag AS tag, regexp_replace(b.text, '^\\s+|\\s+$', '', 'g') AS t)""")
def block_parse(spark: SparkSession, d: str) -> DataFrame:
    return documents.parse_blocks(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "seq", "tag", F.md5("text").alias("block"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return documents.parse_blocks(load(spark, d, "documents"), "doc_id", "text")


@query()
def clean_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning of every document. Checked by small fixtures against a sequential model."""
    return documents.clean_documents(load(spark, d, "documents"), "doc_id", "text").select("doc_id", "seq", "tag", F.md5("text").alias("block"))


@query()
def document_segments(spark: SparkSession, d: str) -> DataFrame:
    """Narration segments of every document: chunks of 8 pieces and 1,400 characters.
    A word that is longer is a segment of its own with a fault."""
    out = seg.make_segments(_blocks(spark, d), "doc_id", 8, 1400)
    return out.select("doc_id", "seq", "id", F.md5("source_text").alias("text"), "segment_type", "pause_after_ms", "page", "paragraph", "fault")


@query(f"""SELECT segment_key, len(s) AS n, md5(array_to_string(s, '|')) AS listed FROM (SELECT segment_key, list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(source_text), '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(a.replace('.', chr(92) + '.') for a in T.ABBREVIATIONS)}|[A-Za-z]|[ऀ-ॿ])\\.', '\\1\\2' || chr(57344), 'g'), '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(a.replace('.', chr(92) + '.') for a in T.ABBREVIATIONS)}|[A-Za-z]|[ऀ-ॿ])\\.', '\\1\\2' || chr(57344), 'g'),
      '(^|\\s)([०-९\\d]+)\\.', '\\1\\2' || chr(57344), 'g'), '([।॥!?])\\s+', '\\1' || chr(1), 'g'), '(\\.)\\s+([A-Zऀ-ॿ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
      lambda x: trim(replace(x, chr(57344), '.'))), lambda x: x <> '') AS s FROM {SEGMENTS_SQL})""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = seg.split_sentences(F.col("source_text"))
    return segments(spark, d, "segment_key", "source_text").select("segment_key", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "|")).alias("listed"))


@query(f"""SELECT segment_key, md5(array_to_string(list_transform(g, lambda p: p || '|' || CASE WHEN regexp_matches(p, '[।॥?!]$') THEN '700' WHEN regexp_matches(p, ',$') THEN '350' ELSE '150' END), ';')) AS groups
    FROM (SELECT segment_key, list_filter(list_transform(string_split(regexp_replace(source_text, '([।॥?!,])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS g FROM {SEGMENTS_SQL})""")
def breath_groups(spark: SparkSession, d: str) -> DataFrame:
    g = F.transform(seg.breath_groups(F.col("source_text")), lambda x: F.concat_ws("|", x["text"], x["pause_ms"].cast("string")))
    return segments(spark, d, "segment_key", "source_text").select("segment_key", F.md5(F.array_join(g, ";")).alias("groups"))


@query(f"""SELECT segment_key, CASE WHEN segment_type NOT IN ('prose', 'paragraph', 'sentence') THEN segment_type WHEN ends_with(t, '?') THEN 'question' WHEN ends_with(t, '!') THEN 'emphasis'
    WHEN (starts_with(t, '“') AND ends_with(t, '”')) OR (starts_with(t, '"') AND ends_with(t, '"')) THEN 'quote' WHEN regexp_matches(t, '^(?:{seg.TURN})([^\\p{{L}}\\p{{N}}_]|$)') THEN 'reflective'
    WHEN regexp_matches(t, '^(?:{seg.CONCLUSION})([^\\p{{L}}\\p{{N}}_]|$)') THEN 'conclusion' ELSE segment_type END AS kind FROM (SELECT segment_key, segment_type, trim(source_text) AS t FROM {SEGMENTS_SQL})""")
def speech_kinds(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, "segment_key", "segment_type", "source_text").select("segment_key", seg.speech_kind(F.col("source_text"), F.col("segment_type")).alias("kind"))


@query()
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every segment's text by the two limits; a word beyond 1,400 characters is a chunk of its own with a fault."""
    c = F.posexplode(seg.pack_pieces(T.squeeze(F.col("source_text")), 3, 1400)).alias("chunk", "c")
    return segments(spark, d, "segment_key", "source_text").select("segment_key", c).select("segment_key", "chunk", F.md5("c.text").alias("text"), F.col("c.pieces").alias("pieces"), F.col("c.closed").alias("closed"), seg.chunk_fault(F.col("c.text")).alias("fault"))


def _count(mark: str) -> str:
    return f"length(t) - length(replace(t, '{mark}', ''))"


@query(f"""SELECT segment_key, {_count('ँ')} AS chandrabindu, {_count('ं')} AS anusvara, {_count('ः')} AS visarga, {_count('ऽ')} AS avagraha, {_count('्')} AS virama,
    length(t) - length(regexp_replace(t, '[ािीुूृॄॅॆेैॉॊोौ]', '', 'g')) AS vowel_signs FROM (SELECT segment_key, source_text AS t FROM {SEGMENTS_SQL})""")
def mark_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d, "segment_key", "source_text").select("segment_key", T.mark_counts(F.col("source_text")).alias("m"))
    return rows.select("segment_key", *[F.col(f"m.{c}").cast("bigint").alias(c) for c in ("chandrabindu", "anusvara", "visarga", "avagraha", "virama", "vowel_signs")])


_LETTERS = list((T.ROMAN_VOWELS | T.ROMAN_SIGNS | T.ROMAN_CONSONANTS | T.ROMAN_MARKS).items())
_ROMAN = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_nested('lower(x)', _LETTERS)}, '[^\\x00-\\x7f]', ' ', 'g'), '([aeiou])[aeiou]*', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT entry_id, source, {_ROMAN} AS roman FROM (SELECT DISTINCT entry_id, source, source AS x FROM lexicon)")
def romanized(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lexicon").select("entry_id", "source").distinct().select("entry_id", "source", T.romanize(F.col("source")).alias("roman"))


@query(f"""SELECT issue_id, replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(reviewer_text), 'sh', 's'), 'ph', 'f'), '[^a-z0-9]+', ' ', 'g'), '([aeiou])[aeiou]*', '\\1', 'g'), '\\s+', ' ', 'g')), 'v', 'w') AS note FROM {FEEDBACK_SQL}""")
def roman_notes(spark: SparkSession, d: str) -> DataFrame:
    return feedback(spark, d).select("issue_id", T.roman_note(F.col("reviewer_text")).alias("note"))


@query(f"""SELECT segment_key, len(w) AS words, md5(array_to_string(w, '|')) AS listed FROM (SELECT segment_key, list_filter(regexp_split_to_array(regexp_replace(lower(source_text), {q(T.TOKEN_PUNCTUATION)}, ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM {SEGMENTS_SQL})""")
def normalized_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = T.tokens(F.col("source_text"))
    return segments(spark, d, "segment_key", "source_text").select("segment_key", F.size(w).cast("bigint").alias("words"), F.md5(F.array_join(w, "|")).alias("listed"))


@query()
def pronounced(spark: SparkSession, d: str) -> DataFrame:
    """The spoken form of every passage by the built-in lexicon."""
    return passages(spark, d).select("doc_id", "id", lex.explained(F.col("text")).alias("x")).select("doc_id", "id", F.md5("x.transformed").alias("spoken"), "x.modified")


@query("""SELECT source, tts_alias FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY entry_id DESC, tts_alias DESC) AS r FROM lexicon WHERE coalesce(source, '') <> '' AND coalesce(tts_alias, '') <> '') WHERE r = 1""")
def lexicon_load(spark: SparkSession, d: str) -> DataFrame:
    return lex.load_lexicon(load(spark, d, "lexicon"), "entry_id")


@query()
def lexicon_apply(spark: SparkSession, d: str) -> DataFrame:
    """Every passage with the phrases and words of the lexicon table replaced, by a join on first words."""
    rows = passages(spark, d).select("doc_id", "id", "text")
    return lex.pronounce_by_join(rows, ["doc_id", "id"], "text", lexicon_load(spark, d)).select("doc_id", "id", F.md5("spoken").alias("spoken"), (F.col("spoken") != F.col("text")).alias("changed"))


@query()
def breath_marks(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d, "segment_key", "segment_type", "source_text").select("segment_key", F.md5(prosody.breath_marks(F.col("source_text"), F.col("segment_type"))).alias("marked"))


_KINDS = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in prosody.KINDS.items())
_BREAKS = "(" + ", ".join(f"'{k}'" for k in prosody.BREAKS) + ")"


@query(f"""WITH k(kind, r, p, v, pb, pa) AS (VALUES {_KINDS}),
    a AS (SELECT segment_key, doc_id, seq, coalesce(segment_type, 'prose') AS kind, coalesce(pause_after_ms, 0) AS given FROM {SEGMENTS_SQL}),
    b AS (SELECT a.*, k.r, k.p, k.v, k.pb, k.pa, lead(a.kind) OVER w AS nk FROM a LEFT JOIN k ON a.kind = k.kind WINDOW w AS (PARTITION BY doc_id ORDER BY seq, segment_key)),
    c AS (SELECT *, (given >= 550 OR nk IS NULL OR nk IN {_BREAKS}) AS closes FROM b),
    e AS (SELECT *, CASE WHEN r IS NOT NULL THEN greatest(given, pa) WHEN given = 0 THEN CASE WHEN closes THEN 600 ELSE 300 END ELSE given END AS fin FROM c),
    f AS (SELECT *, coalesce(lag(fin) OVER w >= 550, true) OR coalesce(lag(kind) OVER w IN {_BREAKS}, true) AS opens FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY seq, segment_key)),
    g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY seq, segment_key ROWS UNBOUNDED PRECEDING) AS para FROM f),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, para ORDER BY seq, segment_key) - 1 AS pos FROM g)
    SELECT segment_key, format('{{:+d}}%', CAST(-5 + coalesce(r, CASE WHEN pos = 0 AND closes THEN -2 WHEN pos = 0 THEN -3 WHEN closes THEN -4 WHEN pos = 2 THEN 1 ELSE 0 END) AS INTEGER)) AS rate,
      format('{{:+d}}Hz', CAST(coalesce(p, CASE WHEN pos = 0 AND closes THEN 1 WHEN pos = 0 THEN 2 WHEN closes THEN -1 WHEN pos = 1 THEN 1 ELSE greatest(-1, 2 - pos) END) AS INTEGER)) AS pitch,
      format('{{:+d}}%', CAST(coalesce(v, 0) AS INTEGER)) AS volume, CAST(coalesce(pb, 0) AS INTEGER) AS pause_before_ms, CAST(fin AS INTEGER) AS pause_after_ms FROM h""")
def prosody_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d, "segment_key", "doc_id", "seq", "segment_type", "pause_after_ms")
    return prosody.plan_prosody(rows, "doc_id").select("segment_key", "rate", "pitch", "volume", "pause_before_ms", "pause_after_ms")


_RULES = [
    (1, "segment", "exclude", None, None, "heading", None, None, None, None, True, None, None, None, None),
    (2, "segment", "exclude", None, None, "quote", "सुख", None, None, None, None, None, None, None, None),
    (3, "segment", "delete", 7, None, None, "the", None, None, None, True, True, None, None, None),
    (4, "segment", "ocr_correction", None, None, None, "मिलता है", None, "प्राप्त होता है", None, True, None, None, "style", None),
    (5, "segment", "source_correction", None, None, None, None, "प्राप्त", "उपलब्ध", None, None, None, "applied", None, None),
    (6, "segment", "ocr_correction", None, None, None, "जीवन", None, "जीव", None, False, None, None, None, None),
    (7, "phonetics", "alias", None, None, None, "कर्म", None, "करम", None, None, None, "approved", None, None),
    (8, "segment", "remove", None, 2, "list", None, None, None, None, True, False, None, None, None),
]


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, corrections.RULE_SCHEMA)


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


_RULES_SQL = (
    "(VALUES " + ", ".join("(" + ", ".join(_value(x) for x in r) + ")" for r in _RULES) + ") r(rule_id, stage, kind, page, paragraph, segment_type, find, find_text, replace, "
    "tts_override, approved, enabled, status, reason, pause_after_ms)"
)
_APPROVED = """CASE WHEN r.enabled = false THEN false WHEN r.approved IS NOT NULL THEN r.approved WHEN r.kind IN ('exclude', 'delete', 'remove') THEN false
    WHEN r.status IS NULL AND r.stage = 'segment' THEN false ELSE coalesce(r.status, 'approved') IN ('approved', 'applied') END"""


@query(f"SELECT rule_id, {_APPROVED} AS acts FROM {_RULES_SQL}")
def correction_filter(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark).select("rule_id", corrections.approved().alias("acts"))


@query(f"""SELECT s.segment_key FROM {SEGMENTS_SQL} s WHERE NOT EXISTS (SELECT 1 FROM {_RULES_SQL} WHERE r.stage = 'segment' AND {_APPROVED} AND r.kind IN ('exclude', 'delete', 'remove')
    AND (r.page IS NULL OR r.page = s.page) AND (r.paragraph IS NULL OR r.paragraph = s.paragraph) AND (r.segment_type IS NULL OR r.segment_type = s.segment_type)
    AND (coalesce(r.find, r.find_text) IS NULL OR contains(s.source_text, coalesce(r.find, r.find_text))))""")
def correction_removals(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d, "segment_key", "source_text", "segment_type", "page", "paragraph")
    return corrections.remove_segments(rows, _rules(spark)).select("segment_key")


@query(f"""SELECT segment_key, md5(replace(replace(source_text, 'मिलता है', 'प्राप्त होता है'), 'प्राप्त', 'उपलब्ध')) AS corrected,
    CAST(CASE WHEN contains(source_text, 'मिलता है') THEN 1 ELSE 0 END + CASE WHEN contains(replace(source_text, 'मिलता है', 'प्राप्त होता है'), 'प्राप्त') THEN 1 ELSE 0 END AS INTEGER) AS n_audits FROM {SEGMENTS_SQL}""")
def correction_audits(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d, "segment_key", "source_text", "segment_type", "page", "paragraph")
    return corrections.correct_source(rows, _rules(spark)).select("segment_key", F.md5("source_text").alias("corrected"), F.size("audit").alias("n_audits"))


@query(f"""SELECT doc_id, id, 'invalid_id' AS fault FROM {SEGMENTS_SQL} WHERE NOT regexp_full_match(coalesce(id, ''), '[A-Za-z0-9_-]{{1,80}}')
    UNION ALL SELECT doc_id, id, 'empty_text' FROM {SEGMENTS_SQL} WHERE trim(coalesce(source_text, '')) = ''
    UNION ALL SELECT doc_id, id, 'unclear_text' FROM {SEGMENTS_SQL} WHERE contains(source_text, '{T.UNCLEAR}') OR contains(source_text, '{checks.UNREADABLE}')
    UNION ALL SELECT doc_id, id, 'pause_out_of_range' FROM {SEGMENTS_SQL} WHERE coalesce(pause_after_ms, 0) NOT BETWEEN 0 AND 30000
    UNION ALL SELECT doc_id, id, 'duplicate_id' FROM {SEGMENTS_SQL} GROUP BY 1, 2 HAVING count(*) > 1""")
def segment_validation(spark: SparkSession, d: str) -> DataFrame:
    return checks.segment_faults(segments(spark, d, "doc_id", "id", "source_text", "pause_after_ms"), "doc_id")


@query(f"""SELECT sha256(concat_ws(':', segment_key::VARCHAR, code, t))[1:16] AS finding_id, segment_key AS id, code, CASE WHEN code = 'unresolved_ocr' THEN 'blocker' ELSE 'review' END AS severity FROM (
    SELECT segment_key, source_text AS t, 'known_ocr_anomaly' AS code FROM {SEGMENTS_SQL} WHERE list_contains(regexp_extract_all(source_text, '[ऀ-ॿ]+'), 'साधिपए')
    UNION ALL SELECT segment_key, source_text, 'unresolved_ocr' FROM {SEGMENTS_SQL} WHERE contains(source_text, '[???????]')
    UNION ALL SELECT segment_key, source_text, 'mixed_script_token' FROM {SEGMENTS_SQL} WHERE regexp_matches(source_text, '[ऀ-ॿ]{{2,}}[A-Za-z]{{2,}}|[A-Za-z]{{2,}}[ऀ-ॿ]{{2,}}'))""")
def text_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return checks.text_anomalies(segments(spark, d, "segment_key", "source_text").withColumnRenamed("segment_key", "id"))


def _spoken_pairs(spark: SparkSession, d: str) -> DataFrame:
    spoken = load(spark, d, "offsets").where("source_text is not null").groupBy("doc_id", F.col("chunk_id").alias("id")).agg(F.max("source_text").alias("heard"))
    return segments(spark, d, "doc_id", "id", "source_text").join(spoken, ["doc_id", "id"])


@query()
def transcript_errors(spark: SparkSession, d: str) -> DataFrame:
    """Word and character error rates of what was spoken against the segments."""
    e = matching.error_rates(F.col("source_text"), F.col("heard"))
    return _spoken_pairs(spark, d).select("doc_id", "id", e.alias("e")).select("doc_id", "id", "e.wer", "e.cer")


@query()
def transcript_diff(spark: SparkSession, d: str) -> DataFrame:
    """Words left out and put in; texts that are the same never reach Python."""
    pairs = _spoken_pairs(spark, d).where("source_text <> heard")
    diff = matching.token_difference(T.tokens(F.col("source_text")), T.tokens(F.col("heard")))
    return pairs.select("doc_id", "id", diff.alias("x")).select("doc_id", "id", "x.omissions", "x.additions", "x.coverage")


@query()
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """For each note the sentences of its book that sound like it."""
    notes = feedback(spark, d).where("reviewer_text is not null").select("doc_id", F.col("issue_id").alias("note_id"), F.col("reviewer_text").alias("note"))
    texts = passages(spark, d).select("doc_id", F.col("id").alias("passage_id"), "text")
    return phrases.phrase_matches(notes, texts, ["doc_id"])


@query(f"""SELECT 'page xii' AS query, doc_id, id FROM {PASSAGES_SQL} WHERE lower(page) = 'xii' UNION ALL SELECT 'g00-0000399', doc_id, id FROM {PASSAGES_SQL} WHERE id = 'g00-0000399' OR contains(text, 'g00-0000399')
    UNION ALL SELECT 'जीवन', doc_id, id FROM {PASSAGES_SQL} WHERE id = 'जीवन' OR contains(text, 'जीवन')""")
def search_dispatch(spark: SparkSession, d: str) -> DataFrame:
    p = passages(spark, d)
    got = [matching.search(p, x).select(F.lit(x).alias("query"), "doc_id", "id") for x in ("page xii", "g00-0000399", "जीवन")]
    return got[0].unionByName(got[1]).unionByName(got[2])


_FIELD_SQL = " || ".join(
    f"'{f}: ' || coalesce({'array_to_string(parents, chr(32))' if f == 'PARENTS' else c + '::VARCHAR'}, '{default}') || chr(10)" for f, (c, default) in manuscript.FIELDS.items()
)


@query(f"""SELECT doc_id, md5(string_agg('=== Passage ' || id || ' ===' || chr(10) || {_FIELD_SQL} || chr(10) || 'TEXT:' || chr(10) || text || chr(10) || chr(10) || mode || ':' || chr(10) || coalesce(speech, '(inherit)') || chr(10), chr(10) ORDER BY id)) AS manuscript
    FROM {PASSAGES_SQL} GROUP BY doc_id""")
def manuscript_render(spark: SparkSession, d: str) -> DataFrame:
    return manuscript.render_manuscripts(passages(spark, d), "doc_id", "id").select("doc_id", F.md5("text").alias("manuscript"))


@query(f"""SELECT doc_id, id, coalesce(page, '?') AS page, CAST(pause AS INTEGER) AS pause, CAST(take AS INTEGER) AS take, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text, CAST(NULL AS VARCHAR) AS fault FROM {PASSAGES_SQL}""")
def manuscript_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every book rendered and read again: the rows come back as they were."""
    books = manuscript.render_manuscripts(passages(spark, d), "doc_id", "id")
    return manuscript.parse_manuscripts(books, "doc_id", "text").select("doc_id", "id", "page", "pause", "take", F.md5("text").alias("text"), "fault")


@query(f"""SELECT id, knob FROM (SELECT id, unnest([CASE WHEN pitch <> '+0Hz' THEN 'pitch' END, CASE WHEN volume <> '+0%' THEN 'volume' END]) AS knob FROM {PASSAGES_SQL}) WHERE knob IS NOT NULL""")
def unsupported_knobs(spark: SparkSession, d: str) -> DataFrame:
    return manuscript.unsupported_knobs(passages(spark, d), F.lit("google"))


@query()
def markup_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the markup of spoken overrides."""
    rows = passages(spark, d).where("speech is not null")
    return rows.select("doc_id", "id", manuscript.markup_fault(F.col("speech")).alias("fault"))


@query(f"""SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS book FROM (SELECT doc_id, page, '<metadata_page>' || page || '</metadata_page>' || chr(10) || string_agg(source_text, chr(10) ORDER BY seq) AS t
    FROM {SEGMENTS_SQL} WHERE page IS NOT NULL GROUP BY 1, 2) WHERE regexp_matches(t, '\\S') GROUP BY doc_id""")
def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d, "doc_id", "page", "seq", "source_text").where("page is not null")
    listed = F.array_sort(F.collect_list(F.struct("seq", "source_text")))
    pages = s.groupBy("doc_id", "page").agg(F.array_join(F.transform(listed, lambda x: x["source_text"]), "\n").alias("text"))
    return artifacts.join_pages(pages, "doc_id").select("doc_id", F.md5("text").alias("book"))


@query(f"""SELECT doc_id, count(*) AS n_pages, md5(array_to_string(list_sort(list(DISTINCT page)), ',')) AS pages FROM (SELECT DISTINCT doc_id, page FROM {SEGMENTS_SQL} WHERE page IS NOT NULL) GROUP BY doc_id""")
def read_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = segments(spark, d, "doc_id", "page").where("page is not null").distinct()
    return artifacts.checkpoint_manifest(pages, "doc_id").select("doc_id", "n_pages", F.md5(F.array_join("pages", ",")).alias("pages"))


@query(f"""SELECT p.id, coalesce(h.heading, p.display_name, p.name) AS title, CAST(nullif(regexp_extract(p.book_identifier, '((?:19|20)\\d{{2}})', 1), '') AS INTEGER) AS year,
    regexp_replace(p.name, '[^A-Za-z0-9_]', '', 'g') AS stem, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(p.name, '[^\\x00-\\x7f]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:48], '-+$', '') AS slug
    FROM projects p LEFT JOIN (SELECT doc_id, arg_min(source_text, seq) AS heading FROM {SEGMENTS_SQL} WHERE segment_type = 'heading' GROUP BY 1) h ON h.doc_id = p.id""")
def book_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A book's title from its first heading, else its names; year and file names from its identifiers."""
    heads = segments(spark, d, "doc_id", "seq", "segment_type", "source_text").where("segment_type = 'heading'").groupBy("doc_id").agg(F.min_by("source_text", "seq").alias("heading"))
    p = load(spark, d, "projects").join(heads, F.col("id") == F.col("doc_id"), "left")
    title = F.coalesce("heading", "display_name", "name")
    return p.select("id", title.alias("title"), T.year_in(F.col("book_identifier")).alias("year"), T.file_stem(F.col("name")).alias("stem"), T.slug(F.col("name")).alias("slug"))


@query(f"""SELECT rate, CASE WHEN regexp_matches(rate, '^[+-]?\\d+%$') THEN least(2.0::DOUBLE, greatest(0.25::DOUBLE, 1 + CAST(regexp_extract(rate, '^([+-]?\\d+)%$', 1) AS DOUBLE) / 100)) ELSE 1.0::DOUBLE END AS speaking_rate, count(*) AS n FROM {PASSAGES_SQL} GROUP BY rate""")
def speaking_rates(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).groupBy("rate").agg(F.count("*").alias("n")).withColumn("speaking_rate", T.speaking_rate(F.col("rate")))


@query(f"""SELECT doc_id, id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s+([।॥,])', '\\1', 'g'), ',\\s*(और|तथा|एवं|या)\\s+', ' \\1 ', 'g'), '\\s+', ' ', 'g'), '^ ', ''), ' $', ''))) AS spoken FROM {PASSAGES_SQL}""")
def spoken_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d).select("doc_id", "id", F.md5(T.comma_before_conjunctions(F.col("text"))).alias("spoken"))


@query("""WITH v AS (SELECT DISTINCT unnest(['C:\\books\\' || name, '/mnt/' || name, 'd:/' || name || '/x']) AS path FROM projects) SELECT path, CASE WHEN regexp_matches(path, '^[A-Za-z]:[\\\\/]') THEN '/mnt/' || lower(path[1]) || '/' || replace(path[4:], '\\', '/') ELSE path END AS local FROM v""")
def local_paths(spark: SparkSession, d: str) -> DataFrame:
    names = [F.concat(F.lit("C:\\books\\"), "name"), F.concat(F.lit("/mnt/"), "name"), F.concat(F.lit("d:/"), "name", F.lit("/x"))]
    rows = load(spark, d, "projects").select(F.explode(F.array(*names)).alias("path")).distinct()
    return rows.select("path", T.windows_path(F.col("path")).alias("local"))


@query(f"""SELECT doc_id, id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g') = regexp_replace(replace(replace(replace(replace(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS kept FROM {PASSAGES_SQL}""")
def escaped_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages as they are put into markup, and whether that keeps every letter."""
    e: Column = T.escape_markup(F.col("text"))
    return passages(spark, d).select("doc_id", "id", F.md5(e).alias("escaped"), T.same_letters(F.col("text"), e).alias("kept"))


@query(f"""SELECT doc_id, md5(string_agg('<prosody rate="' || rate || '" pitch="' || pitch || '" volume="' || volume || '">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '<break time="450ms"/>')
    || '</prosody><break time="' || pause || 'ms"/>', chr(10) ORDER BY id)) AS markup FROM {PASSAGES_SQL} GROUP BY doc_id""")
def rendered_markup(spark: SparkSession, d: str) -> DataFrame:
    """Each book as speech markup: pace around the text, breaks between lines and after passages."""
    return manuscript.render_markup(passages(spark, d), "doc_id", "id").select("doc_id", F.md5("markup").alias("markup"))


@query()
def pronunciation_audits(spark: SparkSession, d: str) -> DataFrame:
    """What the lexicon changed in each passage that it changed, as a row of its audit."""
    rows = passages(spark, d).select("doc_id", "id", "text", lex.pronounce(F.col("text")).alias("spoken"))
    return rows.where("text <> spoken").select("doc_id", "id", F.lit("phonetics").alias("stage"), F.lit("lexicon").alias("kind"), F.md5("text").alias("source"), F.md5("spoken").alias("replacement"))
