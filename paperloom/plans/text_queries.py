"""Registered queries over texts, sections, pages and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean, escape_xml, format_size, safe_name, section_of, word_count
from ..operators import keywords as kw
from ..operators import sections as sec
from ..operators import sentences as sen
from ..operators import validate as va
from ..operators.embed import HashingEmbedder, embed_texts, embedding_metrics
from ..operators.metrics import MESSAGES, OTHER_MESSAGE, describe, error_message, run_metrics
from ..operators.models import call_cost
from ..schemas import ENTITY_TYPES, HEADINGS, MAJOR_HEADINGS
from ..sources import pages as pg
from ..sources import tei
from . import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


WORDS = "len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda w: w <> ''))"
PIECES = "regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]*')"
SENTENCES_SQL = f"""p AS (SELECT doc_id, unnest({PIECES}) AS piece, generate_subscripts({PIECES}, 1) - 1 AS position, length(regexp_extract(text, '^[.!?]*')) AS lead FROM documents),
s AS (SELECT doc_id, position, trim(piece) AS text, lead + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY position) - length(piece) AS char_start, lead + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY position) AS char_end FROM p),
k AS (SELECT * FROM s WHERE length(text) >= 10 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]'))"""


@query("sentence_split", f"WITH {SENTENCES_SQL} SELECT doc_id, count(*) AS pieces, sum(length(piece))::BIGINT AS chars FROM p GROUP BY 1")
def sentence_split(spark, sf_dir):
    found = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(sen.pieces(F.coalesce("text", F.lit("")))).alias("piece"))
    return found.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("chars"))


@query("sentence_filter", f"WITH {SENTENCES_SQL} SELECT doc_id::VARCHAR AS paper_id, position, text, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end FROM k")
def sentence_filter(spark, sf_dir):
    return sen.split_sections(fx.sections(spark, sf_dir)).select("paper_id", "position", "text", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("segment_ids", f"WITH {SENTENCES_SQL} SELECT doc_id::VARCHAR AS paper_id, position, doc_id || '_seg_' || (row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1) AS seg_id FROM k")
def segment_ids(spark, sf_dir):
    return sen.with_segment_ids(sen.split_sections(fx.sections(spark, sf_dir))).select("paper_id", "position", "seg_id")


@query("word_count", f"SELECT doc_id, {WORDS.format('text')} AS n_words FROM documents")
def words(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).cast("long").alias("n_words"))


@query("clean_text", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean(F.col("text")), 256).alias("cleaned"))


@query("document_guard", "SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) < 100 THEN 'too short' END AS reject FROM documents")
def document_guard(spark, sf_dir):
    return tei.guard(fx.table(spark, sf_dir, "documents"), "text").select("doc_id", "reject")


@query("token_estimate", f"SELECT source, CAST(floor(sum({WORDS.format('text')}) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def tokens(spark, sf_dir):
    from ..operators.embed import token_estimate

    return fx.table(spark, sf_dir, "documents").groupBy("source").agg(token_estimate(F.col("text")).alias("tokens"))


@query(
    "call_cost",
    f"""WITH t AS (SELECT conv_id, role, {WORDS.format('text')} AS n FROM conversations),
    s AS (SELECT conv_id, sum(n) FILTER (WHERE role <> 'assistant') AS i, sum(n) FILTER (WHERE role = 'assistant') AS o FROM t GROUP BY 1)
    SELECT conv_id, round(coalesce(i, 0)::DOUBLE / 1e6 * 0.15::DOUBLE + coalesce(o, 0)::DOUBLE / 1e6 * 0.6::DOUBLE, 12) AS cost FROM s""",
)
def conversation_cost(spark, sf_dir):
    n = fx.table(spark, sf_dir, "conversations").select("conv_id", "role", word_count(F.col("text")).alias("n"))
    s = n.groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", F.col("n"))).alias("i"), F.sum(F.when(F.col("role") == "assistant", F.col("n"))).alias("o"))
    cost = call_cost(F.coalesce("i", F.lit(0)).cast("double"), F.coalesce("o", F.lit(0)).cast("double"))
    return s.select("conv_id", F.round(cost, 12).alias("cost"))


@query("dedup_embed_join", "SELECT count(*) AS texts, count(DISTINCT text) AS distinct_texts, count(*) AS embedded FROM documents WHERE text IS NOT NULL")
def dedup_embed_join(spark, sf_dir):
    made = embed_texts(fx.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), HashingEmbedder(16))
    return made.agg(F.count("*").alias("texts"), F.countDistinct("text").alias("distinct_texts"), F.count("embedding").alias("embedded"))


@query(
    "embedding_metrics",
    f"SELECT count(text) AS texts, count(DISTINCT text) AS distinct_texts, CAST(floor(sum({WORDS.format('text')}) * 1.3::DOUBLE) AS BIGINT) AS tokens, CAST(ceil(count(DISTINCT text) / 32::DOUBLE) AS BIGINT) AS batches FROM documents",
)
def embed_metrics(spark, sf_dir):
    return embedding_metrics(fx.table(spark, sf_dir, "documents"))


HEADING_CASE = "CASE lower(trim(head)) " + " ".join(f"WHEN '{n}' THEN '{s}'" for s, names in HEADINGS.items() for n in names) + " END"
MAJORS = ", ".join(f"'{m}'" for m in MAJOR_HEADINGS)
DIVS_SQL = f"""d AS (SELECT {fx.PAPER_SQL} AS paper_id, doc_id * 2 + 1 AS div_pos, ['Introduction', 'Methods', 'Image analysis', 'Results', 'A finding', 'Discussion', 'Conclusions', NULL, 'Background'][CAST((doc_id // 20) % 9 AS INT) + 1] AS head, text AS body FROM documents
  UNION ALL SELECT {fx.PAPER_SQL}, doc_id * 2, ['Results', 'Methods', 'Discussion'][CAST((doc_id // 3) % 3 AS INT) + 1], '' FROM documents WHERE doc_id % 3 = 0)"""


@query("heading_lookup", f"WITH {DIVS_SQL} SELECT DISTINCT head, {HEADING_CASE} AS section FROM d")
def heading_lookup(spark, sf_dir):
    return fx.divisions(spark, sf_dir).select("head", section_of(F.col("head")).alias("section")).distinct()


@query(
    "section_assembly",
    f"""WITH {DIVS_SQL}, h AS (SELECT paper_id, div_pos, lower(trim(head)) AS head, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') AS body, {HEADING_CASE} AS mapped FROM d WHERE head IS NOT NULL),
    m AS (SELECT *, head IN ({MAJORS}) AS major, max(CASE WHEN head IN ({MAJORS}) THEN div_pos END) OVER (PARTITION BY paper_id ORDER BY div_pos) AS owner FROM h),
    o AS (SELECT m.*, w.mapped AS o_section, w.body = '' AS o_empty FROM m LEFT JOIN m w ON w.paper_id = m.paper_id AND w.div_pos = m.owner),
    t AS (SELECT paper_id, div_pos, body, CASE WHEN NOT major AND coalesce(o_empty, false) THEN o_section ELSE mapped END AS section, CASE WHEN NOT major AND coalesce(o_empty, false) THEN owner ELSE div_pos END AS opened FROM o)
    SELECT paper_id, section, CAST(min(opened) AS INT) AS section_ord, string_agg(body, chr(10) || chr(10) ORDER BY div_pos) AS text FROM t WHERE section IS NOT NULL AND body <> '' GROUP BY ALL""",
)
def section_assembly(spark, sf_dir):
    return sec.assemble_sections(fx.divisions(spark, sf_dir))


@query(
    "section_accessor",
    f"""WITH {DIVS_SQL}, h AS (SELECT paper_id, div_pos, regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') AS body, {HEADING_CASE} AS mapped, head FROM d)
    SELECT paper_id, string_agg(body, chr(10) || chr(10) ORDER BY div_pos) AS text FROM h WHERE mapped = 'introduction' AND body <> '' GROUP BY 1""",
)
def section_accessor(spark, sf_dir):
    """Introductions, of divisions among which no major one is empty, so that nothing is swallowed."""
    return sec.section(sec.assemble_sections(fx.divisions(spark, sf_dir).where("div_pos % 2 = 1")), "Introduction")


PARTS = "string_split(coalesce(text, ''), chr(10))"


@query(
    "document_scan",
    f"""SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'Paper ' || doc_id AS title, 'Ada ' || source || ';Max ' || lang AS authors, 'Institute ' || source || ';Institute ' || lang AS affiliations,
      sha256(trim({PARTS}[1])) AS abstract, lang AS keywords, '2024-01-0' || (doc_id % 9 + 1) AS publication_date, '10.9/' || doc_id AS doi, CASE WHEN doc_id % 4 > 0 THEN CAST(least(doc_id % 4, 3) AS VARCHAR) END AS page_count,
      2 * CAST(ceil(len({PARTS}) / 2) AS INT) + {WORDS.format('text')} AS word_count FROM documents""",
)
def document_scan(spark, sf_dir):
    """Metadata of documents that were written as structured XML. Headings glue to the words after them, so words are counted without."""
    parsed = tei.parse_documents(fx.documents_xml(spark, sf_dir)).where("error is null")
    joined = lambda c: F.array_join(c, ";")
    headless = F.aggregate("divs", F.lit(0), lambda n, d: n + word_count(d["head"]) + word_count(d["body"]))
    return parsed.select("paper_id", "title", joined("authors").alias("authors"), joined("affiliations").alias("affiliations"), F.sha2("abstract", 256).alias("abstract"), joined("keywords").alias("keywords"), "publication_date", "doi", F.col("page_count").cast("string").alias("page_count"), headless.cast("long").alias("word_count"))


@query(
    "document_divisions",
    f"""WITH d AS (SELECT doc_id, unnest({PARTS}) AS body, generate_subscripts({PARTS}, 1)::INT - 1 AS div_pos FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS paper_id, div_pos, CASE WHEN div_pos % 2 = 0 THEN 'Part ' || div_pos END AS head, sha256(trim(body)) AS body FROM d""",
)
def document_divisions(spark, sf_dir):
    divs = tei.divisions(tei.parse_documents(fx.documents_xml(spark, sf_dir)))
    return divs.select("paper_id", "div_pos", "head", F.sha2("body", 256).alias("body"))


@query(
    "document_references",
    """SELECT CAST(doc_id AS VARCHAR) AS paper_id, k AS ref_pos, 'Work ' || doc_id || '.' || k AS title, 'Cited' AS authors, '20' || (10 + k) AS year, '10.1/' || doc_id || '.' || k AS doi
    FROM documents, (SELECT unnest([0, 1, 2]) AS k) WHERE doc_id % 4 > k""",
)
def document_references(spark, sf_dir):
    refs = tei.references(tei.parse_documents(fx.documents_xml(spark, sf_dir)))
    return refs.select("paper_id", "ref_pos", "title", F.array_join("authors", ";").alias("authors"), "year", "doi")


@query("embedding_cost", f"SELECT source, round(floor(sum({WORDS.format('text')}) * 1.3::DOUBLE) / 1e6 * 0.02::DOUBLE, 12) AS remote, 0.0::DOUBLE AS local FROM documents GROUP BY 1")
def embed_cost(spark, sf_dir):
    from ..operators.embed import embedding_cost, token_estimate

    t = fx.table(spark, sf_dir, "documents").groupBy("source").agg(token_estimate(F.col("text")).alias("tokens"))
    return t.select("source", F.round(embedding_cost(F.col("tokens"), local=False), 12).alias("remote"), embedding_cost(F.col("tokens")).alias("local"))


@query(
    "error_messages",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '" + MESSAGES["unsupported format"] + "' WHEN page_id * 100000 > 10485760 THEN '" + MESSAGES["file too large"] + "' WHEN page_id % 5 = 0 THEN '" + MESSAGES["malformed XML"] + "' WHEN page_id % 7 = 0 THEN '" + OTHER_MESSAGE + "' END AS message FROM pages",
)
def messages(spark, sf_dir):
    i = F.col("page_id")
    name = F.when(i % 3 == 0, F.lit("a.docx")).otherwise(F.lit("a.pdf"))
    refused = tei.upload_check(name, i * 100000)["message"]
    error = F.coalesce(refused, F.when(i % 5 == 0, F.lit("malformed XML: line 1")).when(i % 7 == 0, F.lit("something else")))
    return fx.table(spark, sf_dir, "pages").select("page_id", error_message(error).alias("message"))


@query(
    "metrics_text",
    f"""WITH c AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN 'b' ELSE 'a' END AS phase, {WORDS.format('text')} AS n FROM conversations),
    t AS (SELECT conv_id, sum(n)::BIGINT AS tokens, count(*) AS rows, count(DISTINCT phase) AS phases FROM c GROUP BY 1)
    SELECT CAST(conv_id AS VARCHAR) AS paper_id, tokens, phases, printf('%d entities, %d relationships, %d tokens, $%.4f', rows, 0, tokens, tokens / 4::DOUBLE) AS text FROM t""",
)
def metrics_text(spark, sf_dir):
    """Conversations as runs of two phases: what is asked and what is answered; every turn is an entity."""
    turns = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.when(F.col("role") == "assistant", F.lit("b")).otherwise(F.lit("a")).alias("phase"), word_count(F.col("text")).alias("n"))
    calls = turns.groupBy("paper_id", "phase").agg(F.count("*").alias("calls"), F.sum("n").alias("tokens"), (F.sum("n") / 4.0).alias("cost"))
    edges = spark.createDataFrame([], "paper_id string")
    made = run_metrics(turns, edges, calls)
    return made.join(describe(made), "paper_id").select("paper_id", F.col("tokens").cast("long").alias("tokens"), F.size("phases").cast("long").alias("phases"), "text")


PLAIN = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(
    "html_headings",
    f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*')) AS h, generate_subscripts(regexp_extract_all(html, '<h[1-6][^>]*>[^<]*'), 1) - 1 AS pos FROM pages)
    SELECT page_id, pos, CAST(substr(h, 3, 1) AS INT) AS level, {PLAIN.format('h')} AS heading FROM h""",
)
def html_headings(spark, sf_dir):
    return pg.headings(fx.table(spark, sf_dir, "pages"))


@query("page_divisions", "SELECT page_id::VARCHAR AS paper_id, len(regexp_split_to_array(html, '<h[1-6]')) - 1 AS n FROM pages WHERE len(regexp_split_to_array(html, '<h[1-6]')) > 1")
def page_divisions(spark, sf_dir):
    return pg.divisions(fx.table(spark, sf_dir, "pages")).groupBy("paper_id").agg(F.count("*").alias("n"))


@query("xml_escape", """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped FROM pages""")
def xml_escape(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.sha2(escape_xml(F.col("html")), 256).alias("escaped"))


HALF_UP = "floor({0} * 10 + 0.5) / 10"


@query(
    "format_size",
    f"""SELECT doc_id, CASE WHEN n_chars * 97 < 1024 THEN printf('%d B', n_chars * 97) WHEN n_chars * 97 < 1048576 THEN printf('%.1f KB', {HALF_UP.format("(n_chars * 97 / 1024::DOUBLE)")})
    ELSE printf('%.1f MB', {HALF_UP.format("(n_chars * 97 / 1048576::DOUBLE)")}) END AS size FROM documents""",
)
def sizes(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", format_size(F.col("n_chars") * 97).alias("size"))


@query("safe_names", "SELECT page_id, substr(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 100) AS name FROM pages")
def names(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


@query("upload_guard", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'unsupported format' WHEN page_id * 100000 > 10485760 THEN 'file too large' END AS message FROM pages")
def upload_guard(spark, sf_dir):
    name = F.when(F.col("page_id") % 3 == 0, F.lit("a.docx")).otherwise(F.lit("a.PDF"))
    return fx.table(spark, sf_dir, "pages").select("page_id", tei.upload_check(name, F.col("page_id") * 100000)["message"].alias("message"))


@query(
    "keyword_prompts",
    f"""WITH p AS (SELECT substr(array_to_string(list_slice(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> ''), 1, 500), ' '), 1, 500) AS intro FROM documents)
    SELECT count(*) * {len(ENTITY_TYPES)} AS n, count(DISTINCT intro) * {len(ENTITY_TYPES)} AS prompts FROM p""",
)
def keyword_prompts(spark, sf_dir):
    papers = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("A title").alias("title"), F.lit("").alias("abstract"), F.col("text").alias("introduction"))
    return kw.prompts(papers).agg(F.count("*").alias("n"), F.countDistinct("prompt_key").alias("prompts"))


@query(
    "parse_keywords",
    """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN CASE WHEN trim(text) <> '' AND len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) <= 5 THEN trim(text) || '|' ELSE '' END || 'x'
      WHEN 3 THEN 'one two|one two' WHEN 4 THEN 'in' ELSE '' END AS keywords FROM documents""",
)
def parse_keywords(spark, sf_dir):
    made = F.to_json(F.array("text"))
    k = F.col("doc_id") % 5
    answer = (
        F.when(k == 0, F.lit("no array"))
        .when(k == 1, F.concat(F.regexp_replace(made, r"\]$", ""), F.lit(', " x ", 3, "", "a b c d e f"]')))
        .when(k == 2, F.lit('["broken'))
        .when(k == 3, F.lit('Sure: ["one two", "one two"] ok'))
        .otherwise(F.lit('{"a": ["in"]}'))
    )
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", answer.alias("content"))
    return kw.parse_keywords(docs).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


@query(
    "parse_validation",
    """SELECT CAST(doc_id AS VARCHAR) AS paper_id, p.pos, CAST(p.pos + 1 AS INT) AS fragment_id, 0.9::DOUBLE AS confidence, CASE WHEN p.pos = 0 THEN 'core' END AS core_text
    FROM documents, range(3) p(pos) WHERE doc_id % 4 <> 3 AND (p.pos = 0 OR (p.pos = 2 AND doc_id % 4 = 0))""",
)
def parse_validation(spark, sf_dir):
    k = F.col("doc_id") % 4
    middle = F.when(k == 0, F.lit('{"fragment_id": 2, "is_valid": false, "confidence": "x"}')).when(k == 1, F.lit('{"fragment_id": 2, "is_valid": true, "confidence": 1.2}')).otherwise(F.lit('"text"'))
    answer = F.concat(F.lit('Here: [{"fragment_id": 1, "is_valid": "false", "confidence": 0.9, "core_text": "core"}, '), middle, F.lit(', {"fragment_id": 3, "is_valid": 1, "confidence": 0.9}]'), F.when(k == 3, F.lit("]")).otherwise(F.lit("")))
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("fact").alias("entity_type"), F.lit(0).alias("batch_id"), F.lit(5).alias("n"), answer.alias("content"))
    return va.parse_validation(docs).select("paper_id", F.col("pos").cast("long").alias("pos"), "fragment_id", "confidence", "core_text")
