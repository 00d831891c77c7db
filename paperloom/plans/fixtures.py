"""Views of the driver's tables in the engine's shapes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..schemas import ENTITY_TYPES

#: Ids of documents of which a source's are one paper.
PAPER_IDS = 1000
SECTIONS = ("introduction", "abstract", "methods", "results", "discussion", "conclusion", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k + 1).cast("int"))


def paper(i: Column) -> Column:
    """A source's documents of a thousand ids are a paper, so that papers do not grow with the table."""
    return F.concat_ws("/", "source", F.floor(i / PAPER_IDS).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities, their whole texts."""
    i = F.col("doc_id")
    block = F.floor(i / 20)
    kind = pick(ENTITY_TYPES, block % 8)
    return table(spark, sf_dir, "documents").select(
        paper(i).alias("paper_id"), "doc_id", kind.alias("type"), pick(SECTIONS, (i + block) % 7).alias("source_section"),
        (F.lit(0.7) + ((i * 17) % 31).cast("double") / F.lit(100.0)).alias("confidence"),
        F.concat(kind, F.lit("_"), F.substring(F.md5(i.cast("string")), 1, 8)).alias("id"), "text",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as segments of five papers."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select((v % 5).cast("string").alias("paper_id"), v.alias("seg_id"), pick(SECTIONS, v % 7).alias("section"), F.col("embedding").cast("array<double>").alias("embedding"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a keyword of every one of the five papers."""
    v = F.col("vec_id")
    n = F.floor(v / 50)
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(
        F.explode(F.array(*(F.lit(str(k)) for k in range(5)))).alias("paper_id"), pick(ENTITY_TYPES, n % 8).alias("entity_type"), F.floor(n / 8).cast("int").alias("kw_idx"),
        v.alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The driver's times have no zone: read them as UTC whatever the session's.
    ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", ts.alias("ts"), (F.col("value") / F.lit(10000.0)).alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("entities")
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers of one section."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.lit("results").alias("section"), F.lit(0).alias("section_ord"), "text")


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as divisions of their paper, with headings that exercise the look-ahead; an empty major division stands before every third."""
    heads = ("Introduction", "Methods", "Image analysis", "Results", "A finding", "Discussion", "Conclusions", None, "Background")
    majors = ("Results", "Methods", "Discussion")
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(paper(i).alias("paper_id"), "doc_id", "text")
    own = docs.select("paper_id", (i * 2 + 1).alias("div_pos"), pick(heads, F.floor(i / 20) % 9).alias("head"), F.col("text").alias("body"))
    return own.unionByName(docs.where("doc_id % 3 = 0").select("paper_id", (i * 2).alias("div_pos"), pick(majors, F.floor(i / 3) % 3).alias("head"), F.lit("").alias("body")))


def documents_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, xml): documents as structured XML, each line of the text a division."""
    i = F.col("doc_id")
    safe = lambda c: escape_xml(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]", ""))  # noqa: E731  what XML cannot hold
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    divs = F.transform(lines, lambda x, k: F.concat(F.lit("<div>"), F.when(k % 2 == 0, F.concat(F.lit("<head>Part "), k.cast("string"), F.lit("</head>"))).otherwise(F.lit("")), F.lit("<p>"), safe(x), F.lit("</p></div>")))
    number = i.cast("string")
    author = lambda first, last: F.concat(F.lit("<author><persName><forename>"), first, F.lit("</forename><surname>"), last, F.lit("</surname></persName><affiliation>Institute "), last, F.lit("</affiliation></author>"))
    ref = lambda k: F.concat(F.lit(f'<biblStruct coords="{k + 1},1,1,1,1"><analytic><title>Work '), number, F.lit(f'.{k}</title><author><persName><surname>Cited</surname></persName></author></analytic><monogr><imprint><date when="20{10 + k}"/></imprint></monogr><idno type="DOI">10.1/'), number, F.lit(f".{k}</idno></biblStruct>"))
    refs = F.concat(*(F.when(i % 4 > k, ref(k)).otherwise(F.lit("")) for k in range(3)))
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Paper '), number, F.lit("</title></titleStmt><publicationStmt><date when=\"2024-01-0"), (i % 9 + 1).cast("string"),
        F.lit('"/></publicationStmt><sourceDesc><biblStruct><analytic>'), author(F.lit("Ada"), F.col("source")), author(F.lit("Max"), F.col("lang")), F.lit('</analytic><idno type="DOI">10.9/'), number,
        F.lit("</idno></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>"), safe(F.element_at(lines, 1)), F.lit("</p></abstract><textClass><keywords><term>"), F.col("lang"),
        F.lit("</term></keywords></textClass></profileDesc></teiHeader><text><body>"), F.array_join(divs, ""), F.lit("</body><back><listBibl>"), refs, F.lit("</listBibl></back></text></TEI>"),
    )
    return table(spark, sf_dir, "documents").select(number.alias("paper_id"), xml.alias("xml"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with confidences that fall on both sides of the thresholds."""
    return entities(spark, sf_dir).withColumn("confidence", F.lit(0.5) + ((F.col("doc_id") * 13) % 47).cast("double") / F.lit(100.0))


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


PAPER_SQL = f"source || '/' || (doc_id // {PAPER_IDS})"

ENTITY_SQL = f"""fx AS (
  SELECT {PAPER_SQL} AS paper_id, doc_id, {_list(ENTITY_TYPES)}[CAST((doc_id // 20) % 8 AS INT) + 1] AS type,
    {_list(SECTIONS)}[CAST((doc_id + doc_id // 20) % 7 AS INT) + 1] AS source_section,
    0.7::DOUBLE + ((doc_id * 17) % 31)::DOUBLE / 100::DOUBLE AS confidence,
    {_list(ENTITY_TYPES)}[CAST((doc_id // 20) % 8 AS INT) + 1] || '_' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS id,
    text
  FROM documents)"""

SEGMENT_SQL = f"""seg AS (
  SELECT CAST(vec_id % 5 AS VARCHAR) AS paper_id, vec_id AS seg_id, {_list(SECTIONS)}[CAST(vec_id % 7 AS INT) + 1] AS section, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)"""

KEYWORD_SQL = f"""kw AS (
  SELECT CAST(p AS VARCHAR) AS paper_id, {_list(ENTITY_TYPES)}[CAST(vec_id // 50 % 8 AS INT) + 1] AS entity_type, CAST(vec_id // 400 AS INT) AS kw_idx, vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q
  FROM embeddings, range(5) t(p) WHERE vec_id % 50 = 0)"""

REQUEST_SQL = """req AS (
  SELECT event_id, user_id, ts, value / 10000::DOUBLE AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS entities FROM events)"""
