"""Results and graphs as JSON: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..operators.graph import KnowledgeGraph

ENTITY = "struct<id:string,type:string,text:string,confidence:double,source_section:string>"
EDGE = "struct<source_id:string,target_id:string,relationship_type:string,type:string,confidence:double>"


def parse_results(rows: DataFrame, json_col: str = "json") -> KnowledgeGraph:
    """A graph from one JSON document a row: entities as a list or by type, relationships as a list.

    A missing type is fact, a missing confidence is 1, and a relationship's type may be called either name.
    """
    doc = F.try_parse_json(json_col)
    base = rows.select(F.try_variant_get(doc, "$.paper_id", "string").alias("paper_id"), doc.alias("d"))
    flat = F.try_variant_get("d", "$.entities", f"array<{ENTITY}>")
    by_type = F.try_variant_get("d", "$.entities", f"map<string,array<{ENTITY}>>")
    listed = base.select("paper_id", F.inline(flat))
    mapped = base.select("paper_id", F.explode(by_type).alias("_type", "es")).select("paper_id", "_type", F.inline("es"))
    mapped = mapped.withColumn("type", F.coalesce("type", "_type")).drop("_type")
    vertices = listed.unionByName(mapped).withColumns({"type": F.coalesce("type", F.lit("fact")), "confidence": F.coalesce("confidence", F.lit(1.0))})
    edges = base.select("paper_id", F.inline(F.try_variant_get("d", "$.relationships", f"array<{EDGE}>")))
    edges = edges.withColumn("relationship_type", F.coalesce("relationship_type", "type", F.lit("related_to"))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).drop("type")
    return KnowledgeGraph(vertices, edges)


def read_results(spark: SparkSession, path: str) -> KnowledgeGraph:
    """The graphs of all JSON files below path, one document a file."""
    return parse_results(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def result_json(results: DataFrame) -> DataFrame:
    """(paper_id, json) of operators.graph results."""
    return results.select("paper_id", F.to_json(F.struct("paper_id", "entities", "relationships"), {"ignoreNullFields": "false"}).alias("json"))


def write_results(graph: KnowledgeGraph, path: str) -> None:
    """One JSON line for each paper, in a folder for each."""
    out = result_json(graph.results()).withColumn("paper", safe_name(F.col("paper_id")))
    out.select("paper", F.col("json").alias("value")).write.mode("overwrite").partitionBy("paper").text(path)


def write_svg(documents: DataFrame, path: str) -> None:
    """(paper_id, svg): one drawing for each paper, in a folder for each."""
    named = documents.select(safe_name(F.col("paper_id")).alias("paper"), F.col("svg").alias("value"))
    named.write.mode("overwrite").partitionBy("paper").text(path)
