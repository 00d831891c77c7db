"""Graph queries over vertices (entities) and edges (relationships)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from ..schemas import ENTITY_TYPES


@dataclass(frozen=True)
class KnowledgeGraph:
    """vertices: paper_id, id, type, text, confidence, source_section; edges as operators.link makes them."""

    vertices: DataFrame
    edges: DataFrame

    def entity(self, entity_id: str) -> DataFrame:
        """The entity with this id, at most one row."""
        return self.vertices.where(F.col("id") == entity_id).limit(1)

    def entities_by_type(self, entity_type: str) -> DataFrame:
        return self.vertices.where(F.col("type") == entity_type)

    def incident(self, entity_id: str, direction: str = "both") -> DataFrame:
        """Edges into, out of, or (for any other direction) at an entity."""
        into, out = F.col("target_id") == entity_id, F.col("source_id") == entity_id
        return self.edges.where({"in": into, "out": out}.get(direction, into | out))

    def neighbors(self, entity_id: str) -> DataFrame:
        """Distinct ids one edge away; a self-loop yields the entity itself."""
        out = self.edges.where(F.col("source_id") == entity_id).select(F.col("target_id").alias("id"))
        into = self.edges.where(F.col("target_id") == entity_id).select(F.col("source_id").alias("id"))
        return out.union(into).distinct()

    def all_neighbors(self) -> DataFrame:
        """(id, neighbor) for every entity: the bulk form of neighbors."""
        out = self.edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"))
        return out.union(self.edges.select("target_id", "source_id")).distinct()

    def totals(self) -> DataFrame:
        edges = self.edges.agg(F.count("*")).scalar()
        return self.vertices.agg(F.count("*").alias("total_entities")).select("total_entities", edges.alias("total_relationships"))

    def statistics(self) -> DataFrame:
        """(paper_id, level, name, n): totals and counts by type for each paper, the two tables grouped once."""
        v = self.vertices.groupingSets([["paper_id"], ["paper_id", "type"]], "paper_id", "type").agg(F.count("*").alias("n"), F.grouping("type").alias("g"))
        e = self.edges.groupingSets([["paper_id"], ["paper_id", "relationship_type"]], "paper_id", "relationship_type").agg(F.count("*").alias("n"), F.grouping("relationship_type").alias("g"))
        label = lambda what: F.when(F.col("g") == 1, F.lit(f"total_{what}")).otherwise(F.lit(f"{what}_by_type"))
        return v.select("paper_id", label("entities").alias("level"), F.col("type").alias("name"), "n").unionByName(
            e.select("paper_id", label("relationships").alias("level"), F.col("relationship_type").alias("name"), "n")
        )

    def average_degree(self) -> DataFrame:
        """(paper_id, avg_degree): edges for each vertex, 0 without edges."""
        v = self.vertices.groupBy("paper_id").agg(F.count("*").alias("v"))
        e = self.edges.groupBy("paper_id").agg(F.count("*").alias("e"))
        return v.join(e, "paper_id", "left").select("paper_id", F.coalesce(F.try_divide(F.col("e").cast("double"), F.col("v")), F.lit(0.0)).alias("avg_degree"))

    def type_summary(self) -> DataFrame:
        """(type, type_ord, n) of the types that occur, in the order of the vocabulary."""
        order = F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), F.col("type"))
        return self.vertices.groupBy("type").agg(F.count("*").alias("n")).select("type", (order - 1).cast("int").alias("type_ord"), "n")

    def top_per_type(self, n: int = 3, chars: int = 60) -> DataFrame:
        """The n most confident entities of each paper and type, with a preview of their text."""
        best = Window.partitionBy("paper_id", "type").orderBy(F.desc("confidence"), "id")
        return self.vertices.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("paper_id", "type", "rank", "id", "confidence", preview(F.col("text"), chars).alias("preview"))

    def edge_endpoints(self, n: int = 5, chars: int = 40) -> DataFrame:
        """The first n edges of the graph with both endpoints' texts; an edge without an endpoint is dropped after the limit."""
        some = F.broadcast(self.edges.orderBy("paper_id", "rule_id", "source_id", "target_id").limit(n))  # n rows
        v = self.vertices.select("paper_id", "id", preview(F.col("text"), chars).alias("text"))
        source = v.select("paper_id", F.col("id").alias("source_id"), F.col("text").alias("source_text"))
        target = v.select("paper_id", F.col("id").alias("target_id"), F.col("text").alias("target_text"))
        joined = source.join(some, ["paper_id", "source_id"])
        return target.join(F.broadcast(joined), ["paper_id", "target_id"]).select("paper_id", "source_id", "target_id", "relationship_type", "source_text", "target_text")

    def simple_edges(self) -> DataFrame:
        """One edge for each ordered pair, the last rule's: what a directed graph without parallel edges keeps."""
        last = F.struct("rule_id", "relationship_type", "confidence")
        return self.edges.groupBy("paper_id", "source_id", "target_id").agg(F.max(last).alias("e")).select("paper_id", "source_id", "target_id", "e.relationship_type", "e.confidence")

    def cytoscape(self, chars: int = 50) -> DataFrame:
        """(paper_id, json): one element for each node and edge."""
        nodes = self.vertices.select("paper_id", F.to_json(F.struct(F.struct("id", F.substring("text", 1, chars).alias("label"), "type", "confidence").alias("data"))).alias("json"))
        edges = self.edges.select("paper_id", F.to_json(F.struct(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relationship_type").alias("label"), "confidence").alias("data"))).alias("json"))
        return nodes.unionByName(edges)

    def results(self) -> DataFrame:
        """One row for each paper: its entities by type and its relationships, ready for export."""
        entity = F.struct("id", "text", "confidence", "source_section")
        by_type = self.vertices.groupBy("paper_id", "type").agg(F.sort_array(F.collect_list(entity)).alias("es"))
        entities = by_type.groupBy("paper_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "es")))).alias("entities"))
        edge = F.struct("rule_id", "source_id", "target_id", "relationship_type", "confidence")
        edges = self.edges.groupBy("paper_id").agg(F.sort_array(F.collect_list(edge)).alias("relationships"))
        return entities.join(edges, "paper_id", "left")
