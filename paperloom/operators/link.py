"""Linking rules: one join of the entities with themselves, driven by the rule table.

The rules are a broadcast table of eight rows. A rule's smallest possible confidence is pushed to both sides
before the join, keyword sets are made once for each entity and only for the rules that compare them, and
the join key is (paper, rule, section where the rule asks for the same one), so no pair outside a rule meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_set, overlap
from ..schemas import Settings, rule_table

#: Kept below the pushed-down bound: the product is rounded, the quotient too.
SLACK = 1e-9


def relationships(entities: DataFrame, min_confidence: float = Settings.min_relationship_confidence, rules: DataFrame | None = None) -> DataFrame:
    """All relationships of (paper_id, id, type, text, confidence, source_section), rule by rule, with duplicates kept.

    A null section equals a null section; a null section is in no list of sections; entities without a paper link
    with nothing.
    """
    rules = F.broadcast(rule_table(entities.sparkSession) if rules is None else rules)
    base = entities.select("paper_id", "id", "type", "text", "confidence", "source_section")

    def side(name: str, type_col: str, *more: str) -> DataFrame:
        joined = base.join(rules, base["type"] == rules[type_col])
        joined = joined.where(F.col("confidence") >= F.lit(min_confidence) / F.greatest("f_hi", "f_lo") - SLACK)
        tokens = F.when(F.col("hi_kind") == "overlap", keyword_set(F.col("text")))
        key = F.when(F.col("same_section"), F.coalesce(F.concat(F.lit("="), F.col("source_section")), F.lit(""))).otherwise(F.lit(""))
        return joined.select(
            "paper_id", "rule_id", key.alias("section_key"), *more, F.col("id").alias(f"{name}_id"), F.col("confidence").alias(f"{name}_confidence"),
            F.col("source_section").alias(f"{name}_section"), tokens.alias(f"{name}_tokens"),
        )

    a = side("source", "src_type", "rel_type", "rule", "f_hi", "f_lo", "hi_kind", "hi_threshold", "same_section")
    b = side("target", "dst_type", "dst_sections").where("dst_sections is null or array_contains(dst_sections, target_section)").drop("dst_sections")
    pairs = a.join(b, ["paper_id", "rule_id", "section_key"])
    return scored(pairs, min_confidence)


def scored(pairs: DataFrame, min_confidence: float) -> DataFrame:
    same = F.col("source_section").eqNullSafe(F.col("target_section"))
    pairs = pairs.withColumn("overlap", F.when(F.col("hi_kind") == "overlap", overlap(F.col("source_tokens"), F.col("target_tokens"))))
    high: Column = (F.col("hi_kind") == "always") | ((F.col("hi_kind") == "overlap") & (F.col("overlap") > F.col("hi_threshold"))) | ((F.col("hi_kind") == "section") & same)
    confidence = F.least("source_confidence", "target_confidence") * F.when(high, F.col("f_hi")).otherwise(F.col("f_lo"))
    return pairs.withColumn("confidence", confidence).where(F.col("confidence") >= min_confidence).select(
        "paper_id", "rule_id", "source_id", "target_id", F.col("rel_type").alias("relationship_type"), "confidence", "rule",
        F.when(F.col("rule_id") == 1, F.col("source_section")).alias("section"), F.col("overlap").alias("text_overlap"),
        F.when(F.col("hi_kind") == "section", same).alias("same_section"),
    )


def relationship_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"))
