"""Signal patterns: how many of a type's patterns a sentence matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that announce an entity of a type, matched in any case. Nothing else depends on them.
PATTERNS = {
    "fact": (r"\b(?:is|are) known to\b", r"\bhas been (?:shown|established)\b", r"\bprevious(?:ly)? (?:studies|reported)\b"),
    "hypothesis": (r"\bwe hypothesi[sz]e\b", r"\bwe propose that\b", r"\bmay (?:explain|cause|lead)\b"),
    "experiment": (r"\bwe (?:tested|performed|conducted)\b", r"\bwere (?:randomly )?assigned\b", r"\bexperiments? (?:was|were)\b"),
    "method": (r"\b(?:was|were) measured\b", r"\bby means of\b", r"\bprotocol\b"),
    "result": (r"\bwe (?:found|observed)\b", r"\bsignificant(?:ly)?\b", r"\b(?:increased|decreased) by\b"),
    "dataset": (r"\bdata ?sets?\b", r"\bsamples? (?:was|were) collected\b", r"\bn ?= ?\d+"),
    "analysis": (r"\b(?:anova|regression|t-test)\b", r"\bp ?[<=] ?0?\.\d+", r"\bstatistical(?:ly)?\b"),
    "conclusion": (r"\bwe conclude\b", r"\bin conclusion\b", r"\bthese (?:results|findings) (?:suggest|indicate)\b"),
}


def matches(text: Column, entity_type: str) -> Column:
    return sum((F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in PATTERNS[entity_type]), F.lit(0))


def signal_counts(sentences: DataFrame, text_col: str = "text") -> DataFrame:
    """sentences with signals: an array of (entity_type, n) for the types that match."""
    every = F.array(*(F.struct(F.lit(t).alias("entity_type"), matches(F.col(text_col), t).alias("n")) for t in PATTERNS))
    return sentences.withColumn("signals", F.filter(every, lambda s: s["n"] > 0))
