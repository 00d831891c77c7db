"""Metrics of runs: totals by phase, cost tiers, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a user is told about each kind of failure, by how its error begins, and about any other.
MESSAGES = {
    "unsupported format": "Only PDF files can be processed.",
    "file too large": "The file exceeds the size limit.",
    "rate limited": "The hourly limit of requests is reached; try again later.",
    "busy": "A document of yours is still being processed.",
    "empty": "The document holds no text.",
    "too short": "The document holds too little text.",
    "malformed XML": "The document could not be parsed.",
    "service": "The parsing service did not answer.",
}
OTHER_MESSAGE = "The document could not be processed."


def error_message(error: Column) -> Column:
    """The message of an error by how it begins; null for no error, a general one for an unknown error."""
    out = F.lit(OTHER_MESSAGE)
    for start, message in MESSAGES.items():
        out = F.when(error.startswith(start), F.lit(message)).otherwise(out)
    return F.when(error.isNotNull(), out)


def run_metrics(vertices: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(paper_id, entities, relationships, tokens, cost, phases) of each paper, phases nested by name."""
    v = vertices.groupBy("paper_id").agg(F.count("*").alias("entities"))
    e = edges.groupBy("paper_id").agg(F.count("*").alias("relationships"))
    phase = F.struct("phase", "calls", "tokens", "cost")
    c = calls.groupBy("paper_id").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(phase)).alias("phases"))
    joined = c.join(v, "paper_id", "full").join(e, "paper_id", "left")
    return joined.select(
        "paper_id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("relationships", F.lit(0)).alias("relationships"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("cost", F.lit(0.0)), 6).alias("cost"), "phases",
    )


def describe(metrics: DataFrame) -> DataFrame:
    """(paper_id, text): one line about each paper."""
    return metrics.select("paper_id", F.format_string("%d entities, %d relationships, %d tokens, $%.4f", "entities", "relationships", "tokens", "cost").alias("text"))
