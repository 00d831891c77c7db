"""python -m paperloom INPUT OUTPUT: extracts the graph of all XML documents below INPUT.

OUTPUT gets entities and relationships as Parquet, one JSON and one SVG file a paper, and metrics.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.layout import svg_documents
from .operators.metrics import describe, run_metrics
from .plans.extract import extract
from .sources import results, tei


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    graph, calls = extract(tei.read_documents(spark, given.input), folder=f"{given.output}/work")
    graph.vertices.write.mode("overwrite").parquet(f"{given.output}/entities")
    graph.edges.write.mode("overwrite").parquet(f"{given.output}/relationships")
    results.write_results(graph, f"{given.output}/json")
    results.write_svg(svg_documents(graph.vertices, graph.edges), f"{given.output}/svg")
    metrics = run_metrics(graph.vertices, graph.edges, calls)
    metrics.write.mode("overwrite").parquet(f"{given.output}/metrics")
    describe(metrics).orderBy("paper_id").show(20, truncate=False)


if __name__ == "__main__":
    main()
