"""Linking, graph queries and layout."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions.text import escape_xml, format_size, keyword_set, overlap, preview, wrap
from paperloom.operators.graph import KnowledgeGraph
from paperloom.operators.layout import column_layout, edge_geometry, svg_documents
from paperloom.operators.link import relationship_counts, relationships
from paperloom.plans import fixtures as fx

ENTITY = "paper_id string, id string, type string, text string, confidence double, source_section string"

# Edge counts of the fixture graph, by rule.
COUNTS = {
    "sf0.001": {"analysis_to_conclusion": 9, "experiment_uses_dataset": 2, "experiment_uses_technique": 2, "fact_to_hypothesis": 58, "hypothesis_to_experiment": 22, "method_to_result": 2, "result_to_analysis": 15, "result_to_conclusion": 4},
    "sf0.01": {"analysis_to_conclusion": 179, "experiment_uses_dataset": 33, "experiment_uses_technique": 34, "fact_to_hypothesis": 687, "hypothesis_to_experiment": 388, "method_to_result": 18, "result_to_analysis": 510, "result_to_conclusion": 100},
}


@pytest.mark.parametrize("sf", sorted(COUNTS))
def test_fixture_counts(spark, sf):
    edges = relationships(fx.entities(spark, f"/root/testdata/{sf}"))
    assert {r.relationship_type: r.n for r in relationship_counts(edges).collect()} == COUNTS[sf]


def link(spark, *rows):
    return {(r.source_id, r.target_id): r.confidence for r in relationships(spark.createDataFrame(list(rows), ENTITY)).collect()}


def test_null_sections_are_the_same_section(spark):
    assert link(spark, ("p", "a", "fact", "x", 0.9, None), ("p", "b", "hypothesis", "y", 0.8, None)) == {("a", "b"): 0.8 * 0.8}
    assert link(spark, ("p", "a", "fact", "x", 0.9, None), ("p", "b", "hypothesis", "y", 0.8, "results")) == {}


def test_overlap_must_exceed_its_threshold(spark):
    one = ("p", "a", "result", "alpha bravo charlie delta echoes", 1.0, "results")
    same = ("p", "b", "conclusion", "alpha zulus yankee xrays", 1.0, "discussion")  # 1 of 8
    more = ("p", "c", "conclusion", "alpha bravo yankee", 1.0, "discussion")  # 2 of 6
    exact = ("p", "d", "conclusion", "alpha", 1.0, "discussion")  # 1 of 5: not above 0.2
    assert link(spark, one, same, more, exact) == {("a", "b"): 0.75, ("a", "c"): 0.85, ("a", "d"): 0.75}


def test_rounding_at_the_bound(spark):
    got = link(spark, ("p", "a", "hypothesis", "x", 0.8, None), ("p", "b", "experiment", "y", 0.8, None))
    assert got == {("a", "b"): 0.8 * 0.75}


def test_papers_do_not_mix_and_duplicates_stay(spark):
    rows = [("p", "a", "analysis", "x", 1.0, None), ("p", "a", "analysis", "x", 1.0, None), ("q", "b", "conclusion", "y", 1.0, None), ("p", "c", "conclusion", "y", 1.0, None)]
    assert relationships(spark.createDataFrame(rows, ENTITY)).count() == 2
    assert relationships(spark.createDataFrame([], ENTITY)).count() == 0


def test_neighbors_and_incident_edges(spark):
    edges = spark.createDataFrame([("p", 1, "a", "b", "r", 1.0), ("p", 1, "c", "a", "r", 1.0), ("p", 1, "a", "a", "r", 1.0), ("p", 1, "a", "b", "r", 1.0)], "paper_id string, rule_id int, source_id string, target_id string, relationship_type string, confidence double")
    g = KnowledgeGraph(spark.createDataFrame([], ENTITY), edges)
    assert sorted(r.id for r in g.neighbors("a").collect()) == ["a", "b", "c"]
    assert [g.incident("a", d).count() for d in ("in", "out", "both", "odd")] == [2, 3, 4, 4]
    assert g.simple_edges().count() == 3


def greedy(text, width=25):
    lines, line = [], []
    for w in text.split():
        if line and sum(map(len, line)) + len(w) + len(line) > width:
            lines.append(" ".join(line))
            line = []
        line.append(w)
    return lines + ([" ".join(line)] if line else [])


def test_wrap_against_a_plain_loop(spark):
    texts = ["", "a", "x" * 40, "one two three four five six seven eight nine ten", "aaaaaaaaaaaa bbbbbbbbbbbb c", "  spaced   out  ", "é" * 25 + " b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", wrap(F.col("t")).alias("w"))
    assert all(r.w == greedy(r.t) for r in df.collect())


def test_layout_never_overlaps(spark):
    rows = column_layout(fx.entities(spark, "/root/testdata/sf0.001")).orderBy("paper_id", "x", "y").collect()
    for a, b in zip(rows, rows[1:]):
        if (a.paper_id, a.x) == (b.paper_id, b.x):
            assert b.y == a.y + a.height + 20


def test_edges_need_both_ends_and_svg_escapes(spark):
    v = spark.createDataFrame([("p", "a", "fact", 'x < "y" & z', 1.0, None), ("p", "b", "hypothesis", None, 1.0, None)], ENTITY)
    e = spark.createDataFrame([("p", "a", "b", "fact_to_hypothesis"), ("p", "a", "gone", "fact_to_hypothesis")], "paper_id string, source_id string, target_id string, relationship_type string")
    assert edge_geometry(column_layout(v), e).count() == 1
    svg = svg_documents(v, e).first().svg
    assert "&lt;" in svg and "&quot;y&quot;" in svg and svg.count("<path") == 1 and svg.count("<rect") == 2


def test_papers_of_the_fixture_are_bounded(spark):
    sizes = fx.entities(spark, "/root/testdata/sf0.1").groupBy("paper_id").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 100 and sizes[1] == 200


def test_text_functions(spark):
    df = spark.createDataFrame([("The naïve Großes naïve_x that with have 1234 abc", 2048)], "t string, n long")
    got = df.select(keyword_set(F.col("t")).alias("k"), preview(F.col("t"), 9).alias("p"), escape_xml(F.lit("a'&<")).alias("e"), format_size(F.col("n")).alias("s"), overlap(F.array().cast("array<string>"), keyword_set(F.col("t"))).alias("o")).first()
    assert got.k == ["naïve", "großes", "naïve_x", "1234"] and got.p == "The naïve..." and got.e == "a&apos;&amp;&lt;" and got.s == "2.0 KB" and got.o == 0


def test_pushdown_reaches_the_scan(spark):
    plan = fx.entities(spark, "/root/testdata/sf0.01").where("doc_id > 5").select("paper_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "text" not in plan.split("ReadSchema:")[1]
