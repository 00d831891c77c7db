"""Sections, sentences, retrieval, validation, and the whole extraction."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions.vectors import distance
from paperloom.operators.keywords import parse_keywords
from paperloom.operators.models import RuleClient, call_model
from paperloom.operators.retrieve import index_segments, retrieve_candidates
from paperloom.operators.sections import assemble_sections
from paperloom.operators.sentences import split_sections
from paperloom.operators.validate import parse_validation
from paperloom.plans.extract import extract
from paperloom.schemas import HEADINGS, MAJOR_HEADINGS
from paperloom.sources import results, tei

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A study</title></titleStmt><sourceDesc><biblStruct coords="3,1,2">
<author><persName><forename>Ada</forename><surname>Byron</surname></persName><affiliation>Some  Lab</affiliation></author></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>We studied the growth of many plants under blue light.</p></abstract></profileDesc></teiHeader><text><body>
<div><head>Introduction</head><p>Plants need light to grow well. We propose that blue light increases growth.</p></div>
<div><head>Results</head></div><div><head>Leaf area</head><p>The leaf area doubled within two weeks of the start.</p></div>
<div><p>no head</p></div><div><head>Methods</head><p>We measured leaf area with a camera.</p><p>Each plant was measured twice.</p></div></body>
<back><listBibl><biblStruct coords="9,1"><analytic><title>Light</title><author><persName><surname>Doe</surname></persName></author></analytic><date when="1999"/><idno type="DOI">10.1/x</idno></biblStruct></listBibl></back></text></TEI>"""


def sections(spark, *divs):
    df = spark.createDataFrame([("p", k, h, b) for k, (h, b) in enumerate(divs)], "paper_id string, div_pos int, head string, body string")
    return [(r.section, r.text) for r in assemble_sections(df).orderBy("section_ord").collect()]


def test_empty_major_headings_own_what_follows(spark):
    assert sections(spark, ("Results", ""), ("A", "a"), ("B", "b"), ("Discussion", "d")) == [("results", "a\n\nb"), ("discussion", "d")]
    assert sections(spark, ("Results", " "), ("Statistical analysis", "a"), ("Conclusions", "c")) == [("results", "a\n\nc")]
    assert sections(spark, ("Results", "r"), ("Gene X", "x")) == [("results", "r")]
    assert sections(spark, ("Results", ""), (None, "lost"), ("A", "a")) == [("results", "a")]
    assert sections(spark, ("Methods", "a"), ("Materials and Methods", "b")) == [("methods", "a\n\nb")]


def loop(divs):
    lookup = {n: s for s, names in HEADINGS.items() for n in names}
    out, k = {}, 0
    divs = [(h.lower(), b) for h, b in divs if h is not None]
    while k < len(divs):
        head, body = divs[k]
        parts, k = ([body] if body else []), k + 1
        if head in MAJOR_HEADINGS and not body:
            while k < len(divs) and divs[k][0] not in MAJOR_HEADINGS:
                parts += [divs[k][1]] if divs[k][1] else []
                k += 1
        if (name := lookup.get(head)) and parts:
            out.setdefault(name, []).extend(parts)
    return [(s, "\n\n".join(p)) for s, p in out.items()]


def test_sections_against_a_plain_loop(spark):
    rng = random.Random(5)
    heads = ["Results", "Methods", "Discussion", "Conclusions", "Background", "A", None]
    papers = {f"p{n}": [(rng.choice(heads), rng.choice(["", f"t{k}"])) for k in range(rng.randint(0, 9))] for n in range(200)}
    df = spark.createDataFrame([(p, k, h, b) for p, divs in papers.items() for k, (h, b) in enumerate(divs)], "paper_id string, div_pos int, head string, body string")
    got = {}
    for r in assemble_sections(df).orderBy("paper_id", "section_ord").collect():
        got.setdefault(r.paper_id, []).append((r.section, r.text))
    for p, divs in papers.items():
        assert got.get(p, []) == loop(divs), divs


def test_sentences_are_filtered_after_they_are_numbered(spark):
    df = spark.createDataFrame([("p", "results", 0, "Ok. .......... A valid one."), ("p", "x", 1, None), ("p", "y", 2, "...!")], "paper_id string, section string, section_ord int, text string")
    rows = split_sections(df).collect()
    assert [(r.text, r.position) for r in rows] == [("A valid one.", 2)]
    text = "Ok. .......... A valid one."
    assert all(text[r.char_start : r.char_end].strip() == r.text for r in rows)


def test_the_first_keyword_that_finds_a_segment_sets_its_distance(spark):
    seg = spark.createDataFrame([("p", 1, "methods", [0.6, 0.8]), ("p", 2, "results", [1.0, 0.0])], "paper_id string, seg_id long, section string, embedding array<double>")
    kws = spark.createDataFrame([("p", "method", 0, [1.0, 0.0]), ("p", "method", 1, [0.6, 0.8])], "paper_id string, entity_type string, kw_idx int, embedding array<double>")
    rows = retrieve_candidates(seg, kws).collect()
    assert [(r.seg_id, round(r.distance, 6), r.kw_idx) for r in rows] == [(1, 0.4, 0)]


def test_keywords_that_are_segments_tie_at_zero(spark):
    rng = random.Random(4)
    vectors = [(n, [rng.gauss(0, 1) for _ in range(16)]) for n in range(50)]
    found = spark.createDataFrame(vectors, "n int, v array<double>").select(distance(F.col("v"), F.col("v")).alias("d"), distance(F.col("v"), F.transform("v", lambda x: -3 * x)).alias("far")).collect()
    assert all(r.d == 0 and 2 - 1e-12 < r.far <= 2 for r in found)


def test_a_segment_without_an_embedding_fails(spark):
    seg = spark.createDataFrame([("p", 1, "methods", None)], "paper_id string, seg_id long, section string, embedding array<double>")
    with pytest.raises(Exception, match="without an embedding"):
        index_segments(seg).collect()


def answers(spark, content, n=5):
    df = spark.createDataFrame([("p", "fact", 0, n, content)], "paper_id string, entity_type string, batch_id int, n int, content string")
    return [(r.pos, r.fragment_id, r.confidence) for r in parse_validation(df).orderBy("pos").collect()]


def item(k=1, valid=True, conf=0.9, **more):
    return {"fragment_id": k, "is_valid": valid, "confidence": conf} | more


def test_validation_stops_at_the_first_bad_element(spark):
    assert answers(spark, json.dumps([item(1), item(2, conf=1.2), item(3)])) == [(0, 1, 0.9)]
    assert answers(spark, json.dumps([item(1), 5, item(3)])) == [(0, 1, 0.9)]
    assert answers(spark, json.dumps([item("1"), item(2)])) == []
    assert answers(spark, json.dumps([item(1, conf=None), item(2)])) == []


def test_validation_skips_what_does_not_count(spark):
    assert answers(spark, json.dumps([item(1, False, "x"), item(2, conf=0.1), item(0), item(6), {"is_valid": True, "confidence": 1}, item(5)])) == [(5, 5, 0.9)]
    assert answers(spark, json.dumps([item(1, "false"), item(1, [1]), item(1, []), item(1, 0), item(1, "")])) == [(0, 1, 0.9), (1, 1, 0.9)]
    assert answers(spark, "none") == [] == answers(spark, "[1") == answers(spark, None) == answers(spark, json.dumps([item()]) + "]")


def test_keyword_arrays(spark):
    contents = ['["a b c d e f", " x ", 3, ""]', 'say ["a", "a"] now', '{"k": 1}', "[", None, '[["a"]]']
    df = spark.createDataFrame([(k, c) for k, c in enumerate(contents)], "k int, content string")
    assert [r.keywords for r in parse_keywords(df).orderBy("k").collect()] == [["x"], ["a", "a"], [], [], [], []]


class Failing:
    def generate(self, prompt, **_):
        if "bad" in prompt:
            raise TimeoutError("slow")
        return RuleClient().generate(prompt)


def test_a_failed_call_is_an_error_row(spark):
    rows = call_model(spark.createDataFrame([("good prompt words",), ("bad",)], "prompt string"), Failing()).orderBy("prompt").collect()
    assert [r.error for r in rows] == ["TimeoutError: slow", None] and rows[0].cost == 0


def test_documents_parse_and_malformed_ones_are_rows(spark):
    parsed = tei.parse_documents(spark.createDataFrame([("a", TEI), ("b", "<x>"), ("c", None)], "paper_id string, xml string"))
    a, b, c = parsed.orderBy("paper_id").collect()
    assert (a.title, a.authors, a.affiliations, a.page_count) == ("A study", ["Ada Byron"], ["Some Lab"], 2)
    assert b.error and c.error and b.title is None
    ref = tei.references(parsed).collect()
    assert [(r.title, r.authors, r.year, r.doi) for r in ref] == [("Light", ["Doe"], "1999", "10.1/x")]


def test_extraction_end_to_end(spark, tmp_path):
    raw = spark.createDataFrame([("p1", TEI), ("p2", TEI), ("bad", "<x>")], "paper_id string, xml string")
    graph, calls = extract(raw, folder=str(tmp_path))
    v, e = graph.vertices.collect(), graph.edges.collect()
    assert {r.paper_id for r in v} == {"p1", "p2"} and {r.source_section for r in v} <= {"introduction", "results", "methods", "abstract"}
    ids = {(r.paper_id, r.id) for r in v}
    assert e and all((r.paper_id, r.source_id) in ids and (r.paper_id, r.target_id) in ids and 0.6 <= r.confidence <= 0.85 for r in e)
    assert {(r.paper_id, r.phase): r.calls for r in calls.collect()}[("p1", "keywords")] == 8
    results.write_results(graph, str(tmp_path / "json"))
    back = results.read_results(spark, str(tmp_path / "json" / "*" / "*.txt"))
    assert back.vertices.count() == len(v) and back.edges.count() == len(e)


def test_results_accept_lists_and_either_name(spark):
    doc = json.dumps({"paper_id": "p", "entities": [{"id": "a"}], "relationships": [{"source_id": "a", "target_id": "b", "type": "supports"}]})
    g = results.parse_results(spark.createDataFrame([(doc,), ("{",), (None,)], "json string"))
    assert [(r.id, r.type, r.confidence) for r in g.vertices.collect()] == [("a", "fact", 1.0)]
    assert [(r.relationship_type, r.confidence) for r in g.edges.collect()] == [("supports", 1.0)]
