"""The whole extraction, for any number of papers in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keywords as kw
from ..operators import validate as va
from ..operators.embed import Embedder, HashingEmbedder, embed_texts
from ..operators.graph import KnowledgeGraph
from ..operators.link import relationships
from ..operators.models import ModelClient, RuleClient, call_model
from ..operators.retrieve import index_segments, retrieve_candidates
from ..operators.sections import assemble_sections, section
from ..operators.sentences import split_sections, with_segment_ids
from ..sources import tei


def kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """df, written below folder and read again, so that no model call behind it is ever repeated."""
    if folder is None:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def extract(raw: DataFrame, client: ModelClient | None = None, embedder: Embedder | None = None, folder: str | None = None) -> tuple[KnowledgeGraph, DataFrame]:
    """(paper_id, xml) to the graph of all papers and their calls (paper_id, phase, calls, tokens, cost).

    folder is where answers of models are kept; without it they may be asked for again.
    """
    client, embedder = client or RuleClient(), embedder or HashingEmbedder()
    parsed = tei.guard(tei.parse_documents(raw)).where("error is null and reject is null")
    parsed = kept(parsed, folder, "documents")
    sections = kept(assemble_sections(tei.divisions(parsed), parsed), folder, "sections")
    segments = kept(index_segments(embed_texts(with_segment_ids(split_sections(sections)), embedder)), folder, "segments")
    papers = parsed.select("paper_id", "title", "abstract").join(section(sections, "introduction").withColumnRenamed("text", "introduction"), "paper_id", "left")
    asked = kept(call_model(kw.prompts(papers), client, temperature=0.1, max_tokens=300), folder, "keyword_answers")
    found = kw.explode_keywords(kw.parse_keywords(asked))
    vectors = embed_texts(found, embedder, "keyword")
    candidates = retrieve_candidates(segments.withColumn("section", F.lower("section")), vectors)
    detail = segments.select("paper_id", "seg_id", "text", "section")
    batches = va.batched(candidates.join(detail, ["paper_id", "seg_id"]))
    batches = kept(batches, folder, "batches")
    answers = kept(call_model(va.batch_prompts(batches), client, max_tokens=2500), folder, "validation_answers")
    vertices = kept(va.entities(va.parse_validation(answers), batches), folder, "entities")
    graph = KnowledgeGraph(vertices, relationships(vertices))
    spent = lambda df, phase: df.groupBy("paper_id").agg(F.lit(phase).alias("phase"), F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost"))
    return graph, spent(asked, "keywords").unionByName(spent(answers, "validation"))
