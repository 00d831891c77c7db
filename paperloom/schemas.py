"""Vocabularies, rules and settings that define the engine's semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Entity types in the order that drives loops, and all relationship types.
ENTITY_TYPES = ("fact", "hypothesis", "experiment", "method", "result", "dataset", "analysis", "conclusion")
RELATIONSHIP_TYPES = (
    "fact_to_hypothesis", "hypothesis_to_experiment", "hypothesis_to_method", "experiment_uses_technique", "experiment_uses_dataset",
    "method_to_result", "result_to_analysis", "result_to_conclusion", "analysis_to_conclusion", "based_on", "supports", "contradicts", "related_to",
)

# The section that each lower-cased heading stands for.
HEADINGS = {
    "introduction": ("introduction", "background"),
    "methods": ("methods", "materials and methods", "methodology", "study population", "immunohistochemistry", "image analysis", "statistical analysis", "experimental design", "data collection"),
    "results": ("results", "findings", "observations"),
    "discussion": ("discussion", "interpretation"),
    "conclusion": ("conclusion", "conclusions", "concluding remarks"),
    "acknowledgments": ("acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement", "funding"),
    "references": ("references", "bibliography"),
}
MAJOR_HEADINGS = ("results", "methods", "discussion", "introduction", "conclusion")

# Words that never count as keywords.
STOP_WORDS = ("the", "and", "for", "that", "this", "with", "was", "were", "are", "from", "been", "have", "has", "had", "but", "not")

# Layout.
COLUMN_X = {"fact": 150, "hypothesis": 430, "experiment": 710, "method": 990, "result": 1270, "dataset": 1550, "analysis": 1830, "conclusion": 2110}
OTHER_X, TOP, GAP, NODE_WIDTH, EXTRA_WIDTH, LINE_HEIGHT, CANVAS_WIDTH, WRAP = 850, 100, 20, 200, 24, 16, 2400, 25
WIDE_TYPES = ("method", "experiment", "hypothesis")
LEVELS = {"fact": 0, "hypothesis": 1, "experiment": 2, "method": 2, "dataset": 2, "result": 3, "analysis": 4, "conclusion": 5}
OTHER_LEVEL = 3


@dataclass(frozen=True)
class Rule:
    """One linking rule: source and target type, the target's sections, and the factors of the score."""

    rule_id: int
    rel_type: str
    src_type: str
    dst_type: str
    rule: str
    f_hi: float
    f_lo: float
    dst_sections: tuple[str, ...] | None = None
    same_section: bool = False
    hi_kind: str = "always"  # always, overlap or section
    hi_threshold: float = 0.0


# The eight linking rules, in order.
RULES = (
    Rule(1, "fact_to_hypothesis", "fact", "hypothesis", "same_section", 0.8, 0.8, same_section=True),
    Rule(2, "hypothesis_to_experiment", "hypothesis", "experiment", "hypothesis_experiment_link", 0.75, 0.75),
    Rule(3, "experiment_uses_technique", "experiment", "method", "experiment_technique", 0.85, 0.7, ("methods", "materials"), hi_kind="overlap", hi_threshold=0.1),
    Rule(4, "experiment_uses_dataset", "experiment", "dataset", "experiment_dataset", 0.7, 0.7, ("methods", "materials")),
    Rule(5, "method_to_result", "method", "result", "method_result", 0.75, 0.65, ("results", "discussion"), hi_kind="overlap", hi_threshold=0.15),
    Rule(6, "result_to_analysis", "result", "analysis", "result_analysis", 0.8, 0.65, hi_kind="section"),
    Rule(7, "result_to_conclusion", "result", "conclusion", "result_conclusion", 0.85, 0.75, ("conclusion", "discussion"), hi_kind="overlap", hi_threshold=0.2),
    Rule(8, "analysis_to_conclusion", "analysis", "conclusion", "analysis_conclusion", 0.7, 0.7),
)


@dataclass(frozen=True)
class TypeSetting:
    top_k: int
    sections: tuple[str, ...]
    threshold: float
    description: str


# What each entity type retrieves, where from, and the confidence it needs.
TYPE_SETTINGS = {
    "fact": TypeSetting(10, ("introduction", "abstract", "discussion"), 0.7, "An established finding that the paper builds on."),
    "hypothesis": TypeSetting(35, ("introduction", "abstract"), 0.68, "A testable statement that the paper proposes."),
    "experiment": TypeSetting(25, ("methods", "materials"), 0.68, "A test or study that the authors carried out."),
    "method": TypeSetting(12, ("methods", "materials"), 0.72, "A technique, instrument or protocol that was used."),
    "result": TypeSetting(15, ("results", "discussion"), 0.7, "An outcome that the paper reports."),
    "dataset": TypeSetting(15, ("methods", "materials", "results"), 0.65, "A collection of data or samples that was used or made."),
    "analysis": TypeSetting(15, ("methods", "results"), 0.7, "A statistical or computational treatment of data."),
    "conclusion": TypeSetting(20, ("conclusion", "discussion", "abstract"), 0.7, "What the authors infer from their results."),
}
FALLBACK_TOP_K, FALLBACK_THRESHOLD = 20, 0.7


@dataclass(frozen=True)
class Settings:
    """Every constant of the pipeline in one place."""

    min_relationship_confidence: float = 0.6
    batch_size: int = 5
    embedding_dim: int = 768
    min_sentence_chars: int = 10
    min_document_chars: int = 100
    max_keyword_words: int = 5
    max_keywords: int = 15
    prompt_chars: int = 300
    input_price: float = 0.15
    output_price: float = 0.60
    embedding_price: float = 0.02
    tokens_per_word: float = 1.3
    max_upload_bytes: int = 10 * 1024 * 1024
    requests_per_hour: int = 5
    session_days: int = 7
    types: dict = field(default_factory=lambda: dict(TYPE_SETTINGS))


def rule_table(spark: SparkSession) -> DataFrame:
    """The linking rules, one row each: a table of fixed size."""
    schema = T.StructType.fromDDL(
        "rule_id int, rel_type string, src_type string, dst_type string, rule string, f_hi double, f_lo double, "
        "dst_sections array<string>, same_section boolean, hi_kind string, hi_threshold double"
    )
    return spark.createDataFrame(
        [(r.rule_id, r.rel_type, r.src_type, r.dst_type, r.rule, r.f_hi, r.f_lo, list(r.dst_sections) if r.dst_sections else None, r.same_section, r.hi_kind, r.hi_threshold) for r in RULES], schema
    )


def type_table(spark: SparkSession) -> DataFrame:
    """The entity types with their settings: a table of fixed size."""
    schema = T.StructType.fromDDL("entity_type string, type_ord int, top_k int, sections array<string>, threshold double, description string")
    return spark.createDataFrame([(t, k, s.top_k, list(s.sections), s.threshold, s.description) for k, (t, s) in enumerate(TYPE_SETTINGS.items())], schema)
