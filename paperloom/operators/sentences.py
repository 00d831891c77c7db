"""Sections to sentences and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Settings

#: A sentence is a run up to its closing marks, or the rest of the text.
SENTENCE = r"[^.!?]+[.!?]*"


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def kept(sentence: Column, min_chars: int = Settings.min_sentence_chars) -> Column:
    """Long enough once stripped, and with a letter or a digit."""
    return (F.length(F.trim(sentence)) >= min_chars) & sentence.rlike(r"[\p{L}\p{N}]")


def split_sections(sections: DataFrame, min_chars: int = Settings.min_sentence_chars) -> DataFrame:
    """(paper_id, section, section_ord, text) to (paper_id, section, section_ord, position, text, char_start, char_end).

    position counts all pieces of a section, kept or not; offsets are those of the piece before it was stripped.
    Null text has no pieces.
    """
    found = sections.withColumn("_pieces", pieces(F.coalesce("text", F.lit(""))))
    lead = F.length(F.regexp_extract("text", r"^[.!?]*", 0))  # closing marks that open a text belong to no piece
    ends = F.aggregate(
        "_pieces", F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), lead) + F.length(p)).cast("int")))
    )
    exploded = found.withColumn("_ends", ends).select("paper_id", "section", "section_ord", F.posexplode(F.arrays_zip("_pieces", "_ends")).alias("position", "p"))
    out = exploded.select(
        "paper_id", "section", "section_ord", "position", F.trim("p._pieces").alias("text"), (F.col("p._ends") - F.length("p._pieces")).alias("char_start"), F.col("p._ends").alias("char_end")
    )
    return out.where(kept(F.col("text"), min_chars))


def with_segment_ids(sentences: DataFrame) -> DataFrame:
    """sentences with seg_no, the running index in its paper, and seg_id made of both."""
    order = Window.partitionBy("paper_id").orderBy("section_ord", "position")
    numbered = sentences.withColumn("seg_no", F.row_number().over(order) - 1)
    return numbered.withColumn("seg_id", F.concat(F.col("paper_id"), F.lit("_seg_"), F.col("seg_no").cast("string")))
