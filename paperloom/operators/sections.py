"""Divisions to sections: heading lookup, the look-ahead of empty major headings, and ordered assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import section_of
from ..schemas import MAJOR_HEADINGS


def assemble_sections(divs: DataFrame, abstracts: DataFrame | None = None) -> DataFrame:
    """(paper_id, div_pos, head, body) to (paper_id, section, section_ord, text).

    A major heading without text owns the headed divisions up to the next major one, whatever they would map to;
    other divisions go to the section their heading stands for, or nowhere. Divisions without a heading are
    ignored, blank texts add nothing, and the parts of a section are joined in document order. Sections are in
    the order of the division that opened them; abstracts (paper_id, abstract) come last, empty or not.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = strip(F.coalesce("body", F.lit("")))
    headed = divs.where("head is not null").select("paper_id", "div_pos", F.lower(strip(F.col("head"))).alias("head"), body.alias("body"))
    headed = headed.withColumn("major", F.col("head").isin(*MAJOR_HEADINGS)).withColumn("mapped", section_of(F.col("head")))
    order = Window.partitionBy("paper_id").orderBy("div_pos")
    mark = F.when(F.col("major"), F.struct(F.col("mapped").alias("section"), (F.col("body") == "").alias("empty"), "div_pos"))
    owned = headed.withColumn("owner", F.last(mark, ignorenulls=True).over(order))
    swallowed = ~F.col("major") & F.coalesce(F.col("owner.empty"), F.lit(False))
    placed = owned.select(
        "paper_id", "div_pos", "body", F.when(swallowed, F.col("owner.section")).otherwise(F.col("mapped")).alias("section"), F.when(swallowed, F.col("owner.div_pos")).otherwise(F.col("div_pos")).alias("opened")
    ).where("section is not null and body <> ''")
    parts = placed.groupBy("paper_id", "section").agg(F.min("opened").alias("section_ord"), F.sort_array(F.collect_list(F.struct("div_pos", "body"))).alias("ps"))
    out = parts.select("paper_id", "section", F.col("section_ord").cast("int").alias("section_ord"), F.array_join("ps.body", "\n\n").alias("text"))
    if abstracts is None:
        return out
    last = abstracts.select("paper_id", F.lit("abstract").alias("section"), F.lit(2**31 - 1).cast("int").alias("section_ord"), F.coalesce("abstract", F.lit("")).alias("text"))
    return out.unionByName(last)


def section(sections: DataFrame, name: str) -> DataFrame:
    """(paper_id, text) of the first section with this name, in any case."""
    own = sections.where(F.lower("section") == name.lower())
    return own.groupBy("paper_id").agg(F.min_by("text", "section_ord").alias("text"))
