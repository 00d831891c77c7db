"""Raw web pages: headings and paragraphs as divisions. Pages are not well-formed, so they are cut by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, heading) of h1 to h6, in order."""
    found = F.regexp_extract_all("html", F.lit(r"<h[1-6][^>]*>[^<]*"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "h"))
    return rows.select("page_id", "pos", F.substring("h", 3, 1).cast("int").alias("level"), plain(F.col("h")).alias("heading"))


def divisions(pages: DataFrame) -> DataFrame:
    """(paper_id, div_pos, head, body): each heading with the text up to the next one."""
    pieces = F.split("html", r"<h[1-6]", -1)
    rows = pages.select(F.col("page_id").cast("string").alias("paper_id"), F.posexplode(F.slice(pieces, F.lit(2), F.size(pieces))).alias("div_pos", "piece"))
    head = plain(F.regexp_extract("piece", r"^[^>]*>([^<]*)", 1))
    body = plain(F.regexp_replace("piece", r"^[^>]*>[^<]*", ""))
    return rows.select("paper_id", "div_pos", head.alias("head"), body.alias("body"))
