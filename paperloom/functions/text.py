"""Text: words, keyword sets, overlap, wrapping, previews, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import GAP, HEADINGS, LINE_HEIGHT, STOP_WORDS, WRAP

#: Word characters of any script; the engine's own class is ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def keyword_set(text: Column) -> Column:
    """Distinct lower-cased words of more than three characters without stop words; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct arrays; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def section_of(heading: Column) -> Column:
    """The section that a heading stands for, null if none: a literal map of fixed size."""
    pairs = [F.lit(x) for section, names in HEADINGS.items() for name in names for x in (name, section)]
    return F.create_map(*pairs)[F.lower(F.trim(heading))]


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def wrap(text: Column, width: int = WRAP) -> Column:
    """Greedy lines: a new line when the words' characters, one for each of them and the next word pass the width."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"), F.lit(0).alias("chars"), F.lit(0).alias("n"))

    def step(acc: Column, w: Column) -> Column:
        full = (acc["chars"] + F.length(w) + acc["n"] > width) & (acc["n"] > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] == 0), w).otherwise(F.concat(acc["line"], F.lit(" "), w)).alias("line"),
            F.when(full, F.length(w)).otherwise(acc["chars"] + F.length(w)).alias("chars"),
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
        )

    return F.aggregate(words(text), start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]))


def node_height(lines: Column) -> Column:
    return F.greatest(F.lit(80), F.size(lines) * LINE_HEIGHT + 2 * GAP)


def escape_xml(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def format_size(n: Column) -> Column:
    kb = F.lit(1024.0)
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / kb)).otherwise(F.format_string("%.1f MB", n / (kb * kb)))


def safe_name(name: Column) -> Column:
    """A file name without characters that file systems refuse."""
    return F.substring(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_"), 1, 100)
