"""Keyword generation: prompts for each paper and type, and the parse of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..schemas import TYPE_SETTINGS, Settings


def bracketed(response: Column) -> Column:
    """From the first [ to the last ], null if there is no such pair."""
    first, last = F.locate("[", response), F.length(response) - F.locate("]", F.reverse(response)) + 1
    found = (first > 0) & (F.locate("]", response) > 0) & (last >= first)
    return F.when(found, response.substr(first, last - first + 1))


def array_items(response: Column) -> Column:
    """The elements of the JSON array in a response as variants; null if there is none or it is malformed.

    The parser ignores what follows a value, so the array is parsed as the only field of the only element of another.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('[{"v":'), bracketed(response), F.lit("}]")))
    whole = once(wrapped, lambda w: F.try_variant_get(w, "$", "array<map<string,variant>>"))
    only = once(whole, lambda x: F.when((F.size(x) == 1) & (F.size(x[0]) == 1), x[0]["v"]))
    return once(only, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")))


def once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def keyword_prompt(title: Column, abstract: Column, introduction: Column, entity_type: Column, description: Column, n: int = Settings.max_keywords) -> Column:
    """The prompt of one paper and type; long parts are cut as the model's budget asks."""
    intro = F.substring(F.array_join(F.slice(words(F.coalesce(introduction, F.lit(""))), 1, 500), " "), 1, 500)
    part = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")), F.lit("\n"))
    ask = F.concat(F.lit(f"Give up to {n} search phrases of at most {Settings.max_keyword_words} words, as a JSON array of strings, for the "), entity_type, F.lit(" of this paper. "), description)
    return F.concat(part("Title", title), part("Abstract", F.substring(abstract, 1, 500)), part("Introduction", intro), ask)


def prompts(papers: DataFrame) -> DataFrame:
    """(paper_id, title, abstract, introduction) by entity type: (paper_id, entity_type, prompt_key, prompt).

    prompt_key is equal for equal prompts, so that repeated papers are asked about once.
    """
    types = F.array(*(F.struct(F.lit(t).alias("entity_type"), F.lit(s.description).alias("description")) for t, s in TYPE_SETTINGS.items()))
    asked = papers.select("*", F.inline(types))
    prompt = keyword_prompt(F.col("title"), F.col("abstract"), F.col("introduction"), F.col("entity_type"), F.col("description"))
    return asked.select("paper_id", "entity_type", prompt.alias("prompt")).withColumn("prompt_key", F.md5("prompt"))


def parse_keywords(responses: DataFrame, content_col: str = "content") -> DataFrame:
    """responses with keywords: the strings of the answer's JSON array, stripped, not empty, of at most five words.

    Anything that is not such an array has no keywords; duplicates stay; elements of other types are dropped.
    """
    parsed = responses.withColumn("_v", array_items(F.col(content_col)))
    texts = F.transform(F.filter("_v", lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.variant_get(x, "$", "string")))
    keep = F.filter(texts, lambda t: (t != "") & (F.size(words(t)) <= Settings.max_keyword_words))
    return parsed.withColumn("keywords", F.coalesce(keep, F.array().cast("array<string>"))).drop("_v")


def explode_keywords(parsed: DataFrame) -> DataFrame:
    """(paper_id, entity_type, kw_idx, keyword)."""
    return parsed.select("paper_id", "entity_type", F.posexplode("keywords").alias("kw_idx", "keyword"))
