"""Validation: candidates in batches, prompts, and the parse of the answers with its abort rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FALLBACK_THRESHOLD, Settings, type_table
from .keywords import array_items

#: Extra guidance by type.
GUIDANCE = {"method": "Accept only techniques that were applied.", "experiment": "Accept only work that was carried out.", "dataset": "Accept only named or described data."}


def batched(candidates: DataFrame, size: int = Settings.batch_size) -> DataFrame:
    """candidates (paper_id, entity_type, rank) with batch_id and fragment_id, which starts at 1."""
    return candidates.withColumn("batch_id", F.floor((F.col("rank") - 1) / size).cast("int")).withColumn("fragment_id", ((F.col("rank") - 1) % size + 1).cast("int"))


def batch_prompts(batches: DataFrame, chars: int = Settings.prompt_chars) -> DataFrame:
    """(paper_id, entity_type, batch_id, n, prompt): one prompt for each batch, its fragments in order."""
    line = F.concat(F.lit("["), F.col("fragment_id").cast("string"), F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    grouped = batches.groupBy("paper_id", "entity_type", "batch_id").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("fragment_id", line.alias("line")))).alias("ls"))
    types = F.broadcast(type_table(batches.sparkSession).select("entity_type", "description"))  # 8 rows
    pairs = [F.lit(x) for kv in GUIDANCE.items() for x in kv]
    extra = F.coalesce(F.create_map(*pairs)[F.col("entity_type")], F.lit(""))
    head = F.concat(F.lit("Which fragments are a "), F.col("entity_type"), F.lit("? "), F.col("description"), F.lit(" "), extra, F.lit("\nAnswer with a JSON array of fragment_id, is_valid, confidence, core_text.\n"))
    return grouped.join(types, "entity_type").select("paper_id", "entity_type", "batch_id", "n", F.concat(head, F.array_join("ls.line", "\n")).alias("prompt"))


def truthy(v: Column) -> Column:
    """Whether a JSON value counts as true: not false, null, zero, or empty."""
    kind = F.schema_of_variant(v)
    text = v.cast("string")
    empty = (kind == "VOID") | ((kind == "BOOLEAN") & (text == "false")) | ((kind == "STRING") & (text == "")) | ((kind.startswith("ARRAY")) & (text == "[]")) | ((kind.startswith("OBJECT")) & (text == "{}"))
    zero = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(v, "$", "double") == 0)
    return v.isNotNull() & ~empty & ~F.coalesce(zero, F.lit(False))


def parse_validation(responses: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """(paper_id, entity_type, batch_id, pos, fragment_id, confidence, core_text) of the accepted elements.

    responses: paper_id, entity_type, batch_id, n, content. An answer that is no JSON array yields nothing. Elements
    count in order up to the first bad one: not an object, or, once is_valid is truthy, a confidence that is no number or
    above 1, or a fragment_id that is no whole number. Elements that are not valid, below the type's threshold, or that
    name no fragment of the batch are skipped. A fragment named twice counts twice.
    """
    types = thresholds if thresholds is not None else type_table(responses.sparkSession).select("entity_type", "threshold")
    rows = responses.withColumn("_items", array_items(F.col("content")))
    rows = rows.select("paper_id", "entity_type", "batch_id", "n", F.posexplode("_items").alias("pos", "_e")).join(F.broadcast(types), "entity_type", "left")
    # One step for each thing that later steps name more than once.
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("MISSING"))
    get = lambda name: F.when(F.col("_object"), F.try_variant_get("_e", f"$.{name}", "variant"))
    rows = rows.withColumn("_object", F.schema_of_variant("_e").startswith("OBJECT"))
    rows = rows.withColumns({"_valid": get("is_valid"), "_conf": get("confidence"), "_frag": get("fragment_id"), "_core": get("core_text")})
    rows = rows.withColumns({"_ok": F.col("_object") & F.coalesce(truthy(F.col("_valid")), F.lit(False)), "_ck": kind("_conf"), "_fk": kind("_frag")})

    def number(value: str, kind_col: str, as_type: str):
        missing, boolean = F.col(kind_col) == "MISSING", F.col(kind_col) == "BOOLEAN"
        flag = F.try_variant_get(value, "$", "boolean").cast(as_type)
        return F.when(missing, F.lit(0).cast(as_type)).when(boolean, flag).otherwise(F.try_variant_get(value, "$", as_type))

    rows = rows.withColumns({
        "confidence": number("_conf", "_ck", "double"), "fragment_id": number("_frag", "_fk", "int"),
        "_bad_conf": F.col("_ok") & (F.col("_ck") != "MISSING") & ~F.col("_ck").rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"),
    })
    rows = rows.withColumn("_passed", F.col("_ok") & ~F.col("_bad_conf") & (F.coalesce("confidence", F.lit(0.0)) >= F.coalesce("threshold", F.lit(FALLBACK_THRESHOLD))))
    rows = rows.withColumn("_bad_frag", F.col("_passed") & (F.col("_fk") != "MISSING") & ~F.col("_fk").rlike(r"^(BIGINT|BOOLEAN)"))
    rows = rows.withColumn("_named", F.col("_passed") & ~F.col("_bad_frag") & F.coalesce(F.col("fragment_id").between(1, F.col("n")), F.lit(False)))
    rows = rows.withColumn("_bad", ~F.col("_object") | F.col("_bad_conf") | F.col("_bad_frag") | (F.col("_named") & (F.col("confidence") > 1)))
    batch = Window.partitionBy("paper_id", "entity_type", "batch_id")
    rows = rows.withColumn("_stop", F.min(F.when(F.col("_bad"), F.col("pos"))).over(batch))
    core = F.when(truthy(F.col("_core")), F.col("_core").cast("string"))
    return rows.where((F.col("pos") < F.coalesce("_stop", F.lit(2**31 - 1))) & F.col("_named")).select("paper_id", "entity_type", "batch_id", "pos", "fragment_id", "confidence", core.alias("core_text"))


def entities(accepted: DataFrame, batches: DataFrame) -> DataFrame:
    """Entities of accepted elements: the core text or the candidate's, and everything else from the candidate."""
    joined = accepted.join(batches, ["paper_id", "entity_type", "batch_id", "fragment_id"])
    key = F.md5(F.concat_ws("|", "paper_id", "entity_type", "seg_id", "batch_id", "pos"))
    return joined.select(
        "paper_id", F.concat(F.col("entity_type"), F.lit("_"), F.substring(key, 1, 8)).alias("id"), F.col("entity_type").alias("type"), F.coalesce("core_text", "text").alias("text"),
        "confidence", F.col("section").alias("source_section"), F.col("text").alias("original_text"), "seg_id", "distance",
    )


def threshold_filter(scored: DataFrame) -> DataFrame:
    """The rows whose confidence reaches their type's threshold; an unknown type needs the fallback."""
    types = F.broadcast(type_table(scored.sparkSession).select(F.col("entity_type").alias("type"), "threshold"))  # 8 rows
    return scored.join(types, "type", "left").where(F.col("confidence") >= F.coalesce("threshold", F.lit(FALLBACK_THRESHOLD))).drop("threshold")


def validation_rate(scored: DataFrame) -> DataFrame:
    """(type, candidates, validated, rejected, rate); the rate of no candidates is 0."""
    total = scored.groupBy("type").agg(F.count("*").alias("candidates"))
    good = threshold_filter(scored).groupBy("type").agg(F.count("*").alias("validated"))
    joined = total.join(good, "type", "left").withColumn("validated", F.coalesce("validated", F.lit(0)))
    return joined.withColumn("rejected", F.col("candidates") - F.col("validated")).withColumn("rate", F.coalesce(F.try_divide(F.col("validated").cast("double"), F.col("candidates")), F.lit(0.0)))
