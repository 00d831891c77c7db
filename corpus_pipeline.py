"""The corpus pipeline: quality filter, line dedup, near-copy removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the docs of the next. All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty table; repeated rows, ties and texts of any length are
handled as its operator says; extra columns of documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.arrow_io import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, whole. Null and empty texts stay; null languages are one; without trusted labels all stay."""
    from paperloom.llm.quality import filter_quality

    return filter_quality(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id holds; n_chars is counted anew, where it is a column. Null texts stay null; rows without an id keep all lines."""
    from paperloom.llm.line_dedup import dedup_lines

    kept = dedup_lines(docs, counts=None)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id with all rows of that id. Rows without an id, and texts that are null, empty or blank, stay."""
    from paperloom.llm.jaccard import drop_near_copies

    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Rows of an id go together, rows without one by their own text; null texts hold nothing; an empty benchmark keeps all."""
    from paperloom.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row left; null text counts as empty and has no tokens; null ids stay null."""
    import public_tokenizers

    from paperloom.llm.bpe import encode_decode

    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("decontaminate", decontaminate), ("tokens", tokens)]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents. What lies between them is in the shared folder until it is used, or the run fails; the result goes with the session's process."""
    from paperloom.llm.shared import delete, delete_at_exit, shared_folder

    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    docs, last = read_table(spark, sf_dir, "documents"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            written = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(written)
            docs = spark.read.parquet(written)
            if last is not None:
                delete(spark, last)
            last = written
    except BaseException:
        delete(spark, folder)
        raise
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
