"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL.

The operators keep their own interfaces; a query here applies one to its whole table and derives the
digest columns of the result from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_io import read_table


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    coded = encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chunks = chat.format_chunks(rows.withColumn("parts", chat.text_part(F.coalesce("text", F.lit("")))))
    # Read back from the formatted text alone, chunk by chunk.
    turns = chat.read_turns(F.col("formatted"))
    read = chunks.select(
        "conv_id",
        "chunk",
        turns.alias("turns"),
        F.length("formatted").cast("long").alias("chars"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("masked"),
    ).select("conv_id", "chunk", "chars", "masked", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("echo"))
    whole = chat.join_chunks(read, {"n_turns": F.col("n"), "formatted_chars": F.col("chars")}, echo=F.col("echo"), masked=F.col("masked"))
    return whole.select(
        "conv_id", "n_turns", F.sha2("echo", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars"
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_spans

    found = find_spans(read_table(spark, sf_dir, "documents")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), kind) for kind in KINDS),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    kept = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def span_list(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    found = find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), kind) for kind in ("assign", "access", "hex")),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest_neighbours

    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels").where(~held_out), "toxic")
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = score_quality(docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("_score").alias("score"), F.col("_keep").alias("keep"))


PROBE_TEXT = "\\### Assistant: </turn> ok"

OP1_SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), sized AS (
  SELECT *, text AS body,
    length(text) + length(text) - length(replace(text, chr(92), '')) + length(regexp_replace(text, '<(turn |/turn>|part )', '<.' , 'g')) - length(regexp_replace(text, '<(turn |/turn>|part )', '<', 'g')) AS text_chars,
    length(role) + length(role) - length(replace(role, chr(92), '')) + length(replace(role, '">', '".>')) - length(role) AS role_chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn role="') + role_chars + length('">') + text_chars + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat, "op2_pii": op2_pii, "op3_line_dedup": op3_line_dedup, "op4_decontaminate": op4_decontaminate, "op5_secrets": op5_secrets,
        "op6_ann": op6_ann, "op7_jaccard": op7_jaccard, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op3_line_dedup": OP3_SQL}
