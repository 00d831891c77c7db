"""Line deduplication: hash normalised lines, find those that several documents hold, keep each once.

Stages: explode the lines of every document into 128-bit hashes of their keys (one row for each key and
document), count documents by hash with map-side aggregation, join the shared hashes back to the lines
they drop, and reassemble each document by position without them. A very common line is summed before
the shuffle, by hash and a salt of the document; its holders then join by both, so that they are dealt
to all tasks.

Defined results: null text counts as empty, an empty text has one empty line; rows with the same id are
one document; rows without an id keep all lines and count for no hash; a text of any length is split
whole, and its hashes of dropped lines are the only group made of it; an empty table gives an empty
result. Other columns pass through `dedup_lines` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_io import free_name, id_and_text, map_arrow, struct
from .shared import held_by_several, over_salts, salted

#: Fixed value: the white space that a key loses at both ends.
SPACE = " \t\n\x0b\x0c\r"


def line_keys(lines: list[str], min_chars: int) -> list[bytes | None]:
    """The hash of each line's key, None for keys shorter than min_chars code points."""
    digest = xxhash.xxh3_128_digest
    return [digest(key.encode().lower()) if len(key := line.strip(SPACE)) >= min_chars else None for line in lines]


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) once for each document row and key."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(line_keys(text.split("\n"), min_chars))
                own.discard(None)
                found += own
                ids += [doc_id] * len(own)
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield {"doc_id": ids, "h1": pa.array(np.ascontiguousarray(halves[:, 0])), "h2": pa.array(np.ascontiguousarray(halves[:, 1]))}

    return map_arrow(docs.where("doc_id is not null"), run, struct("doc_id long, h1 long, h2 long"))


def shared_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, _salt, keeper) of the hashes that at least min_docs documents hold, for each salt; keeper is the smallest id."""
    if min_docs == 2:
        return held_by_several(keys, ["h1", "h2"], "doc_id").withColumnRenamed("first", "keeper")
    parts = keys.distinct().groupBy("h1", "h2", "_salt").agg(F.min("doc_id").alias("_low"), F.count("*").alias("_n"))  # all rows of a document have one salt
    return over_salts(parts, ["h1", "h2"], keeper=F.min("_low"), _docs=F.sum("_n")).where(F.col("_docs") >= min_docs).select("h1", "h2", "_salt", "keeper")


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, counts: tuple[str, str] | None = ("_n_lines", "_n_dropped")
) -> DataFrame:
    """The rows of df with text_col deduplicated, and the two columns that counts names, which replace any of that name."""
    df = df.drop(*(counts or ()))
    keys = salted(hashed_lines(id_and_text(df, id_col, text_col), min_chars), "doc_id")
    drops = (
        keys.join(shared_lines(keys, min_docs), ["h1", "h2", "_salt"])
        .where("doc_id > keeper")
        .groupBy(F.col("doc_id").alias("_drop_id"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))
    )
    drops = drops.select("_drop_id", F.col("_drops.h1").alias(free_name(df.columns, "_h1")), F.col("_drops.h2").alias(free_name(df.columns, "_h2")))
    joined = df.join(drops, df[id_col].cast("long") == drops["_drop_id"], "left").drop(drops["_drop_id"])
    columns = df.columns
    at = columns.index(text_col)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), *(T.StructField(c, T.LongType()) for c in counts or ())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, h1, h2 in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if h1:
                    pairs = np.array([h1, h2], dtype="<i8").T.tobytes()
                    gone = {pairs[k : k + 16] for k in range(0, len(pairs), 16)}
                    kept = [line for line, key in zip(lines, line_keys(lines, min_chars)) if key not in gone]
                    n_dropped.append(len(lines) - len(kept))
                    text = "\n".join(kept)
                else:
                    n_dropped.append(0)
                texts.append(text)
            out = {name: batch.column(k) for k, name in enumerate(columns)}
            yield out | {text_col: texts} | (dict(zip(counts, (n_lines, n_dropped))) if counts else {})

    return map_arrow(joined, run, schema)
