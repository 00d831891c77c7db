"""Arrow helpers that the Python-side operators of this subpackage share.

Every helper streams: one Arrow batch in, one or more batches out, nothing kept between batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows of which a function sees the Python objects at once.
SLICE = 1024


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, whatever other columns the input has; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on for other tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def trimmed(fn: Callable) -> Callable:
    """fn of a group, which gives back the memory it used."""

    @wraps(fn)
    def run(rows):
        try:
            return fn(rows)
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch | dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow whose function sees slices of batches and may yield dicts of columns."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in fn(b.slice(a, SLICE) for b in batches for a in range(0, b.num_rows, SLICE)):
                yield as_batch(out, target)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def as_batch(out: pa.RecordBatch | dict, target: pa.Schema) -> pa.RecordBatch:
    if isinstance(out, pa.RecordBatch):
        return out
    return pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) and x.type == f.type else pa.array(x, type=f.type) for f in target], schema=target)


def free_name(taken: list[str], name: str) -> str:
    """name, behind as many underscores as no column in taken has, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def runs_of_chars(ids: list, texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """The rows of a batch in slices of about `limit` characters: whole texts, bounded working memory."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
