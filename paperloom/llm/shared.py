"""Tables that a job keeps in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_io import map_arrow, struct

#: Bits of every Bloom filter: 2 MB, whatever the number of keys.
FILTER_BITS = 1 << 24
P = np.uint64(0x9E3779B97F4A7C15)


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    A session on one machine that names none, as in tests, gets a folder of its own there; on a cluster every executor
    would write to its own disk, so there the folder must be named.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="paperloom-")
        context.setCheckpointDir(folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, path: str) -> None:
    files, found = file_system(spark, path)
    files.delete(found, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes path when the session's process ends, also after an error."""
    files, found = file_system(spark, path)
    files.deleteOnExit(found)


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: later actions neither repeat it nor depend on executors.

    The table goes with discard(), or when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing will read again."""
    for table in tables:
        delete(table.sparkSession, _PATHS.pop(table))


def salted(rows: DataFrame, by: str) -> DataFrame:
    """rows with _salt, made of the column by: as many values as the session has shuffle partitions, so that a hot key is dealt to all of them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))


def over_salts(parts: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """parts, one row for each key and salt, with aggregates over all salts of the key."""
    whole = Window.partitionBy(*keys)
    return parts.select("*", *(c.over(whole).alias(k) for k, c in columns.items()))


def held_by_several(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, _salt, first) of salted rows: the smallest `by` of each key that has more than one, for each salt of the key.

    Rows join it on keys and _salt, so that no task meets all rows of a hot key.
    """
    parts = rows.groupBy(*keys, "_salt").agg(F.min(by).alias("_low"), F.max(by).alias("_high"))
    return over_salts(parts, keys, first=F.min("_low"), _last=F.max("_high")).where("first < _last").select(*keys, "_salt", "first")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows left-joined to table, which has one row for each key; rows of a hot key are dealt by a salt of the column by."""
    own = salted(rows, by)
    wanted = own.select(*keys, "_salt").distinct().join(table, keys)
    return own.join(wanted, [*keys, "_salt"], "left").drop("_salt")


def with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m) of edges (a, b): m is the smallest b of each a."""
    own = salted(edges.select("a", "b"), "b")
    least = over_salts(own.groupBy("a", "_salt").agg(F.min("b").alias("_low")), ["a"], m=F.min("_low")).select("a", "_salt", "m")
    return own.join(least, ["a", "_salt"]).select("a", "b", "m")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node it reaches.

    Alternating large and small stars until every node but the smallest of each component has one edge, to that one:
    each round is aggregations with map-side minimums and equi-joins, salted since one node may have most of the edges,
    and the number of rounds grows with the logarithm of a component's size.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if is_star_forest(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        # Every node now points downwards; its other lower neighbours and itself move to the lowest.
        low = with_least(large)
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, edges = edges, saved(small.where("a <> b").distinct())
        discard(before)
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def is_star_forest(edges: DataFrame) -> bool:
    """Whether each a of the distinct edges (a, b) has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("b", F.lit(0).alias("up"), F.lit(1).alias("down")).toDF("node", "up", "down"))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def filter_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) * P % np.uint64(bits)).astype(np.int64)


def in_filter(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        a, b = filter_places(h, len(table) * 8)
    return (table[a >> 3] >> (a & 7) & 1).astype(bool) & (table[b >> 3] >> (b & 7) & 1).astype(bool)


def bloom_filter(items: DataFrame, among: np.ndarray | None = None) -> np.ndarray:
    """The filter of the h column, merged from filters of its partitions; with another filter, of the rows whose column `in` that one has."""
    sent = None if among is None else items.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]):
        table = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            if sent is not None:
                own = own[in_filter(sent.value, batch.column(1).to_numpy().view(np.uint64))]
            with np.errstate(over="ignore"):
                places = np.concatenate(filter_places(own, FILTER_BITS))
            np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
        at = np.nonzero(table)[0]
        yield {"at": at.astype(np.int32), "bits": table[at].astype(np.int32)}

    merged = map_arrow(items.select("h", *([] if among is None else ["in"])), run, struct("at int, bits int")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[merged["at"].to_numpy()] = merged["bits"].to_numpy().astype(np.uint8)
    return table


def likely(df: DataFrame, keys: DataFrame, df_col: str, keys_col: str) -> DataFrame:
    """The rows of df whose long df_col may be among keys: all that are, and few others. Nothing is shuffled."""
    bits = df.sparkSession.sparkContext.broadcast(bloom_filter(keys.select(F.xxhash64(keys_col).alias("h"))))
    at = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hit = np.nonzero(in_filter(bits.value, batch.column(at).to_numpy().view(np.uint64)))[0]
            yield batch.take(pa.array(hit)).select(range(at))

    return map_arrow(df.withColumn("_key_hash", F.xxhash64(df_col)), run, df.schema)
