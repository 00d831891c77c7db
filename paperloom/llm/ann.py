"""Approximate nearest neighbours by inner product: an inverted file with an adaptive dimension scan.

Vectors are rotated by a random orthogonal matrix and dealt to the list of their nearest centroid. A
query probes its best lists. Within a list the rotated vectors are scanned in blocks of dimensions: after
each block the partial distance, scaled up, is an estimate of the whole one, and a candidate whose
estimate lies beyond the query's bound by more than `z` standard errors is abandoned. Survivors of all
blocks are scored exactly on the original vectors, in double precision.

The best k of the fit's sample are the first answers of a query and give it its first bound.

The number of lists to probe is the fewest that find `target_recall` of the sample's own neighbours.

The number of lists is the square root of the number of vectors, so that lists and scans grow alike with the table.

Fit: centroids, probes and first answers come from a sample, the vectors with the smallest hash of their id: PER_LIST
of them for each list, `fit_rows` at least and `most_fit_rows` at most (beyond a billion vectors the lists stay as many as
that bound trains). Every row is indexed, once: the index is kept in the shared folder. A list is cut into blocks of about
`block_rows` vectors and its queries into chunks of `query_rows`, so the hottest list never meets one task whole; each pair
of a block and a chunk is a task group of bounded size. The counts that the driver sees are one for each list.

Defined results: vectors that are null, zero, of another length than the fit's commonest, or that hold null
or non-finite components take no part, as queries or as candidates; equal scores are ordered by the
smaller id; a query gets all candidates if there are fewer than k; rows with the same id count once, with
their best score, and never answer that id; rows without an id take no part; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_io import map_arrow, struct
from .shared import saved

#: Sample vectors for each list, and centroids that are compared at a time.
PER_LIST, AT_A_TIME = 8, 4096
RESULT = "query_id long, vec_id long, score double"


def sound(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, n_lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means on distinct starting vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:n_lists]].copy()
    for _ in range(rounds):
        own = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    parts = (np.argmax(vectors[a : a + AT_A_TIME] @ centres.T - half, axis=1) for a in range(0, len(vectors), AT_A_TIME))
    return np.concatenate([*parts, np.empty(0, np.int64)])


def calibrated_probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float, asked: int = 512) -> int:
    """The fewest lists whose probing finds `target` of the sample's own k best neighbours of `asked` of its rows."""
    queries = sample[: max(1, min(asked, (1 << 23) // len(sample)))]
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(sample, centres)[best], 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1


def top_rows(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, best first, equal scores by smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def best_of_each(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Positions of the best score of each query and id."""
    order = np.lexsort((-scores, ids, query))
    q, i = query[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    return order[new]


def slack(used: int, dim: int, z: float) -> float:
    """How far beyond the bound an estimate from `used` of `dim` rotated dimensions may lie before its candidate is abandoned.

    The estimate's relative variance is 2 / used for a random direction, less what sampling without replacement takes off.
    """
    return 1 + z * math.sqrt(2 * (1 / used - 1 / dim))


def adaptive_scan(q_ids, queries, bounds, c_ids, cands, turn, k: int, z: float, step: int = 1024):
    """(query index, candidate id, score) of each query's k best ids that pass the tests, each with its best score.

    bounds: for each query a score that its k-th best neighbour reaches at least. The column blocks end at
    a half, three quarters and all of the dimensions; the first is one matrix product for all pairs.
    """
    dim = queries.shape[1]
    ends = sorted({max(1, dim // 2), max(1, dim * 3 // 4), dim})
    used = ends[0]
    rq, rc = (queries @ turn).astype(np.float32), (cands @ turn).astype(np.float32)
    q2, c2 = (queries**2).sum(1), (cands**2).sum(1)
    q2_used, c2_used = (rq[:, :used] ** 2).sum(1), (rc[:, :used] ** 2).sum(1)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    lowest = -2 * math.sqrt(q2.max(initial=0) * c2.max(initial=0)) - 1  # below every product
    bounds = np.where(np.isfinite(bounds), bounds, lowest)
    grow, wide = dim / used, slack(used, dim, z)
    rounding = 1e-5 * (grow + wide)  # single precision must not lose what lies at the bound
    for start in range(0, len(cands), step):
        part = slice(start, start + step)
        # |q - c|^2 on the used columns, scaled up, against |q - c|^2 at the bound: split into terms of q, of c and of both
        of_q = (q2_used * grow - wide * (q2 - 2 * bounds)).astype(np.float32)
        of_c = (c2_used[part] * grow - wide * c2[part]).astype(np.float32)
        both = (rq[:, :used] * np.float32(2 * grow)) @ rc[part, :used].T
        both -= of_c
        qi, ci = np.nonzero(both >= (of_q - rounding * (q2 + np.abs(bounds) + c2[part].max())).astype(np.float32)[:, None])
        ci = ci + start
        seen = q2_used[qi] + c2_used[ci] - (both[qi, ci - start] + of_c[ci - start]) / (2 * grow) * 2
        for a, b in zip(ends, ends[1:]):
            seen = seen + ((rq[qi, a:b] - rc[ci, a:b]) ** 2).sum(1)
            if b < dim:
                keep = seen * (dim / b) <= (q2[qi] + c2[ci] - 2 * bounds[qi]) * slack(b, dim, z) + rounding * (q2[qi] + c2[ci])
                qi, ci, seen = qi[keep], ci[keep], seen[keep]
        keep = q_ids[qi] != c_ids[ci]
        qi, ci = qi[keep], ci[keep]
        scores = (queries[qi] * cands[ci]).sum(1)
        keep = scores >= bounds[qi]
        merged = [np.concatenate(x) for x in zip(best, (qi[keep], c_ids[ci[keep]], scores[keep]))]
        once = best_of_each(*merged)
        merged = [x[once] for x in merged]
        top = top_rows(*merged, k)
        best = tuple(x[top] for x in merged)
        n = np.bincount(best[0], minlength=len(queries))
        full = np.nonzero(n >= k)[0]
        last = np.searchsorted(best[0], full, side="right") - 1
        bounds[full] = np.maximum(bounds[full], best[2][last])
    return best


def nearest_neighbours(
    df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = 16384, most_fit_rows: int = 1 << 18,
    target_recall: float = 0.95, z: float = 1.5, block_rows: int = 4096, query_rows: int = 1024, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of df found for each row of queries."""
    pick = lambda x: x.where(sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    base, asked = pick(df).where("vec_id is not null"), pick(queries).where("vec_id is not null")
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = max(fit_rows, min(most_fit_rows, PER_LIST * round(math.sqrt(base.count()))))
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toArrow()
    if not drawn.num_rows:
        return empty
    lengths = pc.list_value_length(drawn["v"])
    dim = Counter(lengths.to_pylist()).most_common(1)[0][0]
    drawn = drawn.filter(pc.equal(lengths, dim)).combine_chunks()
    sample_ids, at = np.unique(drawn["vec_id"].to_numpy(), return_index=True)  # an id once: repeats are no neighbours, and make no bound
    at = np.sort(at)
    sample_ids, sample = drawn["vec_id"].to_numpy()[at], np.asarray(pc.list_flatten(drawn["v"])).reshape(-1, dim)[at]
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    total = base.count()
    centres = centroids(sample, max(1, min(len(sample) // PER_LIST, round(math.sqrt(total)))), seed)
    turn = rotation(dim, seed)
    fitted = spark.sparkContext.broadcast((centres, turn, sample_ids[:4096], sample[:4096]))

    def unpack(batch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(1).flatten()).reshape(-1, dim)

    def assign(batches: Iterator):
        for batch in batches:
            ids, vectors = unpack(batch)
            yield {"vec_id": ids, "v": batch.column(1), "list": nearest(vectors, fitted.value[0]).astype(np.int32)}

    index = saved(map_arrow(base, assign, struct("vec_id long, v array<double>, list int")))
    # An id counts once, in the first of its lists, towards the ids that a query reaches.
    sizes, ids_of = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    held = index.groupBy("vec_id", "list").count().groupBy("vec_id").agg(F.min("list").alias("home"), F.collect_list(F.struct("list", "count")).alias("own"))
    held = held.select("home", F.inline("own")).groupBy("list").agg(F.sum("count").alias("n"), F.sum((F.col("list") == F.col("home")).cast("long")).alias("ids"))
    for r in held.collect():  # one row for each list
        sizes[r["list"]], ids_of[r["list"]] = r["n"], r["ids"]
    probes = calibrated_probes(sample, centres, k, target_recall)

    def seeds(own_ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of each query's k best in the sample."""
        _, _, ids0, sample = fitted.value
        scores = own @ sample.T
        scores[own_ids[:, None] == ids0[None]] = -np.inf
        near = min(len(ids0), 2 * k)
        at = np.argpartition(-scores, near - 1, axis=1)[:, :near]
        qi = np.repeat(np.arange(len(own)), near)
        ci = at.ravel()[finite := np.isfinite(np.take_along_axis(scores, at, 1).ravel())]
        qi = qi[finite]
        exact = (own[qi] * sample[ci]).sum(1)
        top = top_rows(qi, ids0[ci], exact, k)
        return qi[top], ids0[ci][top], exact[top]

    def first(batches: Iterator):
        for batch in batches:
            ids, vectors = unpack(batch)
            for a in range(0, len(ids), 512):
                qi, found, scores = seeds(ids[a : a + 512], vectors[a : a + 512])
                yield {"query_id": ids[a : a + 512][qi], "vec_id": found, "score": scores}

    at_a_time = max(1, min(512, (1 << 22) // len(centres)))

    def probe(batches: Iterator):
        centres = fitted.value[0]
        for batch in batches:
            ids, vectors = unpack(batch)
            for a in range(0, len(ids), at_a_time):
                own_ids, own = ids[a : a + at_a_time], vectors[a : a + at_a_time]
                si, _, scores = seeds(own_ids, own)
                bound = np.full(len(own), -np.inf)
                full = np.bincount(si, minlength=len(own)) >= k
                np.minimum.at(lowest := np.full(len(own), np.inf), si, scores)
                bound[full] = lowest[full]
                order = np.argsort(-(own @ centres.T), axis=1, kind="stable")
                reached = np.cumsum(ids_of[order], axis=1) - ids_of[order]
                near = (np.arange(order.shape[1])[None] < probes) | (reached <= 2 * k)
                yield {"query_id": own_ids, "bound": bound, "v": list(own), "lists": [o[n].astype(np.int32) for o, n in zip(order, near)]}

    probed = saved(map_arrow(asked, probe, struct("query_id long, bound double, v array<double>, lists array<int>"))).withColumn("list", F.explode("lists")).drop("lists")
    asks = np.zeros(len(centres), np.int64)
    for r in probed.groupBy("list").count().collect():  # one row for each list
        asks[r["list"]] = r["count"]
    blocks, chunks = np.maximum(1, -(-sizes // block_rows)), np.maximum(1, -(-asks // query_rows))
    plan = spark.createDataFrame([(i, int(b), int(c)) for i, (b, c) in enumerate(zip(blocks, chunks))], "list int, blocks int, chunks int")
    left = (
        probed.join(F.broadcast(plan), "list")  # one row for each list: at most most_fit_rows / PER_LIST
        .select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), "query_id", "bound", "v")
    )
    right = (
        index.join(F.broadcast(plan), "list")
        .select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "v")
    )

    def search(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(rows):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        q_ids = asks["query_id"].to_numpy()
        qi, ids, scores = adaptive_scan(q_ids, np.stack(asks["v"]), asks["bound"].to_numpy(), rows["vec_id"].to_numpy(), np.stack(rows["v"]), fitted.value[1], k, z)
        return pd.DataFrame({"query_id": q_ids[qi], "vec_id": ids, "score": scores})

    key = ["list", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, RESULT)
    found = found.unionByName(map_arrow(asked, first, struct(RESULT))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
