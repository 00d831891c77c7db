"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, and the components they form.

The document by n-gram incidence matrix is cut into blocks of columns. Each task multiplies one block with
its transpose as far as size bounds leave anything to add up:

1. Equal sets are one class; a class meets the others once.
2. Blocked product, first pass: each block tells for each class how many of its n-grams any other class
   has. The sum over the blocks bounds every overlap of the class from above. Classes whose sum is below
   `threshold` of their size link with nothing and are done: most of a corpus ends here. A slice of documents
   sends an n-gram that several of its classes have once, with their counts, so that a block does not grow with
   the holders of a very common n-gram but with the slices that have it.
3. Among the rest a pair that links shares an n-gram within the first size - ceil(threshold * size) + 1 of
   both sets, in an order that puts rare n-grams first (by a counter array of fixed size, then by hash: any
   order is right, a good one proposes little). Where i n-grams of a set come before the first that it shares, at
   most size - i are common, which bounds the size of the other set. Two holders of an n-gram join one candidate
   group if the bounds of both allow it; an n-gram of more than HOLDERS is cut where no bound reaches over a gap
   in the sizes. Without this, chains of sets that cannot link ran together into one group on larger corpora.
4. Second product: a candidate group's rows are dealt to tiles of about TILE documents. Products are exact, a
   column block at a time; pairs below what their sizes ask for are discarded, and a product yields a spanning
   forest of its links instead of the links themselves. First every tile is multiplied with itself and the
   group's first tile. Documents that are then of the group's largest component are linked already and need no
   product among themselves: only the others are multiplied with the rest of the group.

So nothing is ever a row for each pair: classes, entries, tiles and forests are linear in the documents. A large
group of near copies is one component after the first products, whose number is that of its tiles. Where a group
falls apart, the m documents beyond its largest component meet all n of it, in m * n / (WIDE * TILE) ** 2 products of
tiles WIDE times as large. Components of the forests are the result.

Words are runs of characters other than ASCII white space, A-Z lower-cased. A text of fewer than n words
has one n-gram, the whole sequence. Defined results: null, empty and blank texts have no n-grams and link
with nothing; of rows with one id that with the smallest digest stands for all; rows without an id are
left out; the n-grams of a text of any length are one set, in one row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import id_and_text, map_arrow, runs_of_chars, struct, trimmed
from .shared import bloom_filter, connected_components, discard, in_filter, likely, saved, spread_join

#: Characters that are cut into n-grams at a time, about.
RUN = 500_000
#: N-grams of a column block, about.
BLOCK = 2_000_000
#: Documents and n-grams of a tile at most, about, and columns multiplied at a time.
TILE, TILE_GRAMS, COLUMNS = 512, 500_000, 1024
#: Pairs of rows that are added up at a time, and multiplications of a dense column that take as long as one such pair, about.
PAIRS, DENSE = 1_000_000, 300
#: Rows of a tile whose links are read at a time.
ROWS = 128
#: Times as many in a tile of the second products, where every tile meets many others; prefix n-grams of a slice and of a block, about; holders of one that meet pair by pair.
WIDE, ENTRIES, HOLDERS = 4, 500_000, 32
#: Cells of the counter array that orders n-grams by rarity.
CELLS = 1 << 18
#: N-grams and classes of a slice at most, about, and the number that stands for several of its classes.
SLICE_GRAMS, SHARD, COMMON = 1_500_000, 16_384, 0xFFFF
P = np.uint64(0x9E3779B97F4A7C15)


BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: A random 64-bit value for each byte, A-Z as a-z; and which bytes are white space.
BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
BYTES[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, at least n of them."""
    if len(_POWERS.get(base, ())) < n:
        table = np.full(max(n, 1 << 20), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n > 1 << 20:  # of a very long text: not kept
            return table
        _POWERS[base] = table
    return _POWERS[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts, in order, and the number of words of each text.

    A word's hash is a polynomial over its bytes, the difference of two prefix sums.
    """
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    inside = ~SPACE[data]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(BASE, len(data))[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data))[starts])
    offsets = np.cumsum([0, *(len(c) + 1 for c in coded)])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def ngram_sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    grams = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        grams *= P
        grams += words[k : k + len(grams)]
    grams = mixed(grams)
    sets = []
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = h * P + w
            sets.append(mixed(h))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def set_rows(n: int, emit):
    """The map over (doc_id, text) whose emit gets the ids and the sets of about half a million characters."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, texts in runs_of_chars(batch.column(0).to_pylist(), batch.column(1).to_pylist(), RUN):
                yield from emit(ids, ngram_sets_of(texts, n))

    return run


def digests(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): the size and a 128-bit digest of each document's set."""

    def emit(ids, sets):
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
        yield {"doc_id": ids, "n_shingles": [len(s) for s in sets], "k1": pa.array(np.ascontiguousarray(keys[:, 0])), "k2": pa.array(np.ascontiguousarray(keys[:, 1]))}

    return map_arrow(docs, set_rows(n, emit), struct("doc_id long, n_shingles long, k1 long, k2 long"))


def dropping(gone: DataFrame, kept: DataFrame, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two filters by which a scan drops most of the ids gone, of those that are among a filter, and none of the ids kept: of the first, but not of the second."""
    h = F.xxhash64("doc_id")
    first = bloom_filter(gone.select(h.alias("h"), h.alias("in")), among)
    return first, bloom_filter(kept.select(F.xxhash64("doc_id", F.lit(1)).alias("h"), h.alias("in")), first)


def with_hashes(docs: DataFrame) -> DataFrame:
    """docs with the two hashes of the id that filters ask for."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h1"), F.xxhash64("doc_id", F.lit(1)).alias("h2"))


def dropped(filters: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
    first, second = (batch.column(k).to_numpy().view(np.uint64) for k in (2, 3))
    return in_filter(filters[0], first) & ~in_filter(filters[1], second)


def two_planes(numbers: np.ndarray) -> bytes:
    """Numbers of 16 bits, the low bytes first: the high ones of sorted numbers are runs, which compress."""
    return numbers.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def slice_rows(docs: DataFrame, n: int, blocks: int, copies: DataFrame, reps: DataFrame) -> DataFrame:
    """(block, slice, grams, owners, classes, shared): what the slices of docs send the blocks."""
    sent = docs.sparkSession.sparkContext.broadcast(dropping(copies, reps))

    def rows_of(by_key: dict[bytes, np.ndarray]):
        keys = list(by_key)
        h = np.concatenate(list(by_key.values()))
        own = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(s) for s in by_key.values()])
        column = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64) << 24 | (h & np.uint64(0xFFFFFF)).astype(np.int64)
        order = np.argsort(column, kind="stable")
        column, own = column[order], own[order]
        same = column[1:] == column[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        shared = np.bincount(own[several], minlength=len(keys)).astype("<u4")
        sending = np.concatenate([[True], ~same])
        own[several] = COMMON
        column, own = column[sending], own[sending]
        order = np.lexsort((own, column >> 24))
        column, own = column[order], own[order]
        low = (column & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        ends = np.searchsorted(column >> 24, np.arange(blocks + 1))
        some = np.nonzero(np.diff(ends))[0]
        joined = b"".join(keys)
        none = [b""] * (len(some) - 1)
        yield {
            "block": some.astype(np.int32),
            "slice": np.full(len(some), int.from_bytes(xxhash.xxh3_64_digest(joined), "little", signed=True)),
            "grams": [low[ends[b] : ends[b + 1]].tobytes() for b in some],
            "owners": [two_planes(own[ends[b] : ends[b + 1]]) for b in some],
            "classes": [joined, *none],
            "shared": [shared.tobytes(), *none],
        }

    def cut_rows(batches: Iterator[pa.RecordBatch]):
        by_key, size = {}, 0
        for batch in batches:
            some = batch.filter(pa.array(~dropped(sent.value, batch)))
            for _, texts in runs_of_chars(some.column(0).to_pylist(), some.column(1).to_pylist(), RUN):
                for s in ngram_sets_of(texts, n):
                    if len(s):
                        by_key[xxhash.xxh3_128_digest(s.tobytes())[:8]] = s  # a class once
                        size += len(s)
                    if size >= SLICE_GRAMS or len(by_key) >= SHARD:
                        yield from rows_of(by_key)
                        by_key, size = {}, 0
        if by_key:
            yield from rows_of(by_key)

    return map_arrow(with_hashes(docs), cut_rows, struct("block int, slice long, grams binary, owners binary, classes binary, shared binary"))


def shared_counts(docs: DataFrame, n: int, blocks: int, copies: DataFrame, reps: DataFrame) -> DataFrame:
    """(k1, shared): for each class an upper bound of the n-grams that other classes have too.

    Of a class mostly its representative is counted: copies are dropped in the scan; one that is not only raises the
    bound. A slice sends a block 24 bits of each n-gram and a number of its class in the slice, so a row costs the
    same however many blocks there are; the classes of a slice go with its row of one block, and a block answers with
    their numbers. What collides only raises the bound. Classes of which no n-gram is shared have no row.
    """

    def multiply(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(rows["grams"]), np.uint8).reshape(-1, 3).astype(np.uint32)
        column = data[:, 0] | data[:, 1] << 8 | data[:, 2] << 16
        del data
        # A slice sends an n-gram once: what is there twice is shared with another slice.
        order = np.sort(column)
        twice = np.zeros(1 << 24, bool)
        twice[order[1:][order[1:] == order[:-1]]] = True
        hit = twice[column]
        at, found = 0, []
        for size, owners in zip(rows["grams"].map(len), rows["owners"]):
            own = from_planes(owners)[hit[at : at + size // 3]]
            found.append(two_planes(own[own != COMMON]))
            at += size // 3
        out = pd.DataFrame({"slice": rows["slice"].to_numpy(), "owners": found, "classes": rows["classes"].to_numpy(), "shared": rows["shared"].to_numpy()})
        return out[(out["owners"].map(len) > 0) | (out["classes"].map(len) > 0)]

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows["classes"].map(len).to_numpy() > 0
        keys = np.frombuffer(rows["classes"][whole].iloc[0], "<i8")
        shared = np.frombuffer(rows["shared"][whole].iloc[0], "<u4").astype(np.int64)
        for owners in rows["owners"]:
            shared += np.bincount(from_planes(owners), minlength=len(keys))
        return pd.DataFrame({"k1": keys, "shared": shared})[shared > 0]

    products = slice_rows(docs, n, blocks, copies, reps).groupBy("block").applyInPandas(trimmed(multiply), "slice long, owners binary, classes binary, shared binary")
    return products.groupBy("slice").applyInPandas(trimmed(add), "k1 long, shared long").groupBy("k1").agg(F.max("shared").alias("shared"))


def ngram_sets(docs: DataFrame, n: int, wanted: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, k1, set) of the documents in wanted (doc_id, k1): sorted distinct hashes, little-endian.

    Filters of fixed size pick them in the scan, so that neither texts nor sets are shuffled. A few other rows may pass,
    or a row of a wanted id that has another digest: whoever reads the table joins it by id and k1.
    """
    context = docs.sparkSession.sparkContext
    first = bloom_filter(wanted.select(F.xxhash64("doc_id").alias("h")))
    others = table.join(wanted, "doc_id", "left_anti")
    bits = context.broadcast((first, *dropping(others, wanted, first)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hit = in_filter(bits.value[0], batch.column(2).to_numpy().view(np.uint64)) & ~dropped(bits.value[1:], batch)
            some = batch.filter(pa.array(hit))
            for ids, texts in runs_of_chars(some.column(0).to_pylist(), some.column(1).to_pylist(), RUN):
                sets = ngram_sets_of(texts, n)
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes())[:8] for s in sets), "<i8")
                yield {"doc_id": ids, "k1": pa.array(keys), "set": [s.tobytes() for s in sets]}

    return map_arrow(with_hashes(docs), run, struct("doc_id long, k1 long, set binary"))


def rarity(sets: DataFrame) -> np.ndarray:
    """How many n-grams of the sets fall into each cell of the counter array."""

    def run(batches: Iterator[pa.RecordBatch]):
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            for a in range(0, len(own), 4_000_000):
                cells += np.bincount((own[a : a + 4_000_000] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.nonzero(cells)[0]
        yield {"cell": at.astype(np.int32), "n": cells[at]}

    found = map_arrow(sets.select("set"), run, struct("cell int, n long")).groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    cells = np.zeros(CELLS, np.int64)
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    return cells


def proposals(sets: DataFrame, cells: np.ndarray, blocks: int, p: int, q: int) -> DataFrame:
    """(a, b): documents that may link, as forests: a linked pair is connected by them.

    A slice of about ENTRIES n-grams sends a block 48 bits of each n-gram, its holder, the holder's size and the largest
    size that may link with it by this n-gram. Where more than HOLDERS of a slice hold one, those of about one size are
    linked there and sent as one. What collides or is sent as one only proposes more.
    """
    sent = sets.sparkSession.sparkContext.broadcast(cells)
    step = np.log(q / p) / 8  # the width of a band of sizes

    def rows_of(h, own, size, most):
        pairs = np.empty((0, 2), np.int64)
        order = np.argsort(h, kind="stable")
        h, own, size, most = h[order], own[order], size[order], most[order]
        _, at, count = np.unique(h, return_inverse=True, return_counts=True)
        many = count[at] > HOLDERS
        if many.any():
            band = np.where(many, (np.log(size) / step).astype(np.int64), -1 - np.arange(len(h)))
            order = np.lexsort((own, band, h))
            h, own, size, most, band = h[order], own[order], size[order], most[order], band[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (band[1:] != band[:-1])])
            begins = np.nonzero(first)[0]
            least = own[begins][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([own, least], 1)[own != least], axis=0)
            h, own, size, most = h[begins], own[begins], np.minimum.reduceat(size, begins), np.maximum.reduceat(most, begins)
        block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        h, own, size, most = h[order], own[order], size[order], most[order]
        ends = np.searchsorted(block[order], np.arange(blocks + 1))
        some = np.nonzero(np.diff(ends))[0]
        low = h.view(np.uint8).reshape(-1, 8)[:, :6]
        cut = lambda x: [x[ends[b] : ends[b + 1]].tobytes() for b in some]
        yield {"block": some.astype(np.int32), "grams": cut(low), "own": cut(own), "size": cut(size.astype("<u4")), "most": cut(most.astype("<u4")), "pairs": [pairs.tobytes(), *[b""] * (len(some) - 1)]}

    def cut_rows(batches: Iterator[pa.RecordBatch]):
        found, n = [], 0
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(x, "<u8")
                keep = len(h) + (-len(h) * p) // q + 1  # size - ceil(size * p / q) + 1
                order = np.argsort(sent.value[(h % np.uint64(CELLS)).astype(np.int64)], kind="stable")[:keep]
                # overlap * (p + q) >= p * (size + other), where the overlap is at most size - place.
                most = np.minimum((q * len(h) - (p + q) * np.arange(len(order))) // p, 0xFFFFFFFF)
                found.append((h[order], np.full(len(order), doc_id, np.int64), np.full(len(order), len(h), np.int64), most))
                n += len(order)
                if n >= ENTRIES:
                    yield from rows_of(*map(np.concatenate, zip(*found)))
                    found, n = [], 0
        if found:
            yield from rows_of(*map(np.concatenate, zip(*found)))

    def propose(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(rows["grams"]), np.uint8).reshape(-1, 6)
        h = np.zeros((len(data), 8), np.uint8)
        h[:, :6] = data
        h = h.view("<u8").ravel()
        own, pairs = (np.frombuffer(b"".join(rows[c]), "<i8") for c in ("own", "pairs"))
        size, most = (np.frombuffer(b"".join(rows[c]), "<u4") for c in ("size", "most"))
        order = np.lexsort((size, h))
        h, own, size, most = h[order], own[order], size[order], most[order]
        ids, at = np.unique(np.concatenate([own, pairs]), return_inverse=True)
        own, tails, heads = at[: len(own)], [at[len(own) :: 2]], [at[len(own) + 1 :: 2]]
        group = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))
        hot = np.bincount(group)[group] > HOLDERS
        # Of many holders: each with the one before in order of size, if any before it may reach it.
        reach = np.maximum.accumulate(group << 32 | most)
        next_ = np.nonzero(hot[1:] & (group[1:] == group[:-1]) & (size[1:] <= (reach[:-1] & 0xFFFFFFFF)))[0] + 1
        tails.append(own[next_])
        heads.append(own[next_ - 1])
        # Of few: all pairs, by their distance in that order.
        near = np.nonzero(~hot)[0]
        for d in range(1, HOLDERS):
            near = near[near + d < len(h)]
            near = near[group[near] == group[np.minimum(near + d, len(h) - 1)]]
            may = near[(size[near + d] <= most[near]) & (size[near] <= most[near + d])]
            label = forest(own[may + d], own[may], len(ids))
            tails.append(np.nonzero(label != np.arange(len(ids)))[0])
            heads.append(label[tails[-1]])
            if not len(near):
                break
        label = forest(np.concatenate(tails), np.concatenate(heads), len(ids))
        at = np.nonzero(label != np.arange(len(ids)))[0]
        return pd.DataFrame({"a": ids[at], "b": ids[label[at]]})

    rows = map_arrow(sets.select("doc_id", "set"), cut_rows, struct("block int, grams binary, own binary, size binary, most binary, pairs binary"))
    return rows.groupBy("block").applyInPandas(trimmed(propose), "a long, b long")


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node it reaches by the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(overlap: np.ndarray, left: np.ndarray, right: np.ndarray, p: int, q: int) -> np.ndarray:
    """Where sets of these sizes and overlaps reach a Jaccard similarity of p / q: in whole numbers, which no size rounds."""
    return overlap.astype(np.int64) * (p + q) >= p * (left.astype(np.int64)[:, None] + right.astype(np.int64)[None])


def tile_links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links between the rows at left and those at right, which may meet.

    Columns that few rows have add one to each pair of them; the others, which a group of near copies shares, are
    multiplied as dense blocks.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    del order
    column = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]), dtype=np.int32)
    del h
    held = np.bincount(column)[column] > 1  # a column with one row adds to no pair
    row, column = row[held], column[held]
    overlap = np.zeros((len(left), len(right)), np.int32)
    if len(row):
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]]), dtype=np.int32)
        width = int(column[-1]) + 1
        sides = []
        for own in (left, right):
            place = np.full(n, -1, np.int32)
            place[own] = np.arange(len(own), dtype=np.int32)
            at = place[row]
            sides.append((column[at >= 0], at[at >= 0], np.bincount(column[at >= 0], minlength=width)))
        (l_column, l_row, l_count), (r_column, r_row, r_count) = sides
        dense = l_count * r_count * DENSE >= overlap.size
        # Sparse columns: each entry on the left with those of its column on the right, PAIRS at a time.
        few = ~dense[l_column]
        own_column, own_row = l_column[few], l_row[few].astype(np.int64)
        pairs, begins, flat = r_count[own_column], np.cumsum(r_count) - r_count, overlap.ravel()
        cuts = np.unique(np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum() + PAIRS, PAIRS), side="right"))
        for a, b in zip(cuts, cuts[1:]):
            some = pairs[a:b]
            at = np.repeat(begins[own_column[a:b]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            cell, count = np.unique(np.repeat(own_row[a:b] * len(right), some) + r_row[at], return_counts=True)
            flat[cell] += count.astype(np.int32)
        # Dense columns.
        number = np.cumsum(dense) - 1
        l_many, r_many = dense[l_column], dense[r_column]
        l_number, l_row, r_number, r_row = number[l_column[l_many]], l_row[l_many], number[r_column[r_many]], r_row[r_many]
        for first in range(0, int(dense.sum()), COLUMNS):
            blocks = []
            for numbers, rows, size in ((l_number, l_row, len(left)), (r_number, r_row, len(right))):
                a, b = np.searchsorted(numbers, [first, first + COLUMNS])
                block = np.zeros((size, COLUMNS), np.float32)
                block[rows[a:b], numbers[a:b] - first] = 1
                blocks.append(block)
            overlap += (blocks[0] @ blocks[1].T).astype(np.int32)
    # A slice of rows at a time: a group of near copies has a link in nearly every cell.
    tails, heads = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first in range(0, len(left), ROWS):
        some = left[first : first + ROWS]
        i, j = np.nonzero(linked(overlap[first : first + ROWS], sizes[some], sizes[right], p, q))
        label = forest(some[i], right[j], n)
        tails.append(np.nonzero(label != np.arange(n))[0])
        heads.append(label[tails[-1]])
    label = forest(np.concatenate(tails), np.concatenate(heads), n)
    at = np.nonzero(label != np.arange(n))[0]
    return ids[at], ids[label[at]]


def products(sets: DataFrame, dealt: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): spanning forests of the links of each (label, i, j) between the rows with side 0 and all rows. dealt: doc_id, k1, label, i, j, side."""
    rows = sets.join(dealt, ["doc_id", "k1"]).select("label", "i", "j", "side", "doc_id", "set")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "side"]).drop_duplicates("doc_id")  # a row on both sides, or repeated, is one row
        left = np.nonzero(group["side"].to_numpy() == 0)[0]
        a, b = tile_links(group["doc_id"].to_numpy(), [np.frombuffer(x, "<u8") for x in group["set"]], left, np.arange(len(group)), p, q) if len(left) else (np.empty(0, np.int64),) * 2
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("label", "i", "j").applyInPandas(trimmed(run), "a long, b long")


def tiles(rows: DataFrame, into: str, wide: int = 1) -> DataFrame:
    """rows (node, k1, label, size) with `into`, the tile of the row in its label, and its number of tiles in `into`_n."""
    counts = rows.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / (wide * TILE)), F.ceil(F.sum("size") / (wide * TILE_GRAMS))).cast("int").alias(f"{into}_n"))
    return spread_join(rows, counts, ["label"], "node").withColumn(into, F.pmod(F.xxhash64("node"), F.col(f"{into}_n")).cast("int"))


def linked_in_groups(sets: DataFrame, groups: DataFrame, rest: DataFrame, p: int, q: int) -> DataFrame:
    """(node, label): the components of the links within candidate groups (node, label) of several documents. rest: (doc_id, k1, size) of those that count."""
    sized = groups.join(rest.withColumnRenamed("doc_id", "node"), "node").select("node", "k1", "label", "size")
    dealt = saved(tiles(sized, "tile"))
    one = lambda n: F.lit(n).alias
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias
    # Every tile meets itself and the first tile. Only ids are dealt by label; the sets join by id.
    node = F.col("node").alias("doc_id")
    own = dealt.select(node, "k1", "label", one(0)("i"), F.col("tile").alias("j"), one(0)("side"))
    first = dealt.where("tile = 0 and tile_n > 1").select(node, "k1", "label", one(0)("i"), each("tile_n")("j"), one(1)("side")).where("j > 0")
    links = saved(products(sets, own.unionByName(first), p, q))
    parts = connected_components(links)
    several = dealt.where("tile_n > 1").select("node", "k1", "label", "size")
    if several.isEmpty():
        discard(dealt)
        return parts
    # What is not of the largest component of a group of several tiles meets all of the group.
    placed = several.join(parts.withColumnRenamed("label", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = placed.groupBy("label", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("label").agg(F.max_by("part", F.struct("n", F.negative("part"))).alias("largest"))
    others = saved(tiles(spread_join(placed, largest, ["label"], "node").where("part <> largest").select("node", "k1", "label", "size"), "other", WIDE))
    if others.isEmpty():
        discard(dealt, others)
        return parts
    whole = saved(tiles(spread_join(several, others.select("label", "other_n").distinct(), ["label"], "node").where("other_n is not null"), "whole", WIDE))
    many = spread_join(others, whole.select("label", "whole_n").distinct(), ["label"], "node")
    left = many.select(node, "k1", "label", F.col("other").alias("i"), each("whole_n")("j"), one(0)("side"))
    right = whole.select(node, "k1", "label", each("other_n")("i"), F.col("whole").alias("j"), one(1)("side"))
    more = saved(products(likely(sets, whole, "doc_id", "node"), left.unionByName(right), p, q))
    joined = connected_components(links.unionByName(more))
    discard(dealt, others, whole, links, more)
    return joined


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document: the smallest id reachable by links."""
    docs = id_and_text(df, id_col, text_col).where("doc_id is not null")
    p, q = threshold.numerator, threshold.denominator
    table = digests(docs, n).groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("d"))
    table = saved(table.select("doc_id", "d.*"))
    classes = table.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"))
    total = table.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    reps = classes.select(F.col("rep").alias("doc_id"))
    copies = table.where("n_shingles > 0").select("doc_id").join(reps, "doc_id", "left_anti")
    bound = shared_counts(docs, n, max(1, -(-total // BLOCK)), copies, reps)
    rest = saved(classes.join(bound, "k1").where(F.col("shared") * q >= F.col("size") * p).select(F.col("rep").alias("doc_id"), "k1", "size"))
    sets = saved(ngram_sets(docs, n, rest.select("doc_id", "k1"), table.select("doc_id")))
    entries = rest.agg(F.coalesce(F.sum(F.col("size") - F.ceil(F.col("size") * p / q) + 1), F.lit(0))).first()[0]
    proposed = proposals(sets, rarity(sets), max(1, -(-entries // ENTRIES)), p, q)
    final = saved(linked_in_groups(sets, connected_components(proposed), rest, p, q))
    discard(rest, sets)
    members = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component"))
    return spread_join(table, members, ["k1", "k2"], "doc_id").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id")).alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df whose id is the smallest of its component, and rows without an id."""
    parts = jaccard_components(df, id_col=id_col, **options)
    gone = parts.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return df.join(gone, df[id_col].cast("long") == gone["_gone"], "left_anti")
