"""Benchmark decontamination by template windows.

Words are canonicalised to a template: numbers, units and names (capitalised words inside a sentence)
become typed placeholders, other words lose their case and outer punctuation. What counts as a name depends on
the words around it, so windows with names also stand in a second form without. Windows of WINDOW template
words of the documents are hash-joined with those of the benchmark; shorter items are one window of their
own length. A joined pair of windows must be consistent: within a document and item, each slot value of
the item stands for one value of the document and the reverse, so re-parameterised questions match and
chance tables of numbers do not. Windows of fewer than PLAIN_WORDS plain words say too little as templates:
they are joined by their literal words, values included. A document is contaminated by an item if consistent
windows cover at least `share` of the item's template windows, or of all its windows.

A Bloom filter of the benchmark's windows, of fixed size, is broadcast so that only windows
likely to join leave the scan; the join itself is exact, on 64-bit hashes and the window's canonical words.

Defined results: null text counts as empty and matches nothing; items of fewer than WINDOW words, none of them but
numbers and units, are not searched for, since any table of numbers would hold them; longer ones are, by their
literal words; every row of documents, and every row of items, is judged by its own text, also without an id, and an id
is contaminated if one of its rows is; a text of any length is searched whole; an empty benchmark keeps every document,
an empty table of documents gives an empty result; extra columns pass through `drop_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import id_and_text, map_arrow, runs_of_chars, struct
from .shared import bloom_filter, in_filter, saved

WINDOW, PLAIN_WORDS = 8, 4
SPACE = " \t\n\r\x0b\x0c"
#: Words whose canonical forms a Python worker keeps; the cache only saves time.
CACHE_WORDS = 250_000
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?$")
# Units of measure.
UNITS = frozenset("""mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hrs day days week weeks month months year years
second seconds minute minutes hour hours meter meters metre metres kilometer kilometers mile miles gram grams kilogram
kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit hz khz mhz
w kw v a n pa j kj cal kcal mph kmh usd eur gbp""".split())
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3
SLOT_NAMES = ("", "<number>", "<unit>", "<name>")
SLOT_HASH = np.array([0, *(xxhash.xxh3_64_intdigest(s) for s in SLOT_NAMES[1:])], np.uint64)
P = np.uint64(0x9E3779B97F4A7C15)
#: What may stand around a word, without the signs that belong to a value.
AROUND = "\"'()[]{}<>.,;:!?*|#&`~“”‘’«»¿¡…–—"
LITERAL = np.uint64(1 << 32)  # tells the hashes of literal windows from those of templates


def slot_value(word: str) -> str:
    """The value of a number or unit without the punctuation, quotes, brackets and Markdown signs around it; currency, percent and minus stay."""
    core = word.strip(AROUND)
    if len(core) > 2 and core[0] == core[-1] == "$":
        core = core[1:-1]
    return (core.rstrip("-").strip(AROUND) or word).lower()


def core(word: str) -> str:
    """A word without the signs around it."""
    return word.strip(AROUND + "%$-") or word


class Words(dict):
    """word -> its row in rows: hash of the plain form, kind, capitalised, ends a sentence."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, bool, bool]] = []

    def __missing__(self, word: str) -> int:
        bare = core(word)
        low = bare.lower()
        kind = NUM if NUMBER.match(bare) else UNIT if low in UNITS else PLAIN
        self.rows.append((xxhash.xxh3_64_intdigest(low), kind, bare[:1].isupper() and not (len(bare) > 1 and bare.isupper()), word[-1] in ".!?:|\"”"))
        self[word] = len(self.rows) - 1
        return self[word]


def canonical(texts: list[str], cache: Words) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, where each text's words begin, and each word's template hash, kind, hash if it is no name, and literal hash."""
    if len(cache.rows) > CACHE_WORDS:
        cache.clear()
        cache.rows = []
    split = [t.split() for t in texts]
    words = [w for own in split for w in own]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
    index = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    used, index = np.unique(index, return_inverse=True)
    rows = [cache.rows[k] for k in used.tolist()]
    hashes = np.array([r[0] for r in rows], np.uint64)[index] if rows else np.empty(0, np.uint64)
    kind = np.array([r[1] for r in rows], np.int8)[index] if rows else np.empty(0, np.int8)
    if rows:
        capital, ends = np.array([r[2] for r in rows], bool)[index], np.array([r[3] for r in rows], bool)[index]
        inside = np.concatenate([[False], ~ends[:-1]])
        inside[starts[:-1][starts[:-1] < len(words)]] = False
        plain = np.where(kind == PLAIN, hashes, SLOT_HASH[kind])
        kind = np.where(capital & inside & (kind == PLAIN), NAME, kind)
        return words, starts, np.where(kind == NAME, SLOT_HASH[NAME], plain), kind, plain, hashes
    return words, starts, hashes, kind, hashes, hashes


def literal_windows(hashes: np.ndarray, unnamed: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and literal hashes of the windows of `size` words within the texts that have too few plain words, names counted as plain."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    plain = np.concatenate([[0], np.cumsum(unnamed == PLAIN)])
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.nonzero((plain[size:] - plain[:n] < min(PLAIN_WORDS, size)) & (text[:n] == text[size - 1 :]))[0]
    with np.errstate(over="ignore"):
        h = np.full(len(at), LITERAL + np.uint64(size), np.uint64)
        for k in range(size):
            h = h * P + hashes[at + k]
            h ^= h >> np.uint64(29)
    return at, h


def windows(hashes: np.ndarray, kind: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of `size` words within the texts that have enough plain words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = h * P + hashes[k : k + n]
            h ^= h >> np.uint64(29)
    plain = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    enough = plain[size:] - plain[:n] >= min(PLAIN_WORDS, size)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.nonzero(enough & (text[:n] == text[size - 1 :]))[0]
    return at, h[at]


def with_key(df: DataFrame) -> DataFrame:
    """(doc_id, text, key) of (doc_id, text): the key tells rows of one id, and rows without one, apart by their text."""
    return df.withColumn("key", F.xxhash64("text"))


def window_rows(df: DataFrame, sizes: list[int] | None, bloom=None) -> DataFrame:
    """(id, key, pos, size, h, literal, form, slots) of the windows of (doc_id, text, key); sizes None: of items, WINDOW or a short text's own length.

    form is the window's canonical words, slots are the values in the place of its numbers, units and names.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        cache = Words()
        bits = None if bloom is None else bloom.value
        for batch in batches:
            for rows, texts in runs_of_chars(list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())), batch.column(1).to_pylist()):
                words, starts, hashes, kind, plain, literal = canonical(texts, cache)
                out = {"id": [], "key": [], "pos": [], "size": [], "h": [], "literal": [], "form": [], "slots": []}
                lengths = np.diff(starts)
                unnamed = np.where(kind == NAME, PLAIN, kind)
                named = np.concatenate([[0], np.cumsum(kind == NAME)])
                wordy = np.concatenate([[0], np.cumsum(unnamed == PLAIN)])
                wordy = wordy[starts[1:]] > wordy[starts[:-1]]
                for size in sizes if sizes is not None else sorted({WINDOW, *(int(x) for x in lengths if 0 < x < WINDOW)}):
                    for forms, kinds in ((hashes, kind), (plain, unnamed), (literal, None)):
                        at, h = windows(forms, kinds, starts, size) if kinds is not None else literal_windows(forms, unnamed, starts, size)
                        keep = np.ones(len(at), bool) if kinds is not unnamed else named[at + size] > named[at]  # the second form only where it differs
                        text = np.searchsorted(starts, at, side="right") - 1
                        if sizes is None and size < WINDOW:
                            keep &= lengths[text] == size
                        if sizes is None and kinds is None:
                            keep &= wordy[text] | (lengths[text] >= WINDOW)
                        if bits is not None:
                            keep &= in_filter(bits, h)
                        at, h, text = at[keep], h[keep], text[keep]
                        out["id"] += [rows[k][0] for k in text.tolist()]
                        out["key"] += [rows[k][1] for k in text.tolist()]
                        out["pos"] += (at - starts[text]).tolist()
                        out["size"] += [size] * len(at)
                        out["h"] += h.view(np.int64).tolist()
                        out["literal"] += [kinds is None] * len(at)
                        out["form"] += [" ".join(core(words[k]).lower() if kinds is None or not kinds[k] else SLOT_NAMES[kinds[k]] for k in range(a, a + size)) for a in at.tolist()]
                        out["slots"] += [[] if kinds is None else [slot_value(words[k]) for k in range(a, a + size) if kinds[k]] for a in at.tolist()]
                yield out

    return map_arrow(df.select("doc_id", "text", "key"), run, struct("id long, key long, pos int, size int, h long, literal boolean, form string, slots array<string>"))


def judged_rows(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, share: float) -> DataFrame:
    """(doc_id, key, item_id, n_windows, covered) of each document row, told by its id and its text's key, and item with enough consistent windows."""
    items = window_rows(with_key(id_and_text(benchmark, item_col, item_text_col)), None)
    items = saved(items.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("pos").alias("item_pos"), "size", "h", "literal", "form", F.col("slots").alias("item_slots")))
    totals = items.groupBy("item_id", "item_key").agg(F.countDistinct("item_pos").alias("n_all"), F.countDistinct(F.when(~F.col("literal"), F.col("item_pos"))).alias("n_template"))
    totals = totals.select(F.col("item_id").alias("_item_id"), F.col("item_key").alias("_item_key"), "n_all", "n_template")
    sizes = sorted({r["size"] for r in items.select("size").distinct().collect()})  # at most WINDOW values
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(items))
    found = window_rows(with_key(id_and_text(docs, id_col, text_col)), sizes, bloom).withColumnRenamed("id", "doc_id")
    pairs = found.join(items, ["h", "size", "literal", "form"]).where(F.size("slots") == F.size("item_slots"))
    # A slot value of the item and the document's in its place, once for each document, item and place of the item.
    pair = ["doc_id", "key", "item_id", "item_key"]
    runs = pairs.groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("places"),
        F.collect_set(F.when(~F.col("literal"), F.col("item_pos"))).alias("template_places"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("slots"),
    )
    one_to_one = (F.size("slots") == F.size(F.array_distinct(F.col("slots.i")))) & (F.size("slots") == F.size(F.array_distinct(F.col("slots.d"))))
    distinct_places = lambda places: F.size(F.array_distinct(F.flatten(F.collect_list(places)))).cast("long")
    covered = runs.where(one_to_one).groupBy(*pair).agg(distinct_places("places").alias("all"), distinct_places("template_places").alias("template"))
    # Other values leave only the templates; a copy of a text with few of them shows in all windows.
    by_template = (F.col("n_template") > 0) & (F.col("template") >= F.lit(share) * F.col("n_template"))
    judged = covered.join(totals, F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item_key") == F.col("_item_key")))
    judged = judged.where(by_template | (F.col("all") >= F.lit(share) * F.col("n_all")))
    return judged.select("doc_id", "key", "item_id", F.when(by_template, F.col("n_template")).otherwise(F.col("n_all")).alias("n_windows"), F.when(by_template, F.col("template")).otherwise(F.col("all")).alias("covered"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_windows, covered) of each id and item with enough consistent windows in one of the id's rows; of several the most covered."""
    judged = judged_rows(docs, benchmark, id_col, text_col, item_col, item_text_col, share)
    most = F.max(F.struct((F.col("covered") / F.col("n_windows")).alias("share"), "covered", "n_windows")).alias("m")
    return judged.groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", "m.n_windows", "m.covered")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.5
) -> DataFrame:
    """The rows of docs whose id no benchmark item contaminates, and rows without an id whose text none does."""
    judged = judged_rows(docs, benchmark, id_col, text_col, item_col, item_text_col, share)
    gone = judged.select(F.col("doc_id").alias("_gone"), F.when(F.col("doc_id").isNull(), F.col("key")).alias("_gone_key")).distinct()
    own = docs[id_col].cast("long")
    own_key = F.when(own.isNull(), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    return docs.join(gone, own.eqNullSafe(gone["_gone"]) & own_key.eqNullSafe(gone["_gone_key"]), "left_anti")
