"""Quality classifier: an interpolated modified Kneser-Ney character model trained on trusted text.

Symbols are code points of any script: digits are one symbol, white space but the line feed another, and code points
beyond the basic plane share SPARE symbols. So the model has as many n-grams as the trusted text, which grows with it.

Counts are summed by n-gram, the counts of lower orders and contexts are derived from them, and probabilities come from
joins of n-grams with their contexts and suffixes, all in shards of a shuffle. The finished table is cut into shards
of about SHARD entries by the two symbols before the last, so that all entries a position needs are in one; entries of
one or two symbols are in each. Documents join one shard at a time, which a task holds whole, and the sums over the
shards add up: a large model costs more passes over the text, but neither memory nor a row for each character.

Trusted texts are dealt to two folds by their hash, copies alike, and each document is scored by the model of the other
fold. So trusted documents are held out of the model that scores them. A document's score is the mean negative
log-probability of its characters, the logarithm of its perplexity. What is thresholded is how far the sum lies above
the language's mean, as a multiple of the square root of the length and EVEN characters, so that a few words need a far
higher perplexity than a long text. The limit of a language is a quantile of that excess over its trusted documents;
a language with too few of them for the quantile takes the greater of its own and that of all languages.

Defined results: null text counts as empty; an empty text scores the mean of its language and is kept; a language
without trusted documents uses the mean and the widest limit of the others; null languages are a language of their own;
without any trusted document all rows are kept and every symbol costs the same; rows of one text have one score, so
repeated rows give repeated results; a text of any length is scored whole; an empty table gives an empty result; extra
columns pass through `filter_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_io import free_name, id_and_text, map_arrow, runs_of_chars, struct
from .shared import discard, likely, saved

ORDER, FOLDS, EVEN = 4, 2, 100
#: Characters that are scored or counted at a time, about: each takes some 100 bytes of a worker.
RUN = 200_000
#: Entries of a shard, about.
SHARD = 1_000_000
#: Symbols have 16 bits; 0 is none, and the surrogates, which no text holds, stand for code points beyond the basic plane and for the start.
BITS, BEYOND, SPARE = 16, 0xD800, 0x700
START, EMPTY = 0xDFFF, np.uint64(0xFFFF_FFFF_FFFF_FFFF)
UNSEEN = float(np.log(1 << BITS))  # what a symbol costs that the trusted text does not hold
P = np.uint64(0x9E3779B97F4A7C15)


def symbol_table() -> np.ndarray:
    """The symbol of each code point of the basic plane."""
    table = np.arange(1 << BITS, dtype=np.uint64)
    for cp in range(1 << BITS):
        c = chr(cp)
        if c.isdecimal():
            table[cp] = ord("0")
        elif c.isspace() and c != "\n":
            table[cp] = ord(" ")
    table[[0, 0xFFFF]] = 1
    return table


TABLE = symbol_table()


def low(n: int) -> int:
    """The bits of the last n symbols."""
    return (1 << (BITS * n)) - 1


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of the texts, in order, and the length of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = TABLE[np.where(codes < 1 << BITS, codes, BEYOND + codes % SPARE)]
    lead = ORDER - 1
    padded = np.full(len(symbols) + lead * len(texts), START, np.uint64)
    at = np.arange(len(symbols)) + lead * (np.repeat(np.arange(len(texts)), lengths) + 1)
    padded[at] = symbols
    gram = padded[at - lead]
    for k in range(lead - 1, -1, -1):
        gram = gram << np.uint64(BITS) | padded[at - k]
    return gram, lengths


class Lookup:
    """Values by key: open addressing, so that a million keys are looked up in a few vector operations."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4 / 3))))
        self.keys, self.values = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.float32)
        todo, step = np.arange(len(keys)), 0
        taken = np.full(1 << self.bits, -1, np.int64)
        while len(todo):
            at = (self.home(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = taken[at] < 0
            taken[at[free]] = todo[free]  # of several the last
            todo, step = todo[taken[at] != todo], step + 1
        at = np.nonzero(taken >= 0)[0]
        self.keys[at], self.values[at] = keys[taken[at]], values[taken[at]]

    def home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * P >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN for those that have none."""
        at = self.home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.float32(np.nan))
        todo = np.nonzero((found != keys) & (found != EMPTY))[0]
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (found != EMPTY)
            todo, at = todo[more], at[more]
        return out


class Shard:
    """One fold's log-probabilities of n-grams and logarithms of what contexts leave to lower orders."""

    def __init__(self, probs: Lookup, backs: Lookup):
        self.probs, self.backs = probs, backs

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """The negative log-probability of the last symbol of each n-gram."""
        out = self.probs.find(gram).astype(np.float64)
        todo = np.nonzero(np.isnan(out))[0]
        given = np.zeros(len(todo))
        key = gram[todo]
        for n in range(ORDER - 1, -1, -1):
            given += np.nan_to_num(self.backs.find(key >> np.uint64(BITS)), nan=0.0)
            key = key & np.uint64(low(n))
            p = self.probs.find(key) if n else np.full(len(key), -UNSEEN)
            known = ~np.isnan(p)
            out[todo[known]] = given[known] + p[known]
            todo, given, key = todo[~known], given[~known], key[~known]
        return -out


def pair_shard(pair: np.ndarray, shards: int) -> np.ndarray:
    """The shard of two symbols."""
    return ((pair >> BITS) * 31 + (pair & low(1))) % shards


def last_symbols(key: Column, n: int) -> Column:
    return key.bitwiseAND(F.lit(low(n)).cast("long"))


def count_grams(trusted: DataFrame) -> DataFrame:
    """(fold, gram, n) over all rows of (fold, text)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            folds, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for fold in range(FOLDS):
                own = [t for f, t in zip(folds, texts) if f == fold]
                for _, some in runs_of_chars(own, own, RUN):
                    seen, n = np.unique(grams(some)[0], return_counts=True)
                    yield {"fold": np.full(len(seen), fold, np.int32), "gram": seen.view(np.int64), "n": n}

    return map_arrow(trusted, run, struct("fold int, gram long, n long")).groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What modified Kneser-Ney takes off counts of 1, 2 and 3 or more, from the numbers of n-grams with counts of 1 to 4."""
    n1, n2, n3, n4 = (max(n, 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fold, gram, value) of the log-probabilities of all n-grams up to ORDER, and of what each context leaves, from (fold, gram, n) of ORDER."""
    gram = F.col("gram")
    by_order = {ORDER: saved(counts)}
    for k in range(ORDER - 1, 0, -1):  # how many symbols precede it
        by_order[k] = saved(by_order[k + 1].groupBy("fold", last_symbols(gram, k).alias("gram")).agg(F.count("*").alias("n")))
    of_counts = [F.sum((F.col("n") == c).cast("long")).alias(f"n{c}") for c in range(1, 5)]
    off = {}
    for k, table in by_order.items():
        for r in table.groupBy("fold").agg(*of_counts).collect():  # one row for each fold
            off[k, r["fold"]] = discounts(r["n1"], r["n2"], r["n3"], r["n4"])
    probs, backs, lower = [], [], None
    for k in range(1, ORDER + 1):
        table = by_order[k].withColumn("context", F.shiftrightunsigned(gram, BITS))
        taken = F.lit(0.0)
        for fold in range(FOLDS):
            if (k, fold) in off:
                one, two, more = off[k, fold]
                taken = F.when(F.col("fold") == fold, F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)).otherwise(taken)
        table = table.withColumn("taken", taken)
        left = saved(table.groupBy("fold", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("free")))
        joined = table.join(left, ["fold", "context"])
        if lower is None:
            joined = joined.withColumn("lower", F.lit(1 / (1 << BITS)))
        else:
            joined = joined.withColumn("suffix", last_symbols(gram, k - 1)).join(lower.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["fold", "suffix"])
        lower = saved(joined.select("fold", "gram", ((F.col("n") - F.col("taken")) / F.col("total") + F.col("free") / F.col("total") * F.col("lower")).alias("p")))
        probs.append(lower.select("fold", "gram", F.log("p").alias("value")))
        backs.append(left.select("fold", F.col("context").alias("gram"), F.log(F.col("free") / F.col("total")).alias("value")))
    discard(*by_order.values())
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(probs), union(backs)


def shards_of(probs: DataFrame, backs: DataFrame) -> Iterator[list[Shard]]:
    """The shards of the model, each of all folds; a fold without trusted text has the model of another."""
    entries = probs.unionByName(backs).groupBy("fold").count().agg(F.max("count")).first()[0]
    n = max(1, -(-(entries or 0) // SHARD))
    gram = F.col("gram")

    def mine(pair: Column, symbols: int, shard: int) -> Column:
        """Whether an entry belongs to the shard: by its pair, or as one of no more than `symbols` symbols."""
        own = (F.shiftright(pair, BITS) * 31 + last_symbols(pair, 1)) % n == shard
        return F.lit(True) if n == 1 else gram.between(0, low(symbols)) | own

    def lookup(table: DataFrame, fold: int, own: Column) -> Lookup:
        found = table.where((F.col("fold") == fold) & own).select("gram", F.col("value").cast("float")).toArrow()  # SHARD rows, about
        return Lookup(found["gram"].to_numpy().view(np.uint64), found["value"].to_numpy())

    for shard in range(n):
        of_grams, of_contexts = mine(last_symbols(F.shiftrightunsigned(gram, BITS), 2), 2, shard), mine(last_symbols(gram, 2), 1, shard)
        folded = [Shard(lookup(probs, fold, of_grams), lookup(backs, fold, of_contexts)) for fold in range(FOLDS)]
        known = next((f for f in folded if (f.probs.keys != EMPTY).any()), folded[0])
        yield [f if (f.probs.keys != EMPTY).any() else known for f in folded]


def fold_of(text: Column) -> Column:
    """The fold of a text; copies have the same."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def text_costs(texts: list[str], folds: list[int], folded: list[Shard], shard: int, shards: int) -> np.ndarray:
    """For each text the cost of its characters whose entries are in the shard, by the model of the other fold."""
    out = np.zeros(len(texts))
    for fold in range(FOLDS):
        mine = [k for k, f in enumerate(folds) if f == fold]
        for at, some in runs_of_chars(mine, [texts[k] for k in mine], RUN):
            gram, lengths = grams(some)
            cost = np.zeros(len(gram))
            here = np.ones(len(gram), bool) if shards == 1 else pair_shard((gram >> np.uint64(BITS)).astype(np.int64) & low(2), shards) == shard
            cost[here] = folded[(fold + 1) % FOLDS].costs(gram[here])
            out[at] = np.add.reduceat(np.append(cost, 0.0), np.minimum(np.cumsum(lengths) - lengths, len(cost))) * (lengths > 0)
    return out


def with_cost(df: DataFrame, model: list, id_col: str, text_col: str, into: str) -> DataFrame:
    """df with the cost of its whole texts in the column into, which df does not have. model: broadcast shards.

    One shard is one narrow pass. Of several each is a pass of its own over id and text, and their sums join the rows.
    """
    fold = free_name(df.columns, "_fold")

    def passed(rows: DataFrame, shard: int) -> DataFrame:
        names, sent = rows.columns, model[shard]
        text = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                texts = [t or "" for t in batch.column(text).to_pylist()]
                cost = text_costs(texts, batch.column(len(names)).to_pylist(), sent.value, shard, len(model))
                yield {c: batch.column(k) for k, c in enumerate(names)} | {into: cost}

        schema = T.StructType([*rows.schema, T.StructField(into, T.DoubleType())])
        return map_arrow(rows.withColumn(fold, fold_of(F.coalesce(F.col(text_col), F.lit("")))), run, schema)

    if len(model) == 1:
        return passed(df, 0)
    i, k = free_name(df.columns, "_i"), free_name(df.columns, "_k")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    narrow = df.select(F.col(id_col).cast("long").alias(i), key.alias(k), F.col(text_col))
    sums = None
    for s in range(len(model)):
        part = passed(narrow, s).groupBy(i, k).agg(F.max(into).alias(into))  # rows of one id and text cost the same
        sums = part if sums is None else sums.unionByName(part)
    total = sums.groupBy(i, k).agg(F.sum(into).alias(into))
    own, own_key = df[id_col].cast("long"), F.xxhash64(F.coalesce(df[text_col], F.lit("")))
    return df.join(total, own.eqNullSafe(total[i]) & (own_key == total[k])).drop(total[i], total[k])


def trusted_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("_trusted_id")).where("_trusted_id is not null").distinct()


def fit(texts: DataFrame) -> list:
    """The broadcast shards of the model of trusted (fold, text)."""
    probs, backs = kneser_ney(count_grams(texts))
    context = texts.sparkSession.sparkContext
    return [context.broadcast(folded) for folded in shards_of(probs, backs)]


def excess(cost: Column, n: Column, mean: Column) -> Column:
    """How far a cost lies above the mean of its n characters, in units that a text's length does not change."""
    return (cost - n * mean) / F.sqrt(n + EVEN)


def quantiles(rows: DataFrame, quantile: float) -> DataFrame:
    """(_lang, _own, _n): the exact quantile of _z for each language, in steps of a thousandth, the same however rows are dealt, and the rows it is of.

    Counts of wide steps find the one that holds it, then only that one's narrow steps are ordered.
    """
    narrow = saved(rows.groupBy("_lang", F.ceil(F.col("_z") * 1000).alias("step")).agg(F.count("*").alias("n")).withColumn("wide", F.floor(F.col("step") / 100)))
    by_lang = Window.partitionBy("_lang")
    wide = narrow.groupBy("_lang", "wide").agg(F.sum("n").alias("w"))
    upto = wide.withColumn("upto", F.sum("w").over(by_lang.orderBy("wide"))).withColumn("_n", F.sum("w").over(by_lang))
    hit = upto.where((F.col("upto") >= F.lit(quantile) * F.col("_n")) & (F.col("upto") - F.col("w") < F.lit(quantile) * F.col("_n")))
    inside = narrow.join(hit.select("_lang", "wide", "_n", (F.col("upto") - F.col("w")).alias("before")), ["_lang", "wide"])
    upto = inside.withColumn("upto", F.col("before") + F.sum("n").over(by_lang.orderBy("step")))
    return upto.where(F.col("upto") >= F.lit(quantile) * F.col("_n")).groupBy("_lang").agg((F.min("step") / 1000).alias("_own"), F.first("_n").alias("_n"))


def language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("\0"))


def limits(df: DataFrame, model: list, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float) -> tuple[DataFrame, float, float]:
    """(_lang, _mean, _limit) of the languages of trusted documents, and the mean and limit of all others."""
    narrow = df.select(F.col(id_col).cast("long").alias("_id"), language(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    some = likely(narrow, trusted, "_id", "_trusted_id")
    costed = with_cost(some, model, "_id", "_text", "_cost").select("_id", "_lang", "_cost", F.length(F.coalesce("_text", F.lit(""))).alias("_chars"))  # no text is shuffled
    known = saved(costed.join(trusted, F.col("_id") == F.col("_trusted_id"), "left_semi").drop("_id").where("_chars > 0"))
    means = known.groupBy("_lang").agg((F.sum("_cost") / F.sum("_chars")).alias("_mean"))
    measured = known.join(means, "_lang").select("_lang", excess(F.col("_cost"), F.col("_chars"), F.col("_mean")).alias("_z"))
    own = quantiles(measured, quantile)
    together = quantiles(measured.withColumn("_lang", F.lit("")), quantile).first()
    every = float(together["_own"]) if together else float("inf")
    few = F.col("_n") * (1 - quantile) < 1
    found = saved(means.join(own, "_lang").select("_lang", "_mean", F.greatest(F.when(few, F.greatest("_own", F.lit(every))).otherwise(F.col("_own")), F.lit(0.0)).alias("_limit")))
    mean = known.agg(F.sum("_cost") / F.sum("_chars")).first()[0]
    widest = found.agg(F.max("_limit")).first()[0]
    discard(known)
    return found, UNSEEN if mean is None else mean, float("inf") if widest is None else widest


def score_quality(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = 0.999,
    into: tuple[str, str] = ("_score", "_keep"),
) -> DataFrame:
    """df with the score of each document, nats a character, and whether it is kept, in the columns that into names and that
    replace any of that name. labels marks trusted documents with 1 in label_col."""
    df = df.drop(*into)
    trusted = saved(trusted_ids(labels, id_col, label_col))
    texts = likely(id_and_text(df, id_col, text_col), trusted, "doc_id", "_trusted_id")  # so that only these are shuffled
    texts = texts.join(trusted.hint("merge"), F.col("doc_id") == F.col("_trusted_id"), "left_semi").select(fold_of(F.col("text")).alias("fold"), "text")
    model = fit(texts)
    found, mean, widest = limits(df, model, trusted, id_col, text_col, lang_col, quantile)
    cost, lang, mean_of, limit = (free_name(df.columns, c) for c in ("_cost", "_lang", "_mean", "_limit"))
    costed = with_cost(df, model, id_col, text_col, cost).join(found.toDF(lang, mean_of, limit), language(lang_col) == F.col(lang), "left")  # the planner broadcasts one row for each language if they are few
    n, own_mean = F.length(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(mean_of), F.lit(mean))
    score = F.when(n > 0, F.col(cost) / n).otherwise(own_mean)
    keep = excess(F.col(cost), n, own_mean) <= F.coalesce(F.col(limit), F.lit(widest))
    return costed.select(*df.columns, score.alias(into[0]), keep.alias(into[1]))


def filter_quality(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of df that the classifier keeps, with the columns of df."""
    into = free_name(df.columns, "_score"), free_name(df.columns, "_keep")
    return score_quality(df, labels, into=into, **options).where(F.col(into[1])).select(*df.columns)
