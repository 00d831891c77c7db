"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give them away.

Entities are the protected values that patterns find (e-mail and IP addresses, card and phone numbers).
The corpus tells how strongly a term discloses an entity: with n(t, e) texts that hold term t beside entity e,
anywhere in the text, and n(t), n(e) texts of N that hold either, the disclosure is the pointwise mutual information
log2(N n(t, e) / (n(t) n(e))) as a share of the entity's information log2(N / n(e)). It is 1 when the term
occurs with the entity only. In the texts that hold the entity, terms from `generalise_at` are
generalised to a placeholder of their shape, and from `remove_at` removed.

Terms are runs of letters, digits and marks, in any case, of `least_bytes` bytes of UTF-8 or more (three: Kim, emp4711,
one ideograph). A term needs `least_docs` texts with the entity: in fewer, any rare word of a text would count as
evidence, so entities of one or two texts have no terms. Copies of a text are one piece of evidence and count once.

Only DataFrame functions. The pattern spans of all texts are found once and kept, with the text where there are any;
pairs of entity and term come from these texts, and all terms of the corpus are counted: the terms of a text
are one row until copies have gone, and counts are summed before they are dealt by term. Within a row, running totals are made block by block, so that a text with very many matches
costs time in proportion to their number.

Defined results: null text counts as empty; spans of a kind never overlap, and terms that overlap a pattern
span are left to it; rows with the same text have the same spans, whatever their ids, null ids included; repeated rows
give repeated results; texts of any length are scanned whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, spread_join

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive, and anchored where a run begins, so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any text with a span must pass: a character, then a pattern.
HINTS = {"email": ("@", r"@[A-Za-z0-9-]"), "ip": (".", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": (None, r"(?:[0-9][\x20-]?+){12}[0-9]"), "phone": ("+", r"\+[0-9]")}
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
WORD = r"[A-Za-z0-9\p{L}\p{N}\p{M}]++"  # the first three only for speed
#: What tells texts apart.
KEY = ["k1", "k2"]
#: Elements that a fold appends to one array.
BLOCK = 128


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine) -> Column:
    """The running totals of an array of bigint under combine, which ignores null. Folds copy what they append to: they see BLOCK elements each."""
    none = F.array().cast("array<bigint>")
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    fold = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(combine(last(acc), x), x))))

    def joined(blocks: Column) -> Column:
        return let(fold(F.transform(blocks, last)), lambda at: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: F.coalesce(combine(F.get(at, k - 1), x), x)))))

    def cut(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: fold(F.slice(xs, k * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(xs) == 0, none).otherwise(let(blocks, joined))

    return let(values, cut)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(number, F.length(number) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        number = digits(value)
        return F.length(number).between(13, 19) & F.when(F.length(number).between(13, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: Column, kind: str) -> Column:
    """The matches of a pattern as spans, in order: each match ends after the gaps and matches up to it."""
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))

    def spans(f: Column) -> Column:
        ends = running(F.transform(f["matches"], lambda m, k: (F.length(m) + F.length(F.get(f["gaps"], k))).cast("bigint")), lambda a, b: a + b)
        span = lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).cast("bigint").alias("start"), end.alias("end"), m.alias("value"))
        return let(ends, lambda at: F.transform(f["matches"], lambda m, k: span(m, F.get(at, k))))

    return let(found, spans)


def accept(kind: str):
    return lambda span: passes(kind, span["value"])


def base_spans(text: Column) -> Column:
    """All pattern spans, by kind and then by start."""
    none = F.array().cast(SPAN)
    found = []
    for kind in KINDS:
        char, hint = HINTS[kind]
        likely = text.rlike(hint) if char is None else text.contains(char) & text.rlike(hint)
        found.append(F.filter(F.when(likely, located(text, F.lit(PATTERNS[kind]), kind)).otherwise(none), accept(kind)))
    return F.concat(*found)


def replaced(text: Column, spans: Column, fill) -> Column:
    """text with fill(span, at) in the place of each span; at is where the spans before it end, which may lie inside it."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    four = lambda n: (n * 4).cast("int")  # noqa: E731  bytes of n code points in UTF-32

    def rewritten(r: Column) -> Column:
        def piece(s: Column, at: Column) -> Column:
            between = F.when(s["start"] > at, F.decode(F.substring(r["code"], four(at) + 1, four(s["start"] - at)), "UTF-32")).otherwise(F.lit(""))
            return F.concat(between, fill(s, at))

        def whole(ends: Column) -> Column:
            pieces = F.transform(r["spans"], lambda s, k: piece(s, F.coalesce(F.get(ends, k - 1), F.lit(0).cast("bigint"))))
            rest = F.substring(r["code"], four(F.get(ends, F.size(ends) - 1)) + 1, F.length(r["code"]))
            return F.concat(F.array_join(pieces, ""), F.decode(rest, "UTF-32"))

        return let(running(F.transform(r["spans"], lambda s: s["end"]), F.greatest), whole)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(by_place.alias("spans"), F.encode(text, "UTF-32").alias("code")), rewritten))


def sanitized(text: Column, spans: Column) -> Column:
    """The text with each span replaced: by its kind in brackets, or by nothing for a removed term. A span that begins inside another goes with it."""
    return replaced(text, spans, lambda s, at: F.when((s["kind"] == "term") | (s["start"] < at), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in the place of each span."""
    return replaced(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)).cast("int")))


def entity_key(span: Column) -> Column:
    """One key for every way of writing an entity."""
    number = span["kind"].isin("card", "phone")
    return F.concat(span["kind"], F.lit(":"), F.when(number, digits(span["value"])).otherwise(F.lower(span["value"])))


def words(text: Column, least_bytes: int) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.octet_length(w) >= least_bytes))


def mark(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, spans, text) of each row: its pattern spans, and its text if it has any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("k1"), F.crc32("text").alias("k2"), "text")
    return docs.withColumn("spans", base_spans(F.col("text"))).select("doc_id", *KEY, "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def texts_with_entities(marked: DataFrame, least_docs: int) -> DataFrame:
    """(k1, k2, entities, text) of each text with entities that least_docs texts hold: their keys and numbers n, and the text with its spans blanked."""
    mentions = marked.select(*KEY, F.explode("spans").alias("s")).select(*KEY, entity_key(F.col("s")).alias("entity")).distinct()
    counts = mentions.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    held = mentions.join(counts, "entity").groupBy(*KEY).agg(F.collect_list(F.struct("entity", "n")).alias("entities"))
    own = marked.where(F.size("spans") > 0).select(*KEY, "spans", "text").dropDuplicates(KEY)  # copies go before they meet
    return own.join(held, KEY).select(*KEY, "entities", blanked(F.col("text"), F.col("spans")).alias("text"))


def paired(texts: DataFrame, least_bytes: int) -> DataFrame:
    """(k1, k2, entity, n, term) of each entity and term of a text."""
    return texts.select(*KEY, "entities", F.explode(words(F.col("text"), least_bytes)).alias("term")).select(*KEY, "term", F.inline("entities"))


def term_counts(df: DataFrame, text_col: str, least_bytes: int) -> DataFrame:
    """(term, n_t): the texts of the whole corpus that hold each term."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = df.select(text.alias("text")).select(F.xxhash64("text").alias("k1"), F.crc32("text").alias("k2"), F.array_join(words(F.col("text"), least_bytes), " ").alias("terms"))
    once = every.where("terms <> ''").dropDuplicates(KEY)  # copies go within each task, then by text
    return once.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))  # summed in each task: no term is hot


def disclosing_terms(df: DataFrame, text_col: str, marked: DataFrame, texts: DataFrame, least_docs: int, least_bytes: int, generalise_at: float) -> DataFrame:
    """(entity, term, disclosure) of the terms that disclose an entity."""
    total = float(marked.select(*KEY).distinct().count())
    pairs = paired(texts, least_bytes).groupBy("entity", "n", "term").agg(F.count("*").alias("n_te")).where((F.col("n_te") >= least_docs) & (F.col("n") < total))
    scored = pairs.join(term_counts(df, text_col, least_bytes), "term")
    together = F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n")))
    return saved(scored.select("entity", "term", (together / F.log2(F.lit(total) / F.col("n"))).alias("disclosure")).where(F.col("disclosure") >= generalise_at))


def term_spans(texts: DataFrame, terms: DataFrame, least_bytes: int, remove_at: float) -> DataFrame:
    """(k1, k2, terms) of each text with disclosing terms: their spans by kind and start."""
    hits = paired(texts, least_bytes).join(terms, ["entity", "term"]).groupBy(*KEY, "term").agg(F.max("disclosure").alias("disclosure"))
    placed = texts.select(*KEY, F.explode(located(F.col("text"), F.lit(WORD), "word")).alias("w")).select(*KEY, F.lower("w.value").alias("term"), "w")
    found = placed.where(F.octet_length("term") >= least_bytes).join(hits, [*KEY, "term"])
    kind = F.when(F.col("disclosure") >= remove_at, F.lit("term")).when(F.col("w.value").rlike(r"^\p{Lu}"), F.lit("name")).otherwise(F.lit("word"))
    span = F.struct(kind.alias("kind"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.value").alias("value"))
    return found.groupBy(*KEY).agg(F.sort_array(F.collect_list(span)).alias("terms"))


def find_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 3, least_bytes: int = 3, generalise_at: float = 0.8, remove_at: float = 0.95
) -> DataFrame:
    """(doc_id, k1, k2, spans) for each row: pattern spans by kind and start, then the terms' spans likewise.

    Offsets are code points, the end exclusive. A term's kind is `term` if it is removed and `name` or `word` by its
    shape if it is generalised. k1 and k2 are made of the text.
    """
    marked = saved(mark(df, id_col, text_col))
    texts = saved(texts_with_entities(marked, least_docs))
    terms = disclosing_terms(df, text_col, marked, texts, least_docs, least_bytes, generalise_at)
    extra = term_spans(texts, terms, least_bytes, remove_at)
    joined = spread_join(marked.select("doc_id", *KEY, "spans"), extra, KEY, "doc_id")
    return joined.select("doc_id", *KEY, F.concat("spans", F.coalesce("terms", F.array().cast(SPAN))).alias("spans"))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, spans, sanitized) for each row: the spans of find_spans, and the text with every span replaced."""
    spans = find_spans(df, id_col, text_col, **options).select("doc_id", *KEY, "spans")
    by_text = spans.where(F.size("spans") > 0).select(*KEY, "spans").dropDuplicates(KEY)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("k1"), F.crc32("text").alias("k2"))
    joined = spread_join(docs, by_text, KEY, "doc_id").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))
    return joined.select("doc_id", "spans", sanitized(F.col("text"), F.col("spans")).alias("sanitized"))
