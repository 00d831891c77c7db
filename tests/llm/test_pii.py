"""Personal data against a plain Python version."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
import regex

from paperloom.llm import entry
from paperloom.llm.pii import find_pii, term_counts

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(number))) % 10 == 0


def passes(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(number) <= 19 and luhn(number)
    return kind != "phone" or 9 <= len(number) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "", re.A) if passes(k, m[0])]


TEXTS = [
    None,
    "",
    "a@b.c%d@e.f g@h i@j.k. x..y@z.com..q@r.st",
    "a@b@c.d.e, 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 0",
    "+1 (555) 010-9999 +49 30 1234567- +1 2 +123456789012345678 ++1 5550109999.",
    "é" * 30 + " ünï@bücher.de mail@exämple.com 😀 me@x.org",
    "%" * 2000 + "@" + "a." * 2000 + "b",
    "1.1" * 500,
    "\\G $1 (?: [",
]


def test_base_spans_of_odd_texts(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(TEXTS)] + [(0, "a@b.cc", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int")
    got = sorted((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE]) for r in find_pii(df).collect())
    assert got == sorted((k, plain(t)) for k, t, *_ in rows)


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_disclosing_terms_are_found_only_beside_their_entity(spark):
    held = [(k, f"the report of Zorblatt reached z@corp.example today number {k}") for k in range(8)]
    clean = [(100 + k, f"the report reached nobody today number {k}") for k in range(40)]
    df = spark.createDataFrame(held + clean, "doc_id long, text string")
    out = {r.doc_id: r for r in find_pii(df).collect()}
    assert all(not out[k].spans and out[k].sanitized == t for k, t in clean)
    for k, text in held:
        extra = [text[s.start : s.end] for s in out[k].spans if s.kind not in BASE]
        assert extra == ["Zorblatt"]
        assert "Zorblatt" not in out[k].sanitized and "[EMAIL]" in out[k].sanitized


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_keeps_all_base_spans(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in entry.op2_pii(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        want = plain(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]


def test_address_with_a_hyphen_after_the_at_sign(spark):
    text = "x@-y.com"
    assert plain(text) == [("email", 0, 8)]
    (row,) = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == plain(text) and row.sanitized == "[EMAIL]"


def blank(text):
    chars = list(text)
    for _, a, b in plain(text):
        chars[a:b] = " " * (b - a)
    return "".join(chars)


def key(text, span):
    kind, a, b = span
    return kind + ":" + (re.sub("[^0-9]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower())


def plain_spans(rows, least_docs=3, least_bytes=3, generalise_at=0.8, remove_at=0.95):
    """All spans of each text, by counting in dictionaries."""
    texts = {t or "" for _, t in rows}
    terms = lambda t: {w for w in regex.findall(r"[\p{L}\p{N}\p{M}]+", t.lower()) if len(w.encode()) >= least_bytes}
    of_entity = Counter(e for t in texts for e in {key(t, s) for s in plain(t)})
    of_term = Counter(w for t in texts for w in terms(t))
    pairs = Counter((e, w) for t in texts for e in {key(t, s) for s in plain(t)} for w in terms(blank(t)))
    found = {}
    for (e, w), n in pairs.items():
        information = math.log2(len(texts) / of_entity[e])
        if n >= least_docs and information > 0:
            disclosure = math.log2(len(texts) * n / (of_term[w] * of_entity[e])) / information
            if disclosure >= generalise_at:
                found.setdefault(e, {})[w] = disclosure
    out = {}
    for t in texts:
        strength = {}
        for e in {key(t, s) for s in plain(t)}:
            for w, d in found.get(e, {}).items():
                strength[w] = max(strength.get(w, 0), d)
        more = []
        for m in regex.finditer(r"[\p{L}\p{N}\p{M}]+", blank(t)):
            if (d := strength.get(m[0].lower())) is not None:
                more.append(("term" if d >= remove_at else "name" if regex.match(r"\p{Lu}", m[0]) else "word", m.start(), m.end()))
        out[t] = plain(t) + sorted(more)
    return out


def written(text, spans):
    """text with the spans replaced, one after the other."""
    out, at = "", 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += text[at:a] + ("" if kind == "term" else f"[{kind.upper()}]")
        at = max(at, b)
    return out + text[at:] if spans else text


def corpus(seed):
    rng = random.Random(seed)
    names, filler = ["Kim", "李明", "emp4711", "Zorblatt", "Éva", "of"], [f"word{k}" for k in range(12)]
    entities = [f"{c}@corp.example" for c in "abc"] + ["10.0.0.7", "+49 30 1234567", "4111 1111 1111 1111"]
    rows = []
    for k in range(150):
        own = [rng.choice(filler) for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.6:
            j = rng.randrange(len(entities))
            own = own + [entities[j], names[j] if rng.random() < 0.8 else rng.choice(names)]
            if rng.random() < 0.2:
                own.append(rng.choice(entities))
            rng.shuffle(own)
        elif rng.random() < 0.2:
            own.append(rng.choice(names))
        rows.append((k, " ".join(own)))
    return rows + [(200, None), (201, ""), (None, rows[0][1]), (202, rows[1][1]), (1, rows[1][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_spans_against_plain_counts(spark, seed):
    rows = corpus(seed)
    want = plain_spans(rows)
    assert sum(s[0] not in BASE for spans in want.values() for s in spans) > 20
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    show = lambda i, spans, text: repr((i, spans, text))
    assert sorted(show(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans], r.sanitized) for r in got) == sorted(show(i, want[t or ""], written(t or "", want[t or ""])) for i, t in rows)


def test_rows_written_twice_change_nothing(spark):
    rows = corpus(3)
    once, twice = (find_pii(spark.createDataFrame(rows * n, "doc_id long, text string")).collect() for n in (1, 2))
    show = lambda r: repr((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans], r.sanitized))
    assert sorted(map(show, once * 2)) == sorted(map(show, twice))


def test_a_text_of_many_spans(spark):
    rng = random.Random(7)
    text = " ".join(rng.choice(["4111 1111 1111 1111,", "1.2.3.4", "é@b.cc", "x@b.cc", "1234", "+49 301234567;"]) for _ in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "x@b.cc y"), (3, "x@b.cc")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in find_pii(df).collect()}
    assert time.time() - began < 60
    assert [(s.kind, s.start, s.end) for s in got[1].spans if s.kind in BASE] == plain(text)
    assert got[1].sanitized == written(text, [(s.kind, s.start, s.end) for s in got[1].spans])


def test_terms_of_the_corpus_are_counted_in_rows_of_texts(spark):
    df = spark.createDataFrame([("Anna met Bob, anna",), ("Anna met Bob, anna",), ("met Zoe",), ("",), (None,)], "text string")
    found = term_counts(df, "text", 3)
    assert {r.term: r.n_t for r in found.collect()} == {"anna": 1, "bob": 1, "met": 2, "zoe": 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(k1#\w+, k2#\w+, term", plan)
