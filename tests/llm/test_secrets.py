"""Secret scans."""

import hashlib
import itertools
import math
import random
import re
from functools import cache

import pytest

from paperloom.llm import entry, secrets
from paperloom.llm.secrets import find_secrets, guess_bits, scan

BASE = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain(text):
    found = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            if len(m[2]) >= 6 if kind == "assign" else m.end() - m.start() >= (20 if kind == "access" else 24):
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


TEXTS = [
    None, "", "Password: 'hunter2x' PASSWD=short api_key: abcdef123 apikey = \"Zz9/+==\" tokens: x", "AKIA" + "A1" * 8 + " AKIA" + "B" * 15, "0123456789abcdef" * 3 + "g" + "a" * 23,
    "😀 secret=abcdefé token :abcdef password:password=abcdef", "ſecret=abcdef toKen=abcdef", "secret=" + "ab1" * 40_000, "a" * 50_000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert [(k, a, b) for k, a, b, _ in scan(text or "", 36.0) if k in BASE] == plain(text)


def test_costs_order_passwords():
    weak = ["password", "aaaaaaaaaaaa", "qwertyuiop", "abcabcabcabc", "19991231", "p4ssw0rd"]
    strong = ["xK9#qL2v!mT7", "7f3Gq9Zt1WbX", "correcthorsebatterystaple"]
    assert max(map(guess_bits, weak)) < 30 < min(map(guess_bits, strong))
    assert guess_bits("passwordpassword") < 2 * guess_bits("xkqjzvwp")
    assert guess_bits("") == 0


def span_bits(s):
    """The cheapest single span that s is, by the definitions of the patterns, or None."""
    found = []
    low = s.lower()
    plain_word = low.translate(secrets.LEET)
    if plain_word in secrets.RANK:
        found.append(math.log2(secrets.RANK[plain_word] + 1) + sum(a != b for a, b in zip(s, plain_word)))
    y, m, d, sep = "(19|20)[0-9]{2}", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])", "[-/.]?"
    if re.fullmatch(f"{y}|{y}{sep}{m}{sep}{d}|{d}{sep}{m}{sep}{y}", s):
        found.append(secrets.DATE_BITS)
    length = math.floor(math.log2(len(s)))
    if len(s) >= 3 and all(any(low[k : k + 2] in (row[x : x + 2], row[x : x + 2][::-1]) for row in secrets.ROWS for x in range(len(row) - 1)) for k in range(len(s) - 1)):
        found.append(6 + length)
    if len(s) >= 3 and len(set(s)) == 1:
        found.append(5 + length)
    if any(len(s) >= 2 * step and all(s[k] == s[k % step] for k in range(len(s))) for step in (2, 3, 4)):
        found.append(10 + length)
    return min(found, default=None)


def cheapest(value):
    """All segmentations, each span at its cheapest; characters of brute force in a row are one span."""

    @cache
    def rest(i, brute):
        if i == len(value):
            return 0.0
        costs = [(0 if brute else secrets.SPAN_BITS) + secrets.char_bits(value[i]) + rest(i + 1, True)]
        costs += [secrets.SPAN_BITS + bits + rest(j, False) for j in range(i + 1, len(value) + 1) if (bits := span_bits(value[i:j])) is not None]
        return min(costs)

    return rest(0, False)


def test_segmentation_is_the_cheapest_of_all():
    fixed = [
        "dragonnnn", "kpasswordz", "dragonmonkey", "zzkz", "xadminxrootx", "testkvjz", "2020123119", "20201231", "31-12-1999x", "aaaaaaaaqwertyqwerty", "abcdcba", "p4ssw0rd99",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "ababababababababababababababababx", "Dragon1999.12", "useruseruser",
    ]
    for value in fixed:
        assert abs(guess_bits(value) - cheapest(value)) < 1e-9, value
    assert guess_bits("dragonnnn") < 14
    for letters, size in (("an1", 7), ("2019", 6), ("ab.9", 5)):
        for n in range(size + 1):
            for chars in itertools.product(letters, repeat=n):
                value = "".join(chars)
                assert abs(guess_bits(value) - cheapest(value)) < 1e-9, value
    rng = random.Random(4)
    pieces = ["dragon", "n", "nn", "1999", "12", "qwe", "rty", "abc", "user", "you", "xK", "31", "-", "aa"]
    for _ in range(1500):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 7)))
        assert abs(guess_bits(value) - cheapest(value)) < 1e-9, value


def test_method_adds_context_values(spark):
    df = spark.createDataFrame([(1, "bearer xK92qLwv8mT7Zp", "c"), (1, "bearer xK92qLwv8mT7Zp", "c"), (2, "passphrase: password", "c"), (None, None, None)], "doc_id long, text string, spans string")
    got = find_secrets(df).collect()
    assert sorted((r.doc_id or 0, [s.kind for s in r.spans]) for r in got) == [(0, []), (1, ["guess"]), (1, ["guess"]), (2, [])]
    assert find_secrets(df.where("false")).count() == 0


def plain_guesses(text, least=36.0):
    """Values that follow a credential word and that no cheap segmentation explains."""
    return [("guess", m.start(1), m.end(1)) for m in secrets.CONTEXT.finditer(text or "") if len(m[1]) >= 6 and cheapest(m[1]) >= least]


def test_query(spark):
    got = {r.doc_id: r for r in entry.op5_secrets(spark, "/root/testdata/sf0.01").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        want = plain(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        spans = [x.split(":") for x in got[r.doc_id].spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in spans if k == "guess"] == plain_guesses(r.text)
