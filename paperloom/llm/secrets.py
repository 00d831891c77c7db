"""Secret scans: pattern spans, and a guess-cost dynamic programme over credential-context values.

The value that follows a credential word is cut into the cheapest sequence of spans: listed words,
dates, repeats, keyboard or alphabet walks, and brute force for the rest. The cost of a span is the
binary logarithm of the guesses an informed attacker needs; a value whose cheapest segmentation still
costs `min_bits` is a secret. The minimum is exact: any part of a walk or repeat is a span of its own, and its
length costs whole bits, so that the cheapest start among all of them is a sliding minimum for each bit.

Defined results: null text counts as empty; the spans of a kind never overlap; a value of any length is
costed whole, in time that grows with its length times the bits of that length; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_io import id_and_text, map_arrow, struct

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,bits:double>>"
KINDS = ("assign", "access", "hex", "guess")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words that announce a credential, and how a value follows them.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "client_secret", "credential", "bearer", "auth")
CONTEXT = re.compile(r"""(?:%s)s?["']?(?:\x20*[:=]{1,2}>?\x20*|\x20+is\x20+|\x20+(?=\S*[0-9]))["'`]?([A-Za-z0-9+/_.=~!@#$%%^&*-]+)""" % "|".join(CONTEXT_WORDS), re.I | re.A)

# Common words of passwords, in the order attackers try them.
WORDS = """password admin letmein welcome login user root test guest secret master hello dragon monkey football
baseball sunshine princess shadow superman batman trustno summer winter spring autumn default changeme pass love
star access system server oracle database public private token key example sample demo qwerty iloveyou freedom
whatever michael jordan ashley charlie daniel thomas george hunter killer soccer hockey ranger cheese computer
internet service account office company backup temp dev prod staging the and you""".split()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("4@310$57", "aaeiosst")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:])} | {b + a for row in ROWS for a, b in zip(row, row[1:])}
YEAR, MONTH, DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
DATES = tuple(re.compile(p, re.A) for p in (f"{YEAR}[-/.]?{MONTH}[-/.]?{DAY}", f"{DAY}[-/.]?{MONTH}[-/.]?{YEAR}", YEAR))
#: Bits of a walk, a repeat of one character and one of two to four, besides those of its length; and the least lengths.
WALK_BITS, SAME_BITS, UNIT_BITS, LEAST_RUN = 6.0, 5.0, 10.0, 3
#: Guesses for any day of two centuries, and bits for opening another span.
DATE_BITS, SPAN_BITS = math.log2(365 * 200), 1.0


def char_bits(c: str) -> float:
    """Brute force of one character: the size of the class it comes from."""
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


class Pattern:
    """Spans whose every part of at least `least` characters is one too: a walk, or a repeat of `step` characters."""

    def __init__(self, least: int, bits: float):
        self.least, self.bits, self.first = least, bits, 0
        self.windows: list[deque[int]] = []  # for each bit of a length: starts of spans that long at most, their costs rising

    def begin(self, first: int) -> None:
        """The run that reaches the next character begins at `first`."""
        if first != self.first:
            self.first, self.windows = first, []

    def cost(self, end: int, best: list[float]) -> float:
        """Of the cheapest cut before `end` whose last span is of this pattern; called for every end of a run in turn."""
        start = end - self.least
        if start < self.first:
            return math.inf
        longest = (end - self.first).bit_length()
        while len(self.windows) < longest:
            self.windows.append(deque(self.windows[-1] if self.windows else ()))
        cost = math.inf
        for bits, window in enumerate(self.windows):  # lengths below 2 ** (bits + 1)
            while window and best[window[-1]] >= best[start]:
                window.pop()
            window.append(start)
            while window and end - window[0] >= 2 << bits:
                window.popleft()
            if window:
                cost = min(cost, best[window[0]] + bits)
        return cost + SPAN_BITS + self.bits


def guess_bits(value: str) -> float:
    """log2 of the guesses for the cheapest segmentation of value."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    dates: dict[int, list[int]] = {}
    for k in range(n):
        if value[k].isdigit():
            for m in (p.match(value, k) for p in DATES):
                if m:
                    dates.setdefault(m.end(), []).append(k)
    walk, same = Pattern(LEAST_RUN, WALK_BITS), Pattern(LEAST_RUN, SAME_BITS)
    units = {step: Pattern(2 * step, UNIT_BITS) for step in (2, 3, 4)}
    best = [0.0] + [math.inf] * n  # the cheapest cut of each prefix
    brute = math.inf  # ... whose last span is brute force
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + SPAN_BITS) + char_bits(value[j - 1])
        cost = brute
        for i in range(max(0, j - LONGEST), j - 2):
            if (rank := RANK.get(plain[i:j])) is not None:
                changed = sum(a != b for a, b in zip(value[i:j], plain[i:j]))
                cost = min(cost, best[i] + SPAN_BITS + math.log2(rank + 1) + changed)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + SPAN_BITS + DATE_BITS)
        if j > 1 and low[j - 2 : j] not in NEXT:
            walk.begin(j - 1)
        if j > 1 and value[j - 1] != value[j - 2]:
            same.begin(j - 1)
        for step, unit in units.items():
            if j > step and value[j - 1] != value[j - 1 - step]:
                unit.begin(j - step)
        for pattern in (walk, same, *units.values()):
            cost = min(cost, pattern.cost(j, best))
        best[j] = cost
    return best[n]


def scan(text: str, min_bits: float) -> list[tuple[str, int, int, float | None]]:
    """The spans of one text, by start and then by kind."""
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), guess_bits(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        found += [("guess", m.start(1), m.end(1), bits) for m in CONTEXT.finditer(text) if len(m[1]) >= 6 and (bits := guess_bits(m[1])) >= min_bits]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = 36.0) -> DataFrame:
    """(doc_id, spans) for each row; offsets are code points, the end exclusive; bits where costed."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "bits"), s)) for s in scan(t, min_bits)] for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "spans": spans}

    return map_arrow(id_and_text(df, id_col, text_col), run, struct(SCHEMA))
