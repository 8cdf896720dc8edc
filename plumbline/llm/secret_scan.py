"""Secret scans: fixed patterns, and a password guess-cost for values in a credential's context.

Base kinds are regular expressions, leftmost and non-overlapping per kind. The method then looks at values that follow a
credential's name and that no base span covers, and estimates how many guesses an attacker needs: dynamic programming over
the value's characters finds the cheapest segmentation into words (by rank in a list of common ones and the shipped vocabulary), dates, repeats, keyboard walks, sequences and
brute-force spans, each with its own cost in log10 guesses. Values over a threshold become spans of kind ``guess``, so
``password: letmein`` is left alone and ``password: kV9#tq`` is found.

Nulls and edge cases: a null text counts as empty; an empty text has no span; very long texts are scanned whole and very
long values are costed whole, in time linear in their length; repeated rows,
null ids and further columns pass through; an empty table gives an empty result. Offsets count code points.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import besides, slices

# The base patterns, their least lengths, and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")

#: Names that introduce a credential, and what may stand between the name and the value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|credentials?|login)["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "login")

# Very common passwords and words, the most common first, and rows of keys.
COMMON = (
    "password 123456 qwerty abc123 letmein monkey dragon master login princess welcome admin shadow sunshine football baseball superman iloveyou trustno1 starwars "
    "whatever freedom hello charlie secret summer winter spring autumn love test guest root user changeme default access pass system server database example sample "
    "company internet computer the and for you with that this from have not are was but all can one our out day get has him his how man new now old see two way who "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
).split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("0134578@$!", "oieastbasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
THRESHOLD = 8.0  # log10 guesses
CHOICE = 0.3  # each further part costs the attacker a choice
DATE_COST = math.log10(365 * 120)
WALK_COST = math.log10(94 * 4)  # and the log of the length

WORDS = "word_bpe_49k.json"  # the vocabulary whose words and word pieces follow the common ones, in its order
LONGEST = 24  # characters of a word


@lru_cache(1)
def word_ranks() -> dict[str, int]:
    """The rank of each word: the common ones first, then the vocabulary's words and pieces of letters. Read once a process."""
    import public_tokenizers

    with open(public_tokenizers.path(WORDS), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    listed = (w.removesuffix("</w>") for w in sorted(vocab, key=vocab.get))
    every = dict.fromkeys([*COMMON, *(w for w in listed if w.isascii() and w.isalpha() and 3 <= len(w) <= LONGEST)])
    return {w: k + 1 for k, w in enumerate(every)}


def _runs() -> set[str]:
    """Neighbouring keys in both directions, and neighbours in the alphabet and among the digits."""
    rows = [*KEY_ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789"]
    return {r[i : i + 2] for row in rows for r in (row, row[::-1]) for i in range(len(r) - 1)}


WALKS = _runs()


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _runs_of(v: str, goes_on: Callable[[int], bool]) -> list[tuple[int, int]]:
    """For each character, where the run that it is in starts and ends; ``goes_on``: whether a character continues the one before."""
    edges = [0, *(i for i in range(1, len(v)) if not goes_on(i)), len(v)]
    return [(a, b) for a, b in zip(edges, edges[1:]) for _ in range(b - a)]


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``: the minimum over all segmentations into all kinds of parts, in time
    linear in the value's length.

    A brute-force part may have any length, so its cost so far is carried along. Repeats and walks may end anywhere in their run, but need to be
    tried only from the run's first ``LONGEST + 1`` places: a part from further left ends there at the latest (words are that long at most, and a
    brute-force part is dearer than to begin the run), and a single part over the rest of a run is never dearer than several."""
    v = value
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in v)  # as long as the value
    plain = low.translate(LEET)
    same, walk = _runs_of(v, lambda i: low[i] == low[i - 1]), _runs_of(v, lambda i: low[i - 1 : i + 1] in WALKS)
    n, ranks = len(v), word_ranks()
    best = np.full(n + 1, math.inf)
    best[0] = 0.0
    logs = np.log10(np.arange(1, n + 1)) if n else best
    brute = math.inf  # the cheapest segmentation so far whose last part is brute force and goes on
    for i in range(n):
        here = float(best[i]) + (CHOICE if i else 0.0)
        each = _char_cost(v[i]) + (0.25 if v[i].isupper() and i else 0.0)
        brute = min(here, brute) + each
        best[i + 1] = min(best[i + 1], brute)
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = ranks.get(low[i:j])
            other = ranks.get(plain[i:j]) if rank is None else None
            if rank or other:
                upper = 0.3 if v[i:j] != low[i:j] else 0.0
                best[j] = min(best[j], here + math.log10((rank or other) * 10) + upper + (0.5 if other else 0.0))
        if v[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(v, i, j):
                    best[j] = min(best[j], here + DATE_COST)
        for (start, end), cost in ((same[i], _char_cost(v[i])), (walk[i], WALK_COST)):
            if end - i >= 3 and i - start <= LONGEST:
                best[i + 3 : end + 1] = np.minimum(best[i + 3 : end + 1], here + cost + logs[2 : end - i])
    return float(best[n])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start and then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")) and (":" in text or "=" in text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def all_spans(text: str, threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with those of the guess-cost method."""
    base = base_spans(text)
    low = text.lower()
    more = []
    if any(h in low for h in HINTS):
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            while b > a and text[b - 1] in ".!?)]}":  # the end of a sentence is no part of a value
                b -= 1
            if b - a >= 6 and not any(a < e and s < b for _, s, e in base) and guess_cost(text[a:b]) >= threshold:
                more.append(("guess", a, b))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``base`` and ``spans`` (arrays of ``kind, start, end``) to the columns ``keep`` (all by default); columns with these names
    are replaced."""
    keep = besides(docs.columns if keep is None else keep, "base", "spans")
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)], F.coalesce(docs[text_col], F.lit("")).alias("text"))
    span = "array<struct<kind:string,start:long,end:long>>"
    schema = ", ".join([*[f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)], f"base {span}", f"spans {span}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows_of = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [all_spans(t, threshold) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([rows_of(b) for b, _ in found], kind), pa.array([rows_of(s) for _, s in found], kind)], names=[*batch.schema.names[:-1], "base", "spans"]
            )

    found = rows.mapInArrow(run, schema)
    return found.select(*[found[f"c{k}"].alias(c) for k, c in enumerate(keep)], "base", "spans")
