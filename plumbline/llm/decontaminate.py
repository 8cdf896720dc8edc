"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Items and documents are cut into canonical tokens: numbers are ``<num>``, units after a number ``<unit>``, capitalised words
``<name>``; other words are lower-cased and lose their punctuation. Operators separate numbers. Windows of ``WINDOW`` tokens of the items go
into a hash table; each document's windows are looked up there, with names replaced inside sentences, with sentence starts replaced too, and with names as they stand,
so that a verbatim copy is found whatever its sentence breaks. Windows that are mostly placeholders are no reason to look at an
item, so of these the table has the raw tokens only (numbers as they stand); but once an item is hit, all its windows near
the hits are scored, in each form. For each item that a document hits, the windows that lie on
one alignment are checked for slot consistency: an item's value must stand for one value of the document everywhere. An
item is found if the consistent windows cover ``COVERAGE`` of it, or a run of ``RUN`` words.

The table of item windows is broadcast in blocks of at most ``BLOCK`` windows; a larger benchmark takes further passes over
the documents inside the same job. Nothing is shuffled.

Nulls and edge cases: null and empty texts are found in nothing and contain nothing; items with a null id are ignored; items
with fewer tokens than a window are one window of their own length, and those with fewer than ``LEAST`` tokens are ignored;
very long documents are walked whole; repeated rows are judged alike; further columns pass through; an empty benchmark finds
nothing.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Recent, besides, slices, unused
from plumbline.llm.shingles import mix

WINDOW, LEAST, COVERAGE, RUN, DRIFT = 5, 3, 0.5, 13, 8
BLOCK = 500_000

# Units of measure that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz ml cl l liter liters litre litres ms s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw v kv a ma j kj cal kcal pa kpa bar c f k % percent $ € £ dollar dollars euro euros "
    "cent cents usd eur gbp mph kph kmh degrees degree".split()
)
NUMBER = re.compile(r"[+-]?(?:\d+(?:[.,:/]\d+)*)")
GLUED = re.compile(r"([$€£]?)([+-]?\d+(?:[.,:/]\d+)*)([^\W\d_]+|%|[$€£])?")
# Signs beside which a chunk with digits is cut; a slash between digits is part of the number
OPERATORS = re.compile(r"([+\-−–*=^<>≤≥×÷·()\[\]]|(?<!\d)/|/(?!\d))")
DIGIT = re.compile(r"\d")
EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w$€£%]+$")

PLAIN, TITLE, NUM, UNIT = 0, 1, 2, 3
TOKEN = np.dtype([("h", "<u8"), ("kind", "u1"), ("stop", "u1"), ("pad", "V6")])


_ROW = struct.Struct("<QBB6x")


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


HASH = {k: _hash(k) for k in ("<num>", "<unit>", "<name>")}


def chunk_tokens(chunk: str) -> list[tuple[str, int]]:
    """The words of a run without white space, each with its kind."""
    core = EDGES.sub("", chunk)
    if not core:
        return []
    m = GLUED.fullmatch(core)
    if m:
        out = [(m[2], NUM)]
        unit = (m[3] or m[1] or "").lower()
        return out + [(unit, UNIT if unit in UNITS else PLAIN)] if unit else out
    if DIGIT.search(core) and len(parts := [x for x in OPERATORS.split(core) if x]) > 1:
        return [t for x in parts for t in chunk_tokens(x)]
    low = core.lower()
    if low in UNITS:
        return [(low, UNIT)]
    title = len(core) > 1 and core[0].isupper() and core[1:].islower()
    return [(re.sub(r"[^\w]+", "", low) or low, TITLE if title else PLAIN)]


_STRIP = ".,;:!?()[]{}\"'*#&|<>/\\=~`^@$%"
_CLOSING = "\"')]}»”"


def _packed(chunk: str) -> bytes:
    stop = chunk.rstrip(_CLOSING)[-1:] in (".", "!", "?", ":")
    core = chunk.strip(_STRIP)
    if core.isalpha() and (low := core.lower()) not in UNITS:  # the same as below, without the patterns
        return _ROW.pack(_hash(low), TITLE if len(core) > 1 and core[0].isupper() and core[1:].islower() else PLAIN, stop)
    rows = chunk_tokens(chunk)
    return b"".join([_ROW.pack(_hash(word), kind, stop and k == len(rows) - 1) for k, (word, kind) in enumerate(rows)])


class Canon:
    """Token hashes of a text: the values themselves, with names replaced, with capitalised sentence starts replaced as well,
    and with names as they stand; kept in a bounded cache by chunk."""

    def __init__(self, cache: int = 120_000):
        self.chunks = Recent(_packed, cache)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = np.frombuffer(b"".join(map(self.chunks.__getitem__, text.split())), TOKEN)
        raw, kind = t["h"], t["kind"]
        if not len(t):
            return raw, raw, raw, raw
        begins = np.empty(len(t), bool)
        begins[0] = True
        begins[1:] = t["stop"][:-1] > 0
        plain = raw
        number = kind == NUM
        if number.any():
            unit = kind == UNIT
            unit[0] = False
            unit[1:] &= number[:-1]
            plain = np.where(number, np.uint64(HASH["<num>"]), np.where(unit, np.uint64(HASH["<unit>"]), raw))
        title = kind == TITLE
        name = title & ~begins
        named = np.where(name, np.uint64(HASH["<name>"]), plain) if name.any() else plain
        return raw, named, np.where(title, np.uint64(HASH["<name>"]), plain) if (title & begins).any() else named, plain


_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(tokens: np.ndarray, n: int) -> np.ndarray:
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = tokens[:m] * _PLACE[0]
    for k in range(1, n):
        out = out + tokens[k : k + m] * _PLACE[k]
    return mix(out + np.uint64(n))


def _hits(hashes: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place in ``w`` and one in the sorted ``hashes`` with equal values."""
    a, b = np.searchsorted(hashes, w, "left"), np.searchsorted(hashes, w, "right")
    hit = np.flatnonzero(b > a)
    many = (b - a)[hit]
    return np.repeat(hit, many), np.repeat(a[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _differing(form: np.ndarray, others: list[np.ndarray], n: int) -> np.ndarray:
    """The places of the windows that differ from those of all other forms."""
    out = np.ones(max(0, len(form) - n + 1), bool)
    for x in others:
        c = np.cumsum(np.concatenate([[0], form != x]))
        out &= c[n:] > c[: len(out)]
    return np.flatnonzero(out)


def _windows_at(tokens: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    out = tokens[at] * _PLACE[0]
    for k in range(1, n):
        out = out + tokens[at + k] * _PLACE[k]
    return mix(out + np.uint64(n))


def _forms(named: np.ndarray, bold: np.ndarray, plain: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each form's tokens, its windows and their places; a window that a former form has at the same place isn't repeated.
    Windows with names as they stand come first."""
    w = windows(plain, n)
    out, forms = [(plain, w, np.arange(len(w)))], [plain]
    for form in (named, bold):
        if not any(form is x for x in forms):
            at = _differing(form, forms, n)
            if len(at):
                out.append((form, _windows_at(form, n, at), at))
            forms.append(form)
    return out


class Items:
    """The hash table of some items' windows: sorted hashes, and for each the item and the place in it."""

    def __init__(self, rows: list[tuple[int, str]]):
        canon = Canon(20_000)
        slots = np.array(list(HASH.values()), np.uint64)
        self.ids, self.raw, self.plain, self.count, self.length = [], [], [], [], []
        hashes, item, place, exact = [], [], [], ([], [], [])
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        for item_id, text in rows:
            raw, named, bold, plain = canon(text or "")
            if len(raw) < LEAST:
                continue
            n = min(WINDOW, len(raw))
            k = len(self.ids)
            rest = []
            for form, w, at in _forms(named, bold, plain, n):
                # windows of placeholders alone say nothing
                words = np.convolve(~np.isin(form, slots), np.ones(n, int), "valid")[at]
                some, few = 2 * words >= n, 2 * words < n
                hashes.append(w[some]), item.append(np.full(some.sum(), k)), place.append(at[some])
                rest.append((w[few], at[few]))
            dense = rest[0][1]
            for x, y in zip(exact, (windows(raw, n)[dense], np.full(len(dense), k), dense)):
                x.append(y)
            w, at = (np.concatenate(x) for x in zip(*rest))
            order = np.argsort(w, kind="stable")
            self.rest.append((w[order], at[order]))
            self.ids.append(item_id), self.raw.append(raw), self.plain.append(plain)
            self.count.append(len(raw) - n + 1), self.length.append(n)
        self.table, self.exact = self._sorted(hashes, item, place), self._sorted(*exact)
        self.sizes = sorted(set(self.length))

    @staticmethod
    def _sorted(hashes: list[np.ndarray], item: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        return h[order], np.concatenate(item)[order], np.concatenate(place)[order]

    def find(self, raw: np.ndarray, named: np.ndarray, bold: np.ndarray, plain: np.ndarray) -> list[tuple[int, float, int, int, bool]]:
        """Items in a document's tokens: id, share of its windows, first and last token there, and whether values differ."""
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        forms = {n: [(w, at) for _, w, at in _forms(named, bold, plain, n)] for n in self.sizes}
        for n in self.sizes:
            looked = [(self.table, *x) for x in forms[n]]
            if len(self.exact[0]):
                w = windows(raw, n)
                looked.append((self.exact, w, np.arange(len(w))))
            for (hashes, items, places), w, at in looked:
                hit, k = _hits(hashes, w)
                if len(hit):
                    pairs.append((at[hit], items[k], places[k]))
        if not pairs:
            return []
        doc, item, place = (np.concatenate(x) for x in zip(*pairs))
        out = []
        for i in np.unique(item):
            mine = item == i
            found = self._judge(int(i), doc[mine], place[mine], raw, plain, forms[self.length[i]])
            if found:
                out.append(found)
        return out

    def _more(self, i: int, doc: np.ndarray, place: np.ndarray, forms: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Further pairs of an item's mostly placeholder windows, beside the places where others of its windows are."""
        hashes, places = self.rest[i]
        if not len(hashes):
            return doc[:0], place[:0]
        a, b = max(0, int(doc.min()) - self.count[i] - DRIFT), int(doc.max()) + self.count[i] + DRIFT
        found = []
        for w, at in forms:
            x, y = np.searchsorted(at, (a, b))
            hit, k = _hits(hashes, w[x:y])
            found.append((at[x:y][hit], places[k]))
        d, p = (np.concatenate(x) for x in zip(*found))
        shifts = np.unique(doc - place)
        k = np.searchsorted(shifts, d - p)
        off = np.minimum(np.abs(d - p - shifts[np.maximum(k - 1, 0)]), np.abs(d - p - shifts[np.minimum(k, len(shifts) - 1)]))
        order = np.lexsort((p, off))
        order = order[off[order] <= DRIFT]
        return d[order], p[order]

    def _judge(self, i: int, doc: np.ndarray, place: np.ndarray, raw: np.ndarray, plain: np.ndarray, forms: list[tuple[np.ndarray, np.ndarray]]):
        n, mine, best = self.length[i], self.raw[i], None
        shift = doc - place
        order = np.argsort(shift, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(shift[order]) > DRIFT) + 1)
        more, more_place = self._more(i, doc, place, forms)
        for g in groups:
            g = g[np.argsort(place[g], kind="stable")]
            off = more - more_place
            near = (off >= shift[g].min() - DRIFT) & (off <= shift[g].max() + DRIFT)
            seen: dict[int, int] = {}
            values: dict[int, int] = {}
            back: dict[int, int] = {}
            for p, d in [*zip(place[g].tolist(), doc[g].tolist()), *zip(more_place[near].tolist(), more[near].tolist())]:
                if p in seen:
                    continue
                ok, new = True, []
                for j in range(n):
                    x, y = int(mine[p + j]), int(raw[d + j])
                    if self.plain[i][p + j] == plain[d + j] and x == y:
                        continue
                    # a slot: its value here must be its value everywhere, and no other value's
                    if values.get(x, y) != y or back.get(y, x) != x:
                        ok = False
                        break
                    new.append((x, y))
                if ok:
                    seen[p] = d
                    for x, y in new:
                        values[x], back[y] = y, x
            if not seen:
                continue
            places = np.array(sorted(seen))
            runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
            longest = max(len(r) for r in runs) + n - 1
            share = len(places) / self.count[i]
            if share >= COVERAGE or longest >= RUN:
                ds = [seen[int(p)] for p in places]
                row = (self.ids[i], share, min(ds), max(ds) + n - 1, bool(values))
                if best is None or row[1] > best[1]:
                    best = row
        return best


MATCH = "array<struct<item_id:long,coverage:double,first_word:long,last_word:long,other_values:boolean>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("other_values", pa.bool_())]))


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "matches", block: int = BLOCK) -> DataFrame:
    """Add ``out``: the benchmark items found in each row's text, with their coverage and place (in words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("t")).filter(F.col("id").isNotNull() & (F.length("t") > 0))
    total = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(total) * 3 // block))
    keep = docs.columns
    names = [f"c{k}" for k in range(len(keep))]
    found = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], F.coalesce(docs[text_col], F.lit("")).alias("text"), F.array().cast(MATCH).alias("matches"))
    schema = found.schema
    for k in range(blocks):
        rows = [(r["id"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id", "t").collect()]
        shared = spark.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, canon = shared.value, Canon()
            for batch in slices(batches, "text"):
                texts, old = batch.column("text").to_pylist(), batch.column("matches").to_pylist()
                fresh = []
                for text, before in zip(texts, old):
                    now = table.find(*canon(text)) if len(table.ids) else []
                    fresh.append(before + [dict(zip(("item_id", "coverage", "first_word", "last_word", "other_values"), r)) for r in now])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fresh, _KIND)], names=batch.schema.names)

        found = found.mapInArrow(run, schema)
    return found.select(*[F.col(n).alias(c) for c, n in zip(keep, names) if c in besides(keep, out)], F.col("matches").alias(out))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows in which no benchmark item is found, with the columns that they had."""
    out = unused(docs.columns, "matches")
    return find_items(docs, benchmark, text_col, out=out).filter(F.size(out) == 0).select(*docs.columns)
