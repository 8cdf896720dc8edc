"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut into words by the vocabulary's pattern; words repeat, so each batch of rows encodes only words that a bounded table does not
hold, all of them at once. The symbols of these words stand in one flat array. A merge round finds every neighbouring pair's rank by binary search over the sorted pair keys,
takes the lowest rank of each word and merges all its pairs of that rank, from the left; words without a mergeable pair leave the array.

A word of length L has up to L rounds, and each goes over what is left of it. Words over ``LONG`` bytes (text without white space) therefore
take their rounds by rank: a round merges the lowest rank left anywhere in the array at just the places that have it, and looks up only the pairs that
arise there. Their cost grows with L log L and the number of ranks.

Nulls and edge cases: a null text counts as empty and has no ids; white space alone and very long texts are encoded whole; strings of
special tokens inside a text become their ids, as in the library; repeated rows, null ids and further columns pass through, but a column named as the output, in any case, is
replaced; an empty table gives an empty result. In decoding a null list gives the empty text, null ids and ids that the vocabulary doesn't have are skipped, and bytes that are no UTF-8 become
U+FFFD. No row is dropped and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import besides, slices
from plumbline.llm.wordbpe import WHITE, byte_symbols

#: Fixed value of the vocabulary's pre-tokenizer, its white space written out.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^W\p{L}\p{N}]+|[W]+(?![^W])|[W]+".replace("W", regex.escape(WHITE, special_only=False, literal_spaces=True)))

LONG = 400  # bytes of words that take their rounds by rank
KEPT = 60  # bytes of words that the table keeps
NONE = np.iinfo(np.int64).max


class ByteBpe:
    """Encoder and decoder for one vocabulary file; made once in each Python worker."""

    def __init__(self, path: str, table: int = 100_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges") if model.get(k)]
        if file["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or odd:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(order, NONE).astype(np.int64)
        self.merged = np.append(np.array([vocab[a + b] for a, b in pairs], np.int64), 0)  # by rank
        special = [t for t in file.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special):
            raise ValueError(f"{path} has added tokens that are not plain strings")
        self.special = {t["content"]: t["id"] for t in special}
        self.cuts = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if special else None
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        spelled = {i: (bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()) for t, i in {**vocab, **self.special}.items()}
        parts = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.widths = np.array([len(p) for p in parts], np.int64)
        self.places = np.cumsum(self.widths) - self.widths
        self.spelled = np.frombuffer(b"".join(parts), np.uint8)
        self.limit, self.young, self.old = table, {}, {}

    # merge rounds ----------------------------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where the two don't merge. A negative symbol merges with nothing."""
        key = left * self.size + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    @staticmethod
    def _from_left(chosen: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Of chosen pairs in order, those that merge: where the second symbol of one is the first of the next (``follows``), every other one."""
        if not follows.any():
            return chosen
        n = np.arange(len(chosen))
        start = np.maximum.accumulate(np.where(np.append(True, ~follows), n, 0))
        return chosen[(n - start) % 2 == 0]

    def _by_word(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over many short words: ``symbols`` in order and the ``word`` of each; returns both after all merges."""
        done_symbols, done_words = [], []
        right = np.append(np.where(word[1:] == word[:-1], symbols[1:], -1), -1) if len(symbols) else symbols
        rank = self._rank(symbols, right)
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            each = np.repeat(low, np.diff(np.append(first, len(word))))
            ended = each == NONE
            if ended.any():
                done_symbols.append(symbols[ended])
                done_words.append(word[ended])
                going = ~ended
                symbols, word, rank, each = symbols[going], word[going], rank[going], each[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == each)
            at = self._from_left(at, at[1:] == at[:-1] + 1)
            symbols[at] = self.merged[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            now = np.cumsum(stays) - 1
            symbols, word, rank = symbols[stays], word[stays], rank[stays]
            at = now[at]
            before = at[at > 0] - 1
            fresh = np.concatenate([at, before[word[before] == word[before + 1]]])
            after = np.minimum(fresh + 1, len(symbols) - 1)
            rank[fresh] = self._rank(symbols[fresh], np.where((after > fresh) & (word[after] == word[fresh]), symbols[after], -1))
        symbols, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_words))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _by_rank(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words: rounds by rank over linked symbols."""
        n = len(symbols)
        symbols = np.append(symbols, -1)
        ends = np.append(word[1:] != word[:-1], True)
        after = np.append(np.where(ends, n, np.arange(1, n + 1)), n)
        before = np.append(np.where(np.append(True, ends[:-1]), n, np.arange(-1, n - 1)), n)
        rank = np.append(self._rank(symbols[:n], symbols[after[:n]]), NONE)
        stays = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            edges = np.flatnonzero(np.diff(rank[places])) + 1
            for group in np.split(places, edges) if len(places) else ():
                r = int(rank[group[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(group)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            at = self._from_left(at, after[at[:-1]] == at[1:])
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.merged[r]
            stays[gone], rank[gone] = False, NONE
            after[at] = after[gone]
            before[after[at]] = at
            before[n] = n
            left = before[at]
            fresh = np.unique(np.concatenate([at, left[left < n]]))
            rank[fresh] = self._rank(symbols[fresh], symbols[after[fresh]])
            wait(fresh)
        return symbols[:n][stays], word[stays]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over all of them."""
        spelled = [w.encode() for w in words]
        widths = np.array([len(s) for s in spelled], np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for long in (False, True):
            mine = np.flatnonzero((widths > LONG) == long)
            if not len(mine):
                continue
            symbols = self.byte_ids[np.frombuffer(b"".join([spelled[k] for k in mine]), np.uint8)]
            word = np.repeat(np.arange(len(mine)), widths[mine])
            symbols, word = self._by_rank(symbols, word) if long else self._by_word(symbols, word, len(mine))
            for k, ids in zip(mine, np.split(symbols, np.searchsorted(word, np.arange(1, len(mine))))):
                out[k] = ids
        return out

    # texts -----------------------------------------------------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        if self.cuts is None or not self.cuts.search(text):
            return WORDS.findall(text)
        return [w for k, part in enumerate(self.cuts.split(text)) for w in ([part] if k % 2 else WORDS.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers; new words of all texts are merged together."""
        cut = [self._words(t) for t in texts]
        held = {c: np.array([i], "<i4").tobytes() for c, i in self.special.items()}
        new = []
        for w in set().union(*cut):
            ids = self.young.get(w) or self.old.get(w)
            if ids is not None:
                held.setdefault(w, ids)
            elif w not in held:
                new.append(w)
        for w, ids in zip(new, self.encode_words(new)):
            held[w] = ids.astype("<i4").tobytes()
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        self.young.update((w, ids) for w, ids in held.items() if len(w) <= KEPT and w not in self.special)
        return [b"".join([held[w] for w in words]) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: the bytes of all tokens gathered at once."""
        ids = ids[(ids >= 0) & (ids < len(self.widths))]
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        if not len(ends) or not ends[-1]:
            return ""
        at = np.repeat(self.places[ids] - (ends - widths), widths) + np.arange(ends[-1])
        return self.spelled[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def worker_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _mapped(docs: DataFrame, source: str, kind: T.DataType, empty, out: str, out_kind: T.DataType, keep: list[str] | None, run) -> DataFrame:
    """``docs`` with a column ``out`` that ``run`` makes of the column ``source``, whatever the other columns are named."""
    keep = besides(docs.columns if keep is None else keep, out)
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)], F.coalesce(docs[source].cast(kind), empty).alias("source"))
    schema = T.StructType([T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)] + [T.StructField("out", out_kind)])
    found = rows.mapInArrow(run, schema)
    return found.select(*[found[f"c{k}"].alias(c) for k, c in enumerate(keep)], found["out"].alias(out))


def encode_texts(docs: DataFrame, vocab_path: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the ids of the whole text, an array of int. ``keep``: the columns to keep, all by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocab_path)
        for batch in slices(batches, "source", 2 << 20):
            ids = bpe.encode(batch.column("source").to_pylist())
            ends = np.cumsum([0] + [len(b) // 4 for b in ids], dtype=np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), values)], names=[*batch.schema.names[:-1], "out"])

    return _mapped(docs, text_col, T.StringType(), F.lit(""), out, T.ArrayType(T.IntegerType()), keep, run)


def decode_ids(rows: DataFrame, vocab_path: str, ids_col: str = "ids", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: the text that the ids stand for, special tokens included. ``keep``: the columns to keep, all by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocab_path)
        for batch in batches:
            column = batch.column("source")
            values = column.values.fill_null(-1).to_numpy()
            ends = column.offsets.to_numpy()
            texts = [bpe.decode(values[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "out"])

    return _mapped(rows, ids_col, T.ArrayType(T.IntegerType()), F.array().cast("array<int>"), out, T.StringType(), keep, run)
