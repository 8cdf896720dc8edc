"""Exact ids and exact token counts at every prefix for a BPE vocabulary with word ends.

The vocabulary's own library drops white space, so a text is a sequence of *chunks* (runs without white space) that
tokenise independently. Chunks repeat, so both tables below are bounded caches by chunk.

Prefix dynamic programming. Let ``s`` be the byte symbols of one pre-token. In BPE every run of neighbouring tokens of
an encoding is itself the encoding of the symbols it covers. So the encoding of ``s[:i]`` is that of some ``s[:k]``
followed by one token, and the right token is the only one that does not merge differently with the last token of
``s[:k]``. ``count[i] = count[k] + 1`` then gives the exact number of tokens at every prefix in one pass with bounded
look-back. A prefix that ends there has the word end on its last symbol, so it has a second table of last tokens.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import regex

from plumbline.llm.common import Recent

# Fixed values of the vocabulary's pre-tokenizer: its pattern, its white space and its special strings.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"

#: Python takes these for white space too; the vocabulary's library doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
FAST_UNITS = re.compile(r"\S*\s+|\S+")
UNITS = re.compile(f"[^{WHITE}]*[{WHITE}]+|[^{WHITE}]+")
CHUNKS = re.compile(f"[^{WHITE}]+")
#: Chunks for which lower-casing and NFC change no length: ASCII and Latin-1, where PIECES is the same as this pattern.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]*")
PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def byte_symbols() -> list[str]:
    """One printable character for each byte: printable bytes stand for themselves, the others follow from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Ids and prefix counts for one vocabulary file; made once in each Python worker."""

    def __init__(self, path: str, cache: int = 150_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.symbols = byte_symbols()
        self.tokens_of = Recent(self._piece_ids, cache)
        self.ids = Recent(self._chunk_ids, cache)
        self.prefix = Recent(self._unit_counts, cache)
        self.table = Recent(self._piece_counts, cache)
        self.apart = Recent(self._stay_apart, cache)
        self.right_ends: dict = {}
        self.left_ends: dict = {}

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {tuple(pair if isinstance(pair, list) else pair.split(" ")): k for k, pair in enumerate(self._model["merges"])}

    @cached_property
    def _model(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)["model"]

    @cached_property
    def halves(self) -> dict[str, tuple[str, str]]:
        """The pair that each merged token is made of."""
        out: dict[str, tuple[str, str]] = {}
        for pair in self.ranks:
            out.setdefault("".join(pair), pair)
        return out

    @cached_property
    def places(self) -> dict[str, int]:
        """For each run of symbols that is a token: 1 inside a word, 2 at its end, 3 both."""
        out: dict[str, int] = {}
        for token in self._model["vocab"]:
            symbols, bit = (token[: -len(END)], 2) if token.endswith(END) else (token, 1)
            out[symbols] = out.get(symbols, 0) | bit
        return out

    # ids -------------------------------------------------------------------------------------------------------

    def _mapped(self, piece: str) -> str:
        if piece.isascii():
            return piece
        return "".join([self.symbols[b] for b in piece.encode()])

    def _piece_ids(self, piece: str) -> bytes:
        found = self.library.model.tokenize(self._mapped(piece))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _chunk_ids(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            lower = chunk.lower()
            if lower.isalpha():
                return self.tokens_of[lower]
            return b"".join([self.tokens_of[p] for p in PLAIN_PIECES.findall(lower)])
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        chunks = CHUNKS.findall(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.ids.__getitem__, chunks))

    # prefix counts ---------------------------------------------------------------------------------------------

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that stand at one end of ``token`` while it is being merged, each with the rank of the merge
        that takes it up; ``side`` 1 is the right end, 0 the left one."""
        up, out = 1 << 30, []
        while True:
            out.append((token, up))
            if token not in self.halves:
                return out[::-1]
            up, token = self.ranks[self.halves[token]], self.halves[token][side]

    def _stay_apart(self, key: tuple[str, str, bool]) -> bool:
        """Whether BPE of two tokens' symbols gives just these two tokens: walk up both spines at the border in the
        order of the merges, and see that no pair that meets there merges before one of the two is taken up."""
        left, right, ends = key
        if ends:
            right += END
        rights = self.left_ends.get(right) or self.left_ends.setdefault(right, self._spine(right, 0))
        if not left:
            return True
        lefts = self.right_ends.get(left) or self.right_ends.setdefault(left, self._spine(left, 1))
        i = j = 0
        while True:
            (a, a_up), (b, b_up) = lefts[i], rights[j]
            rank = self.ranks.get((a, b))
            if rank is not None and rank < a_up and rank <= b_up:
                return False
            if a_up == b_up == 1 << 30:
                return True
            if a_up <= b_up:
                i += 1
            else:
                j += 1

    @cached_property
    def tails(self) -> set[str]:
        """All ends of tokens: a run that isn't one has no longer token behind it."""
        return {t[k:] for t in self.places for k in range(len(t))}

    def _sorted_counts(self, pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The tables of pieces (as symbols, in order): what a piece shares with the one before isn't computed again."""
        places, apart, tails = self.places, self.apart, self.tails
        last, count, done = [""], [0], [0]  # of each prefix: its last token inside a word, its tokens, its tokens as a whole word
        before = ""
        for s in pieces:
            same = 0
            for x, y in zip(s, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :], done[same + 1 :]
            for i in range(same + 1, len(s) + 1):
                runs = []
                for k in range(i - 1, -1, -1):
                    run = s[k:i]
                    if run not in tails:
                        break
                    runs.append(run)
                token, inside, whole, open_ = "", 0, 0, 3
                for n in range(len(runs), 0, -1):
                    run = runs[n - 1]
                    fits = places.get(run, 0) & open_
                    if fits:
                        left = last[i - n]
                        if fits & 1 and apart[left, run, False]:
                            token, inside, open_ = run, count[i - n] + 1, open_ ^ 1
                        if fits & 2 and apart[left, run, True]:
                            whole, open_ = count[i - n] + 1, open_ ^ 2
                        if not open_:
                            break
                last.append(token)
                count.append(inside)
                done.append(whole)
            before = s
            yield s, done[1:]

    def _piece_counts(self, piece: str) -> list[int]:
        """For each character of a pre-token, the tokens of the pre-token cut after it."""
        return self._by_character(piece, next(self._sorted_counts([self._mapped(piece)]))[1])

    @staticmethod
    def _by_character(piece: str, done: list[int]) -> list[int]:
        if piece.isascii():
            return done
        return [done[i - 1] for i in np.cumsum([len(c.encode()) for c in piece])]

    def prime(self, texts: list[str]) -> None:
        """Fill the tables for new units of many texts at once, their pieces in order."""
        units: set[str] = set()
        for text in texts:
            units.update((UNITS if any(c in text for c in SEPARATORS) else FAST_UNITS).findall(text))
        new = {}
        for unit in units:
            if unit not in self.prefix and unit not in self.prefix.old:
                for piece in PLAIN_PIECES.findall(unit.rstrip(WHITE).lower()):
                    if piece not in self.table:
                        new[self._mapped(piece)] = piece
        for symbols, done in self._sorted_counts(sorted(x for x in new if len(x) < 200)):
            self.table[new[symbols]] = self._by_character(new[symbols], done)

    def _unit_counts(self, unit: str) -> bytes:
        """For each character of a chunk and the white space after it, the tokens of the unit cut after it."""
        chunk = unit.rstrip(WHITE)
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            lower = chunk.lower()
            if lower.isalpha():
                out = self.table[lower][:]
            else:
                out, base = [], 0
                for piece in PLAIN_PIECES.findall(lower):
                    if piece[0] == "'" and piece[1:].isalpha():  # cut, it is another sequence of pieces
                        steps = [sum(self.table[p][-1] for p in PLAIN_PIECES.findall(piece[:j])) for j in range(1, len(piece))] + [self.table[piece][-1]]
                    else:
                        steps = self.table[piece]
                    out += [base + c for c in steps] if base else steps
                    base = out[-1]
        else:
            out = [len(self.library.encode(chunk[:j], add_special_tokens=False).ids) for j in range(1, len(chunk) + 1)]
        out += [out[-1] if out else 0] * (len(unit) - len(chunk))
        return struct.pack(f"<{len(out)}I", *out)

    def prefix_counts(self, text: str) -> np.ndarray:
        """``out[i]`` is the exact number of tokens of ``text[:i + 1]``."""
        if not text:
            return np.zeros(0, "<u4")
        units = (UNITS if any(c in text for c in SEPARATORS) else FAST_UNITS).findall(text)
        parts = list(map(self.prefix.__getitem__, units))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        local = np.frombuffer(b"".join(parts), "<u4")
        totals = local[np.cumsum(sizes) - 1].astype(np.int64)
        return (local + np.repeat(np.cumsum(totals) - totals, sizes)).astype("<u4")


@lru_cache(maxsize=2)
def worker_bpe(path: str) -> WordBpe:
    return WordBpe(path)
