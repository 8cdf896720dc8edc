"""Best-fit packing of token pieces into sequences of a fixed capacity.

Large-item matching. Pieces over a third of the capacity fit at most twice in a sequence: from the largest down, each
opens a sequence and takes the largest unmatched partner over a third that still fits. The smaller pieces then fill the
remaining gaps, best fit first, from the largest piece down.

The plan is made over *lengths*, not pieces. There are at most ``capacity`` lengths, and all pieces of a length are
alike, so the plan needs only the count of pieces by length (a fixed-size table, whatever the corpus) and handles runs of
equal sequences at once. It is a list of *placements*: of the pieces of one length, those with rank ``first`` to
``first + n - 1`` go to consecutive sequences at one offset. Each piece finds its own placement from its rank in its
length. The result is the one that packing piece by piece would give.

Nulls and edge cases: a null or empty text has the end token alone; a null id is kept; repeated rows are packed as often
as they occur; an empty table gives an empty result. Pieces are only cut at whole capacities, and none is dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, slices
from plumbline.llm.wordbpe import worker_bpe

Placement = tuple[int, int, int, int, int, int]  # length, first rank, pieces, first sequence, pieces in each sequence, offset


def token_pieces(docs: DataFrame, vocab_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids`` (little-endian 32 bits)."""
    if not 0 < capacity < 1 << 20:
        raise ValueError("capacity must be from 1 to 2**20 - 1 tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    last = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocab_path)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = bpe.encode(text) + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at >> 2, len(part) >> 2, zlib.crc32(part), part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements for ``counts[length]`` pieces of each length, and the number of sequences."""
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is outside 1..capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    out: list[Placement] = []
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, count) that have it

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, used[length], n, first, each, offset))
        used[length] += n
        left[length] -= n

    # Large items: the largest left opens sequences; its partner is the largest that fits.
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        k = bisect_left(large, capacity - top + 1) - 1
        mate = large[k] if k >= 0 else None
        if mate is None:
            n, gap = left[top], capacity - top
            place(top, n, sequences, 1, 0)
        elif mate == top:
            n, gap = left[top] // 2, capacity - 2 * top
            if n:
                place(top, 2 * n, sequences, 2, 0)
            else:  # one is left; the next smaller is its partner
                mate = large[k - 1] if k else None
                n, gap = 1, capacity - top - (mate or 0)
                place(top, 1, sequences, 1, 0)
                if mate:
                    place(mate, 1, sequences, 1, top)
        else:
            n, gap = min(left[top], left[mate]), capacity - top - mate
            place(top, n, sequences, 1, 0)
            place(mate, n, sequences, 1, top)
        if n and gap:
            gaps.setdefault(gap, []).append((sequences, n))
        sequences += n
        large = [x for x in large if left[x]]

    # Smaller items: best fit, that is the smallest gap that takes the piece; a sequence just filled has the smallest gap
    # of all that still fit, so it goes on taking pieces of this length.
    order = sorted(gaps)
    for length in sorted((k for k in left if left[k]), reverse=True):
        while left[length]:
            k = bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                n = -(-left[length] // each)
                gaps.setdefault(capacity, []).append((sequences, n))
                sequences += n
                insort(order, capacity)
                continue
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            each = min(gap // length, left[length])
            full = left[length] // each
            take = min(n, full)
            place(length, take * each, first, each, capacity - gap)
            for at, m, g in ((first, take, gap - each * length), (first + take, n - take, gap)):
                if m and g:
                    if g not in gaps:
                        insort(order, g)
                    gaps.setdefault(g, []).append((at, m))
    return out, sequences


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), salt_rows: int = 2_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a length. ``pieces`` is read twice, so it should be a table
    or the result of ``cut``.

    A piece's rank in its length comes from two small counts: pieces are numbered within (length, salt), where the salt
    is a hash of the piece, and the salts' totals are summed up. The number of salts grows with the rows, so no task
    has to order more than about ``salt_rows`` pieces of even the most common length.
    """
    spark = pieces.sparkSession
    by_length = {r[0]: r[1] for r in pieces.groupBy(F.col(length_col).cast("long")).count().collect()}  # at most `capacity` rows
    placements, _ = plan(by_length, capacity)
    salts = max(1, -(-max(by_length.values(), default=1) // salt_rows))
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order_cols), F.lit(salts)).cast("int"))
    if salts > 1:
        totals = rows.groupBy(F.col(length_col).cast("long").alias("l"), "_salt").count()
        w = F.sum("count").over(_before("l", "_salt"))
        shifts = totals.select(F.col("l").alias("_length"), F.col("_salt").alias("_salted"), F.coalesce(w, F.lit(0)).alias("_shift"))
        rows = rows.join(shifts, (F.col(length_col) == F.col("_length")) & (F.col("_salt") == F.col("_salted")), "left").drop("_length", "_salted")
    else:
        rows = rows.withColumn("_shift", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order_cols)) - 1 + F.col("_shift")
    ranked = rows.withColumn("_rank", rank.cast("long"))

    # The plan has a few entries per length; it is at most some thousand rows, whatever the corpus.
    placements.sort()
    table = np.array(placements, np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    keep = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_rows = shared.value
        width = int(plan_rows[:, 1].max(initial=0)) + int(plan_rows[:, 2].max(initial=0)) + 1
        keys = plan_rows[:, 0] * width + plan_rows[:, 1]
        for batch in batches:
            length = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            _, first, _, seq, each, offset = plan_rows[at].T if len(at) else np.zeros((6, 0), np.int64)
            step = rank - first
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(seq + step // np.maximum(each, 1)), pa.array(offset + step % np.maximum(each, 1) * length)], names=[*keep, "sequence_id", "offset"]
            )

    return ranked.select(*keep, "_rank").mapInArrow(locate, schema)


def _before(group: str, order: str):
    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut what is longer than ``capacity``, and pack: a row per piece with its sequence and its place there; further columns are dropped.

    Pieces are stored with a number of their own, so that repeated rows are dealt to different salts too."""
    pieces = token_pieces(docs, vocab_path, end_id, capacity, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    return pack(cut(pieces, "pieces"), capacity, order_cols=("doc_id", "piece", "_row")).drop("_row")


def pack_one_by_one(lengths: list[int], capacity: int) -> int:
    """The number of sequences when every piece is handled on its own: the plain form that tests compare with."""
    large = sorted((x for x in lengths if 3 * x > capacity))
    gaps = []
    while large:
        top = large.pop()
        k = bisect_left(large, capacity - top + 1) - 1
        gaps.append(capacity - top - (large.pop(k) if k >= 0 else 0))
    gaps.sort()
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        k = bisect_left(gaps, x)
        insort(gaps, (gaps.pop(k) if k < len(gaps) else capacity) - x)
    return len(gaps)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No packing can have fewer sequences."""
    half = sum(2 * x > capacity for x in lengths)
    return max(half, -(-sum(lengths) // capacity))


__all__ = ["lower_bound", "pack", "pack_documents", "pack_one_by_one", "plan", "token_pieces"]
