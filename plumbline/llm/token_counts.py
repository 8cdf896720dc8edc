"""Token counts: prefix dynamic programming keeps the exact token count at every prefix of every text.

Nulls and edge cases: a null text counts as empty, an empty text has no prefix and no token; very long texts are walked
once with bounded look-back; repeated rows, null ids and further columns (whatever their names) pass through; an empty
table gives an empty result. No row is dropped and nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import besides, slices
from plumbline.llm.wordbpe import worker_bpe


def with_prefix_counts(docs: DataFrame, vocab_path: str, text_col: str = "text", out: str = "prefix_counts", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: binary, one little-endian unsigned 32-bit number per code point; number ``i`` is the exact token
    count of the text's first ``i + 1`` code points. ``keep``: the columns to keep, all by default; one
    named ``out`` is replaced."""
    keep = besides(docs.columns if keep is None else keep, out)
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)], F.coalesce(docs[text_col], F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)] + [T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(vocab_path)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            bpe.prime(texts)
            counts = [bpe.prefix_counts(t).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.binary())], names=[*batch.schema.names[:-1], "counts"])

    found = rows.mapInArrow(run, schema)
    return found.select(*[found[f"c{k}"].alias(c) for k, c in enumerate(keep)], found["counts"].alias(out))


def count_at(counts: Column, chars: Column | int) -> Column:
    """The exact token count of the first ``chars`` code points, read from the stored table (all, if there are fewer)."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, (F.octet_length(counts) / 4).cast("int"))
    raw = F.substring(counts, (n - 1) * 4 + 1, F.lit(4))
    big = F.concat(*[F.substring(F.hex(raw), 2 * k + 1, 2) for k in (3, 2, 1, 0)])
    return F.when(n <= 0, F.lit(0)).otherwise(F.conv(big, 16, 10).cast("long")).cast("long")


@F.pandas_udf(T.LongType())
def _fit(counts: pd.Series, budget: pd.Series) -> pd.Series:
    def one(blob, most):
        if blob is None or pd.isna(most):
            return None
        within = np.flatnonzero(np.frombuffer(blob, "<u4") <= most)
        return int(within[-1]) + 1 if len(within) else 0

    return pd.Series([one(*x) for x in zip(counts, budget)], dtype="Int64")


def longest_prefix_within(counts: Column, budget: Column | int) -> Column:
    """The longest prefix, in code points, that has at most ``budget`` tokens: where to truncate, without encoding again."""
    return _fit(counts, F.lit(budget) if isinstance(budget, int) else budget)


def read_count(blob: bytes, chars: int) -> int:
    """``count_at`` for one blob outside Spark."""
    n = min(chars, len(blob) // 4)
    return struct.unpack_from("<I", blob, 4 * (n - 1))[0] if n > 0 else 0
