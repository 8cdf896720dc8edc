"""Quality classifier from compression: zstandard dictionaries of good and of bad labelled text.

A text that reads like the good examples compresses better with the dictionary built from them. Texts are compressed in
pieces, so that a dictionary says as much about the end of a long text as about its start. The inputs of the score are
normalised compressed sizes: the difference between both dictionaries by compressed size, the size by length with the good
one, and how much smaller the whole text is than its pieces (repeated text); a logistic curve, fitted on labelled rows that
the dictionaries have not seen, makes a calibrated score of them.

Learning uses at most ``sample_rows`` labelled rows of each class (a documented bound), with their whole texts; scoring takes
every whole text. Nulls and edge cases: a null or empty text scores as the logistic curve has it for zero
sizes; null labels are not learned from; labels of unknown documents are ignored; repeated rows and further columns are
harmless; an empty table gives an empty result, and without examples of both classes every score is the share of the good
ones, 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import besides, slices

PIECE = 2048
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the constant


def dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard as z

    samples = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE) if len(t) - i >= 64]
    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:  # too few samples to train on: their end is the dictionary
        return b"\n".join(samples)[-size:]


class Sizes:
    """The normalised compressed sizes of texts; compressors are made once for each worker."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        make = lambda d: z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d) if d else None, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def __call__(self, text: bytes) -> tuple[float, float, float]:
        if not text:
            return 0.0, 0.0, 0.0
        parts = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        good = sum(len(self.good.compress(p)) for p in parts)
        bad = sum(len(self.bad.compress(p)) for p in parts)
        whole = len(self.good.compress(text)) if len(parts) > 1 else good
        return (bad - good) / (bad + good), good / len(text), 1 - whole / good


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; the last is the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def expand(x: np.ndarray) -> np.ndarray:
    """The inputs and their squares: a share of repeated text may count in both directions."""
    return np.hstack([x, x * x, x[:, :1] * x[:, 1:]])


def fit(rows: list[tuple[str | None, int, bool]], size: int = 96 * 1024) -> QualityModel:
    """``rows``: text, label, and whether the row is for the dictionaries (else for the curve)."""
    text = lambda t: (t or "").encode()
    good = dictionary([text(t) for t, q, d in rows if d and q == 1], size)
    bad = dictionary([text(t) for t, q, d in rows if d and q == 0], size)
    held = [(text(t), q) for t, q, d in rows if not d]
    share = sum(q == 1 for _, q, _ in rows) / len(rows) if rows else 0.5
    labels = np.array([q for _, q in held], float)
    n = len(expand(np.zeros((1, 3)))[0])
    if len(set(labels.tolist())) < 2 or not good or not bad:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(good, bad, (0.0,) * n, (1.0,) * n, (0.0,) * n + (float(np.log(share / (1 - share))),))
    sizes = Sizes(good, bad)
    x = expand(np.array([sizes(t) for t, _ in held]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return QualityModel(good, bad, tuple(mean), tuple(scale), tuple(logistic((x - mean) / scale, labels)))


def scores(model: QualityModel, texts: list[bytes], sizes: Sizes) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x = (expand(np.array([sizes(t) for t in texts])) - np.array(model.mean)) / np.array(model.scale)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from; a row without an id has no label and is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on whole texts: of the ``sample_rows`` labelled rows of each class that come first in a hashed order, without the held-out
    ones. Of documents that repeat an id at most ``4 * sample_rows`` rows count in all, the first by hash."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("q")).filter(F.col("id").isNotNull() & F.col("q").isin(0, 1) & ~held_out(F.col("id")))
    first = lambda q: usable.filter(F.col("q") == q).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    chosen = first(0).unionByName(first(1))  # at most 2 * sample_rows rows of two numbers
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")
    rows = found.select("t", "q", (F.pmod(F.xxhash64(F.col("id"), F.lit("part")), F.lit(2)) == 0).alias("d"), "id").orderBy(F.xxhash64("id", "t"), "id").limit(4 * sample_rows).collect()
    rows.sort(key=lambda r: (r["id"], r["t"] or ""))
    return fit([(r["t"], r["q"], r["d"]) for r in rows])


def with_score(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add ``out``, the calibrated score from 0 to 1, to the columns ``keep`` (all by default); a column named so is
    replaced."""
    keep = besides(docs.columns if keep is None else keep, out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(keep)], F.coalesce(docs[text_col], F.lit("")).alias("text"))
    schema = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.good, m.bad)
        for batch in slices(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(m, texts, sizes), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    found = rows.mapInArrow(run, schema.lstrip(", "))
    return found.select(*[found[f"c{k}"].alias(c) for k, c in enumerate(keep)], found["score"].alias(out))
