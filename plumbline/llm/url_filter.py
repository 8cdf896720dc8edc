"""URL filters: a blocked Bloom filter of the listed canonical URLs passes possible hits to an exact hash join.

A listed URL is ``host/path-prefix``. It fits a page if its host is the page's host or a domain above it and the page's
path starts with its path, so a page has a key for each of its domains and each path length that occurs in the list (of
very many different lengths, for each length above the first ``LENGTHS``). The
filter drops the keys that are surely not listed; the few others go to an exact join, which removes the false positives,
and the longest listed URL wins. Beyond a bounded number of listed URLs, the filter stays at its largest size and only
passes more keys to the join.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes from
there to ``?``, ``#`` or the end. Nulls and edge cases: a null URL or one without ``://`` has an empty host and path and
fits nothing; repeated rows are judged alike and all kept; null listed URLs are ignored, and of a URL listed twice the
blocking one counts; very long URLs give no more keys than domains times path lengths; further columns pass through; an
empty table gives an empty result, an empty list the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bloom import BlockedBloom
from plumbline.llm.common import cut

#: More listed URLs than this are added to the filter in several reads of the list.
LIST_BLOCK = 500_000
#: Of more different path lengths than this, all lengths above these are tried.
LENGTHS = 4096
#: Characters of keys that are looked up at a time.
KEY_CHARS = 1 << 24


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = _after(url)
    full = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.length(F.substring_index(full, "/", 1))
    return F.substring(full, host + 1, F.length(full))


def _after(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _hashes(keys: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def listed_filter(listed: DataFrame, bits_per_key: int = 16) -> tuple[BlockedBloom, list[int], range]:
    """The filter, the least path lengths of ``listed(rule)`` and the range in which its other ones lie. The driver sees the list in blocks of bounded size."""
    n = listed.count()
    every = listed.select(F.length(F.col("path")).alias("n"))
    lengths = [r[0] for r in every.distinct().orderBy("n").limit(LENGTHS + 1).collect()]
    beyond = range(0)
    if len(lengths) > LENGTHS:
        beyond = range(lengths.pop(), every.agg(F.max("n")).first()[0] + 1)
    bloom = BlockedBloom(n, bits_per_key)
    blocks = max(1, -(-n // LIST_BLOCK))
    part = F.pmod(F.xxhash64("rule"), F.lit(blocks))
    for k in range(blocks):
        keys = [r[0] for r in listed.filter(part == k).select("rule").collect()]
        if keys:
            bloom.add(_hashes(keys))
    return bloom, lengths, beyond


def match_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``url, rule, action, list``: for every different URL that fits a listed one, the longest of these.

    ``listed``: ``rule`` (``host/path``), ``action`` (``allow`` or ``block``) and ``list`` (its name; a rule of list ``a``
    goes before one of list ``b``).
    """
    # one row per rule, with the list that comes first and then the stricter action
    rules = listed.filter(F.col("rule").isNotNull()).select("rule", "action", "list")
    rules = rules.groupBy("rule").agg(F.min(F.struct("list", F.when(F.col("action") == "block", 0).otherwise(1).alias("o"), "action")).alias("m"))
    rules = rules.select("rule", F.col("m.action").alias("action"), F.col("m.list").alias("list"), F.substring("rule", F.length(F.substring_index("rule", "/", 1)) + 1, F.length("rule")).alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(listed_filter(rules))
    parsed = pages.select(F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).filter(F.length("host") > 0)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, lengths, beyond = shared.value

        def passed(batch: pa.RecordBatch, rows: list[int], keys: list[str]) -> pa.RecordBatch:
            hit = np.flatnonzero(bloom.might_contain(_hashes(keys)))
            return pa.RecordBatch.from_arrays([batch.column("url").take(pa.array([rows[i] for i in hit], pa.int64())), pa.array([keys[i] for i in hit], pa.string())], names=["url", "rule"])

        for batch in batches:
            rows, keys, chars = [], [], 0
            for row, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                domains = [host]
                while "." in domains[-1]:
                    domains.append(domains[-1].split(".", 1)[1])
                for n in chain(lengths, beyond):
                    if n > len(path):
                        break
                    start = path[:n]
                    keys += [d + start for d in domains]
                    rows += [row] * len(domains)
                    chars += len(domains) * (len(host) + n)
                    if chars > KEY_CHARS:
                        yield passed(batch, rows, keys)
                        rows, keys, chars = [], [], 0
            if keys:
                yield passed(batch, rows, keys)

    hits = parsed.mapInArrow(possible, "url string, rule string").distinct()
    exact = hits.join(rules.select("rule", "action", "list"), "rule")
    # the first list wins over the others; within a list the longest rule
    best = exact.groupBy("url").agg(F.min(F.struct("list", (-F.length("rule")).alias("n"), "rule", "action")).alias("m"))
    return best.select("url", F.col("m.rule").alias("rule"), F.col("m.action").alias("action"), F.col("m.list").alias("list"))


def judge_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, list, verdict`` to every row of ``pages`` (own columns of these names give way)."""
    found = cut(match_urls(pages, listed, url_col).select(F.col("url").alias("_url"), F.col("rule").alias("_rule"), "action", F.col("list").alias("_list")), "url-verdicts")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "list", "verdict")]
    joined = pages.join(found, pages[url_col] == found["_url"], "left")
    return joined.select(
        *[pages[c] for c in own], host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), found["_rule"].alias("rule"), found["_list"].alias("list"), F.coalesce(found["action"], F.lit(default)).alias("verdict")
    )
