"""Set checks between tables: duplicates, leakage, coverage, pairing and contracts. Results are data; ``require_empty`` fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_empty(found: DataFrame, what: str, show: int = 20) -> None:
    rows = found.limit(show).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key: an aggregate with map-side combine, not a sort of the whole group. Equal orders: the
    least of the other columns."""
    others = [c for c in rows.columns if c not in keys]
    at = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{k}") for k, c in enumerate(order)], F.struct(*others).alias("r"))
    return rows.groupBy(*keys).agg(F.min(at).alias("m")).select(*[F.col("m.r")[c].alias(c) if c not in keys else F.col(c) for c in rows.columns])


def leakage(rows: DataFrame, digest: str = "digest", split: str = "split") -> DataFrame:
    """Digests in several splits, with the splits."""
    return rows.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.sort_array(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def overlap(rows: DataFrame, holdout: DataFrame, key: str, holdout_key: str) -> DataFrame:
    """Rows whose key is held out."""
    return rows.join(holdout.select(F.col(holdout_key).alias("_held")).distinct(), F.col(key) == F.col("_held"), "left_semi")


def contained(rows: DataFrame, holdout: DataFrame, text: str, holdout_text: str, row_id: str, holdout_id: str, words: int = 5) -> DataFrame:
    """Pairs of ids where a held-out text stands inside a row's text, found by its first words and then verified.

    An equi-join on hashed word windows, so neither side is compared with all of the other; held-out texts with fewer words
    are found through their first word. A held-out text may be cut out of the middle of words at its ends, so windows start at every
    place where a word ends with the held-out text's first word."""
    clean = lambda c: F.split(c, r"\s+")
    key = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(1, words - 1)])
    held = holdout.select(F.col(holdout_id).alias("holdout_id"), F.col(holdout_text).alias("_held")).filter(F.length("_held") > 0)
    held = held.withColumn("_w", clean(F.col("_held")))
    long_, short = held.filter(F.size("_w") >= words), held.filter(F.size("_w") < words)
    windows = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("_text"), clean(F.col(text)).alias("_w")).filter(F.size("_w") >= words)
    windows = windows.select("row_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_w") - words), lambda i: key(F.col("_w"), i)))).alias("_key"))
    pairs = windows.join(long_.select("holdout_id", key(F.col("_w"), F.lit(0)).alias("_key")), "_key").select("row_id", "holdout_id").distinct()
    texts = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("_text"))
    sure = pairs.join(texts, "row_id").join(held.select("holdout_id", "_held"), "holdout_id").filter(F.contains("_text", "_held")).select("row_id", "holdout_id")
    few = texts.join(short.select("holdout_id", "_held"), F.contains("_text", "_held")).select("row_id", "holdout_id")
    return sure.unionByName(few).distinct()


def coverage(left: DataFrame, right: DataFrame, key: str, compare: list[str] = ()) -> DataFrame:
    """Keys that one side lacks or whose compared fields differ: ``key, status`` (``missing``, ``extra`` or ``differs``).

    A key may come often, and null is a key: its rows with the same fields on both sides cancel out one by one; of those left over, as many as both sides have
    differ, and the rest is missing or extra, a row of the result each. Only counts are shuffled."""
    side = lambda df, l, r: df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(compare)], F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    both = side(left, 1, 0).unionByName(side(right, 0, 1))
    surplus = both.groupBy("_key", *[f"_c{k}" for k in range(len(compare))]).agg(F.sum(F.col("_l") - F.col("_r")).alias("_d"))
    rest = surplus.groupBy("_key").agg(F.sum(F.greatest("_d", F.lit(0))).alias("_l"), F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("_r")).filter("_l > 0 or _r > 0")
    pair = F.least("_l", "_r")
    found = F.array(*[F.struct(F.lit(s).alias("status"), n.alias("n")) for s, n in (("missing", F.col("_l") - pair), ("extra", F.col("_r") - pair), ("differs", pair))])
    counted = rest.select("_key", F.inline(found)).filter("n > 0")
    # in two steps, so that no array is as long as a key has rows
    chunks = counted.withColumn("_at", F.explode(F.expr("sequence(0L, n - 1, 4096L)")))
    return chunks.select("_key", "status", F.explode(F.expr("sequence(_at, least(n, _at + 4096) - 1)"))).select(F.col("_key").alias(key), "status")


def pairing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that aren't on both sides exactly once, with both counts."""
    a = left.groupBy(*keys).agg(F.count("*").alias("left_n"))
    b = right.groupBy(*keys).agg(F.count("*").alias("right_n"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return a.join(b, keys, "full_outer").select(*keys, n("left_n"), n("right_n")).filter("left_n != 1 or right_n != 1")


def multiset_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How often each side has a value more than the other: ``key, missing, extra`` where these differ."""
    a, b = left.groupBy(key).agg(F.count("*").alias("a")), right.groupBy(key).agg(F.count("*").alias("b"))
    d = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return a.join(b, key, "full_outer").select(key, F.greatest(d, F.lit(0)).alias("missing"), F.greatest(-d, F.lit(0)).alias("extra")).filter("missing > 0 or extra > 0")


def several_values(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that aren't the same in all rows (null counts as a value): ``field, n_values``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    counts = rows.agg(*[F.count_distinct(text(c)).alias(c) for c in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in fields]))
    return counts.select(pairs.alias("p")).select("p.field", "p.n_values").filter("n_values > 1")


def contract_difference(expected: DataFrame, saved: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Fields of a contract whose saved value differs or is missing: ``name, expected, saved``."""
    a = expected.select(F.col(name).alias("name"), F.col(value).alias("expected"))
    b = saved.select(F.col(name).alias("name"), F.col(value).alias("saved"))
    return a.join(b, "name", "left").filter(~F.col("expected").eqNullSafe(F.col("saved")))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key hasn't been done, found before any costly step."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def changed_fields(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows on both sides whose fields changed, with the names of these."""
    a = before.select(*key, *[F.col(c).alias(f"_a_{c}") for c in fields])
    b = after.select(*key, *[F.col(c).alias(f"_b_{c}") for c in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in fields]))
    return a.join(b, key).select(*key, names.alias("changed")).filter(F.size("changed") > 0)
