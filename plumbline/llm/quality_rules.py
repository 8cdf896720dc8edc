"""Quality rules as a short-circuit cascade, in built-in column functions only.

Each rule says when a text is rejected. On a small sample the operator measures how long each rule takes and what share
it rejects, and asks the rules in the order of rejection per cost; ``CASE WHEN`` stops at the first that rejects. The
order changes the time and the name of the rule that is met first, never the verdict.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Nulls and edge cases: a null text has no word and
is rejected by ``few_words``; empty texts likewise; very long texts take time in proportion to n log n; repeated rows,
null ids and columns with any further names pass through; an empty table gives an empty result and the default order.
Windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":  # a search for a byte each, far cheaper than translating every character
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of five words that the text has twice or more, the first included."""

    def starts(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda p: F.filter(p, lambda x, i: F.coalesce(x["h"] == F.when(i > 0, F.get(p, i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)))
        return F.array_sort(F.transform(let(pairs, twice), lambda x: x["i"]))

    def covered(s: Column) -> Column:
        return F.aggregate(
            s,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("long"), x + WINDOW - F.least(a["end"], x + WINDOW))).alias("n"), (x + WINDOW).cast("long").alias("end")),
            lambda a: a["n"],
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    inner = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts(h), covered)))
    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(inner)


def measure_words(w: Column) -> dict[str, Column]:
    return {"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long")}


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def n_capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Z]+", "")).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is true for a text that the rule turns away."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _long_lines(text: Column, _: Column) -> Column:
    return let(lines_with_words(text), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 30 * F.size(x))


BASE = (
    Rule("few_words", lambda t, w: F.size(w) < 10),
    Rule("repeated_windows", lambda t, w: 100 * repeated_words(w) > 20 * F.size(w)),
)
MORE = (
    Rule("symbols", lambda t, w: 4 * n_symbols(t) > F.size(w)),
    Rule("word_length", lambda t, w: let(F.length(F.array_join(w, "")), lambda n: (n < 2 * F.size(w)) | (n > 15 * F.size(w)))),
    Rule("repeated_lines", _long_lines),
    Rule("capitals", lambda t, w: 2 * n_capitals(t) > F.length(F.array_join(w, ""))),
)
RULES = BASE + MORE


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = 256) -> list[tuple[Rule, float, float]]:
    """The rules with the seconds that they took and the share that they rejected on ``sample_rows`` texts, the best
    rejection per cost first. Only the order of evaluation comes from the sample."""
    spark = docs.sparkSession
    texts = [r[0] for r in docs.select(F.substring(F.col(text_col), 1, 20_000)).limit(sample_rows).collect()]
    if not texts:
        return [(r, 0.0, 0.0) for r in rules]
    sample = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1).withColumn("w", words(F.col("text")))

    def rejected(some: tuple[Rule, ...]) -> tuple:
        return sample.agg(*[F.avg(F.when(r.rejects(F.col("text"), F.col("w")), 1.0).otherwise(0.0)).alias(r.name) for r in some]).first()

    shares = rejected(rules)  # also compiles and loads what the timings need
    timed = []
    for rule in rules:
        began = time.perf_counter()
        rejected((rule,))
        timed.append((rule, time.perf_counter() - began, float(shares[rule.name])))
    return sorted(timed, key=lambda x: (-x[2] / max(x[1], 1e-6), x[0].name))


def verdict(text: Column, order: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule in ``order`` that rejects the text; null if none does."""

    def ask(w: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(order):
            out = F.when(rule.rejects(text, w), F.lit(rule.name)).otherwise(out)
        return out

    return let(words(text), ask)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "rejected_by") -> DataFrame:
    """Add ``out``: the first rule of the cascade that rejects the row, or null."""
    order = [r for r, _, _ in cascade_order(docs, rules, text_col)]
    return docs.withColumn(out, verdict(docs[text_col], order))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns that they had."""
    order = [r for r, _, _ in cascade_order(docs, rules, text_col)]
    return docs.filter(verdict(docs[text_col], order).isNull())


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every text, whether a base rule fails, and the verdict of the whole cascade."""
    order = [r for r, _, _ in cascade_order(docs, MORE, text_col)]
    text = F.coalesce(docs[text_col], F.lit(""))

    def measures(w: Column) -> Column:
        lines = let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        rejected = F.lit(False)
        for rule in reversed(order):
            rejected = F.when(rule.rejects(text, w), F.lit(True)).otherwise(rejected)
        return F.struct(
            *[c.alias(k) for k, c in measure_words(w).items()], n_symbols(text).alias("n_symbols"), lines.alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"), rejected.alias("rejected")
        )

    m = docs.select(docs[id_col].alias("doc_id"), let(words(text), measures).alias("m"))
    failed = (F.col("m.n_words") < 10) | (100 * F.col("m.n_repeat_words") > 20 * F.col("m.n_words"))
    return m.select(
        "doc_id", *[F.col(f"m.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & ~F.col("m.rejected")).alias("kept")
    )


#: DuckDB SQL for ``report`` over ``documents``.
REPORT_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(s) AS n FROM (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS s FROM d) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS caps,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
f AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 30 * len(lines) OR 2 * caps > word_chars) AS kept
FROM f
"""
