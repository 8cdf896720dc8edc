"""The Jaccard join and line dedup against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import jaccard, line_dedup, queries
from plumbline.llm.components import components
from plumbline.llm.shingles import folded, least_difference, parity_sketch

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall((text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """Components by brute force: ``[(doc_id, text)]``."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            r, s = root(a), root(b)
            up[max(r, s)] = min(r, s)
    return {i: (len(x), root(i)) for i, x in sets}


def variants(n, words=120, edits=2, seed=0):
    """A family of near copies with chains: texts that only others connect."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_jaccard_join(spark, sf_dir).collect()}
    assert found == classes(rows)


def test_large_families_and_borderline_links(spark, monkeypatch):
    # small bounds, so that groups with leaders, derived answers and members far from the leader all occur
    monkeypatch.setattr(jaccard, "GROUP_MIN", 4)
    monkeypatch.setattr(jaccard, "FREQUENT_MIN", 5)
    texts = variants(60, 120, 3, 1) + variants(60, 60, 3, 2) + variants(30, 8, 1, 3) + ["same text of a few words here"] * 20
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    assert run(spark, rows) == classes(sorted(rows))


def test_members_of_groups_meet_only_where_both_leave_room(spark, monkeypatch):
    """Groups with leaders that don't link: the join of their members has the bound as its condition, and is not a product that a later filter thins out."""
    monkeypatch.setattr(jaccard, "GROUP_MIN", 4)
    plans, cut = [], jaccard.cut

    def seen(df, name, *more):
        if name in ("nearest", "candidates"):
            plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return cut(df, name, *more)

    monkeypatch.setattr(jaccard, "cut", seen)
    texts = variants(60, words=60, edits=6, seed=11)
    found = run(spark, list(enumerate(texts)))
    assert found == classes(list(enumerate(texts)))
    at = [n for n, _ in plans].index("nearest")
    first = next(x for x in plans[at + 1][1].splitlines() if "Join" in x)
    assert "Join Inner" in first and "_s" in first and ">=" in first


def test_members_whose_sketches_differ_too_much_do_not_meet(spark, monkeypatch):
    """The join of members makes no pair that the sketches would rule out after it."""
    monkeypatch.setattr(jaccard, "GROUP_MIN", 4)
    sizes, cut = [], jaccard.cut

    def seen(df, name, *more):
        out = cut(df, name, *more)
        sizes.append((name, out.count() if name in ("candidates", "likely") else 0))
        return out

    monkeypatch.setattr(jaccard, "cut", seen)
    texts = variants(60, words=60, edits=6, seed=11)
    assert run(spark, list(enumerate(texts))) == classes(list(enumerate(texts)))
    after = sizes[[n for n, _ in sizes].index("nearest") :]
    met, likely = ([n for name, n in after if name == x] for x in ("candidates", "likely"))
    assert met and met == likely and sum(met)


def test_join_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d e f " * 2000), (None, "a b c d e")]
    found = run(spark, rows)
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[4] == (1, 4) and found[5] == (1, 4) and found[6] == (1, 6)
    assert found[7] == (1, 7) and found[None] == (1, None)
    docs = spark.createDataFrame([], "doc_id long, text string, n int, lo long, component_id int")
    assert jaccard.jaccard_components(docs).count() == 0
    kept = jaccard.keep_one_of_each(spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, None, 7), (None, "x", 8)], "doc_id long, text string, n int"))
    assert sorted(r["n"] for r in kept.collect()) == [5, 7, 8]


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 700), (300, 320), (1000, 10)):
        pool = r.integers(0, 1 << 63, 1200, dtype=np.uint64)
        x, y = np.unique(r.choice(pool, n)), np.unique(r.choice(pool, m))
        assert least_difference(parity_sketch(x), parity_sketch(y)) <= len(np.setxor1d(x, y))
        assert least_difference(parity_sketch(x), parity_sketch(x)) == 0


def test_folded_sketches_bound_the_difference():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 700), (300, 320), (2000, 10)):
        pool = r.integers(0, 1 << 63, 2400, dtype=np.uint64)
        x, y = np.unique(r.choice(pool, n)), np.unique(r.choice(pool, m))
        differ = folded(parity_sketch(x)) ^ folded(parity_sketch(y))
        assert len(differ) == len(jaccard.FOLDED) and int(np.bitwise_count(differ).sum()) <= len(np.setxor1d(x, y))


def test_list_pairs_lose_nothing():
    r = random.Random(2)
    for dense in (2, 64):
        posts = np.array([(t, k, n, n, r.randrange(max(1, n // 4))) for t in range(6) for k in range(60) for n in [20 + k % 7]], jaccard.POST)
        found = {tuple(p) for p in jaccard.list_pairs(posts, (80, 100), dense=dense, block=8).tolist()}
        expected = set()
        for t in range(6):
            mine = [p for p in posts if p["token"] == t]
            for a, b in combinations(mine, 2):
                room = min(int(a["most"]) - int(a["pos"]), int(b["most"]) - int(b["pos"]))
                if 180 * room >= 80 * (int(a["least"]) + int(b["least"])) and 100 * min(a["least"], b["least"]) >= 80 * max(a["least"], b["least"]):
                    expected.add((int(min(a["key"], b["key"])), int(max(a["key"], b["key"]))))
        assert found == expected


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (200, 200), (None, 7)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_lines(rows):
    """Lines with an earlier match, by brute force."""
    out, seen = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for k, line in enumerate((text or "").split("\n")):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            if not w:
                continue
            if any(5 * len(w & x) >= 4 * len(w | x) for x in seen):
                out.add((i, k))
            seen.append(w)
    return out


@pytest.mark.parametrize("frequent,few", [(0, 4), (16, 1 << 20), (1 << 17, 1 << 20)])
def test_lines_against_brute_force(spark, monkeypatch, frequent, few):
    monkeypatch.setattr(line_dedup, "ROUNDS", 1 + few % 3)
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    lines = variants(80, 12, 1, 4) + variants(40, 30, 4, 5) + ["short line"] * 9 + ["The same line with enough words in it"] * 9
    r = random.Random(6)
    r.shuffle(lines)
    rows = [(k, "\n".join(lines[k * 6 : k * 6 + 6])) for k in range(len(lines) // 6)] + [(900, None), (901, ""), (902, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs).collect()}
    gone = removed_lines(rows)
    for i, text in rows:
        assert out[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone))


def test_line_plans_print_no_tables(spark, monkeypatch):
    """The driver holds every printed plan: tables that tasks look things up in are megabytes and stay out of them."""
    sizes, cut = {}, line_dedup.cut

    def seen(df, name, *more):
        sizes[name] = max(sizes.get(name, 0), len(df._jdf.queryExecution().toString()))
        return cut(df, name, *more)

    monkeypatch.setattr(line_dedup, "cut", seen)
    rows = [(k, x) for k, x in enumerate(variants(30, 12, 1, 4))]
    line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert "line-facts" in sizes and "later-sets" in sizes
    assert max(sizes.values()) < 200_000


def test_settled_lines_meet_no_more_parts(spark, monkeypatch):
    """A family without common signatures: what the first tokens settle isn't joined by the others."""
    monkeypatch.setattr(line_dedup, "FEW", 1 << 20)
    monkeypatch.setattr(line_dedup, "FIRST", 3)
    made, joined = [], line_dedup._joined

    def seen(marks, part):
        made.append((part, marks.filter("not done").count()))
        return joined(marks, part)

    monkeypatch.setattr(line_dedup, "_joined", seen)
    rows = list(enumerate(variants(120, 30, 2, 8)))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = removed_lines(rows)
    assert {i for i, t in out.items() if t == ""} == {i for i, _ in gone}
    assert made[-1][1] < made[0][1]


def test_line_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    gone = removed_lines(rows)
    out = {r["doc_id"]: r["text"] for r in queries.op9_line_dedup(spark, sf_dir).collect()}
    assert out == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_lines_edge_cases(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "A b c d e f", 3), (None, "q r s t u v", 4), (3, "q r s t u v\nz", 5)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert {r["n"]: r["text"] for r in out} == {1: "a b c d e f", 2: "a b c d e f", 3: "", 4: "q r s t u v", 5: "z"}
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines(spark):
    # equal sets of any size match; 4 words and the 5 that contain them are alike by exactly 0.8, 3 and 4 by less
    rows = [
        (1, "Read more\nAll rights reserved.\nstop\n\na b c d"), (2, "read MORE\nsome rights reserved.\nstop stop\n\nd c b a e"), (3, "more read\nrights all reserved.\nx y z\n \nx y z w"),
        (4, "k l m n o\nk l m n\nk l m\nk k k k k k l"), (5, "l k\nm l k\nn m k p"),
    ]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: rows[0][1], 2: "some rights reserved.\n", 3: "x y z\n \nx y z w", 4: "k l m n o\nk l m\nk k k k k k l", 5: "n m k p"}


def test_line_tokens_split_at_all_white_space(spark):
    lines = ["a b", "A\tb\x0bC\x0cd\r", "  x  x ", "\t\r", "", None, "ä Ö z", "b a a"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")
    h = {w: spark.sql("SELECT xxhash64(w) FROM VALUES (:w) AS t(w)", args={"w": w}).first()[0] for w in ("a", "b", "c", "d", "x", "ä ö", "z")}
    found = [r[0] for r in rows.orderBy("k").select(line_dedup.line_tokens(F.col("line"))).collect()]
    wanted = ["a b", "a b c d", "x", "", "", None, "ä ö z", "a b"]
    assert found == [None if w is None else sorted(h[x] for x in w.split(" ") if x) for w in wanted]
    words = [r[0] for r in rows.orderBy("k").select(line_dedup._has_words(F.col("line"))).collect()]
    assert words == [True, True, True, False, False, None, True, True]


def test_rarity_of_every_slot(spark):
    """The levels of frequent tokens, eight to a number, also of the first slot and of the highest byte."""
    tokens = [k + (j << 40) for j in (0, 5, -3) for k in (0, 1, 7, 8, 15, line_dedup.RARITY_SLOTS - 1)]
    times = {t: 4 + 7 * i for i, t in enumerate(tokens[:6])}
    rows = [([t],) for t, n in times.items() for _ in range(n)] + [(sorted(tokens),)]
    sets = spark.createDataFrame(rows, "tokens array<long>").cache()
    found = sets.withColumn("slots", line_dedup.rarity(sets)).select("tokens", line_dedup.by_rarity(F.col("tokens"), F.col("slots")).alias("x")).filter(F.size("tokens") > 1).first()
    level = lambda t: round(4 * np.log2(times[t & (line_dedup.RARITY_SLOTS - 1)] + 1))
    hashed = lambda t: (t & ((1 << 64) - 1)) >> (64 - line_dedup._HASH_BITS)
    assert found["x"] == sorted((level(t) << line_dedup._HASH_BITS) | hashed(t) for t in tokens)


def test_tokens_are_ordered_in_a_step_of_their_own(spark, monkeypatch):
    """Within a lambda the sort would box every number."""
    plans, cut = [], line_dedup.cut

    def seen(df, name, *more):
        if name == "line-facts":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, name, *more)

    monkeypatch.setattr(line_dedup, "cut", seen)
    rows = [(k, "\n".join(variants(3, words=12, edits=2, seed=k // 2))) for k in range(12)]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = removed_lines(rows)
    assert kept == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    ordered = [x for x in plans[0].splitlines() if "sort_array(" in x]
    assert ordered and not any("slice(" in x for x in ordered)
