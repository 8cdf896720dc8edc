"""Line dedup as an exact set-similarity join, in DataFrame operations and column functions only.

A line is the set of its lower-cased words; lines without words are left alone. A line is removed if an *earlier* line (by
document id, then place), removed or not, has a Jaccard similarity of 0.8 or more with it. So what stays is the first line of
each set that no earlier set is like.

1. Equal lines: one aggregation by a 128-bit hash of the line gives the first place of each; only these go on. Lines that
   differ in order, case or repeats of words alone are one set, and the first place of the set stays.
2. Tokens are counted over all lines and ordered by rarity (of the ``FREQUENT`` most frequent ones, in a table of fixed size;
   the others are rarer than those) and by hash. Two sets that match share two tokens among the first ``n - ceil(0.8 n) + 2``
   of each (prefix filter).
3. Sets that others resemble: those that share a signature are compared with the first of the group. A match settles
   them, so a family of a million variants isn't joined with itself.
4. The others of at least ``NEAR_WORDS`` words (smaller sets match equal ones only) are joined by prefix tokens, with each
   other and with the settled ones, under the length filter, the positional filter and a sketch whose difference bounds that
   of the sets from below. Each is verified, word by word, against the earlier set whose sketch is
   nearest, and if that fails against all the rest.

Steps 3 and 4 change how matches are found, not which: every line with an earlier match is removed, no other.

Nulls and edge cases: null and empty texts stay as they are; a null id counts as earlier than any other; rows that repeat a
document (equal id and text) share their places and are treated alike; a document may lose all its lines and then has the
empty text; very long lines are sets like others; further columns stay, whatever their names; ids may be of any type that has
an order; an empty table gives an empty result. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, drop, unused
from plumbline.llm.quality_rules import let

NEAR_WORDS = 4  # 4 words and 5 that contain them are alike by exactly 4 / 5; sets of 3 and fewer match equal sets only
COMMON = 2  # prefixes are so long that sets that match share at least this many tokens of them
ROUNDS = 3  # the join by prefix tokens runs in so many parts, one after the other, to hold less on disk at once
FIRST = 12  # before them runs one over a token in so many, which settles most of a family
FREQUENT, RARITY_SLOTS = 1 << 17, 1 << 20
BLOOM_WORDS = 1 << 17
WIDE = 48  # sets of so many tokens have signatures of the middle and sketches of parts too
PARTS = ("one", "other", "both")
FEW = 4  # one candidate pair to so many sets
TOP, BASE = 4, 5  # the least similarity, 4 / 5
_HASH_BITS = 55  # of a token's place in the order; above them is its rarity


def line_tokens(line: Column) -> Column:
    """The hashes of a line's different words, in ascending order."""
    rare = "\t\x0b\x0c\r"  # few lines have these, so the others aren't translated
    spaced = F.lower(F.when(line.rlike(f"[{rare}]"), F.translate(line, rare, " " * len(rare))).otherwise(line))
    hashes = F.transform(F.split(spaced, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit("")))))


def _has_words(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def numbered_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, t, line_no, line``: ``t`` is a hash of the text, so that documents that repeat an id aren't mixed up."""
    once = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.split(F.col(text_col), "\n").alias("lines"))  # before there are lines
    return once.select("id", "t", F.posexplode("lines").alias("line_no", "line"))


def line_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each different line: a number ``k``, its ``first`` place and its ``tokens``."""
    lines = numbered_lines(docs, id_col, text_col).filter(_has_words(F.col("line")))
    lines = lines.select(F.xxhash64("line").alias("r1"), F.xxhash64(F.lit("second"), "line").alias("r2"), F.struct("id", "t", "line_no", "line").alias("m"))
    firsts = lines.groupBy("r1", "r2").agg(F.min("m").alias("m"))
    return firsts.select(F.monotonically_increasing_id().alias("k"), F.struct("m.id", "m.t", "m.line_no").alias("first"), line_tokens(F.col("m.line")).alias("tokens"))


def _value(spark: SparkSession, value: bytes | list[int], kind: str) -> Column:
    """A large value as a subquery: a literal would stand, megabytes long, in every printed form of the plans that have it.
    Lambdas take it as a column of the table only, which the optimizer replaces by the subquery."""
    return spark.createDataFrame([(value,)], f"value {kind}").scalar()


def rarity(sets: DataFrame) -> Column:
    """For each slot of token hashes a byte, eight to a number, how often the lines have the frequent token that falls there (in steps
    of a quarter of a doubling); 0 in most slots, where only others fall. At most ``FREQUENT`` tokens are frequent, those above some step."""
    level = F.least(F.lit(127), F.round(4 * F.log2("count")).cast("int"))
    counts = sets.select(F.explode("tokens").alias("h")).groupBy("h").count().filter("count >= 4")
    counts = cut(counts.select(F.col("h").bitwiseAND(F.lit(RARITY_SLOTS - 1)).alias("slot"), level.alias("level")), "token-levels")
    room, least = FREQUENT, 128
    for step, n in sorted(counts.groupBy("level").count().collect(), reverse=True):  # at most 128 rows
        if n > room:
            break
        room, least = room - n, step
    slots = counts.filter(F.col("level") >= least).groupBy("slot").agg(F.max("level").alias("level"))
    listed = slots.agg(F.array_join(F.collect_list(F.concat_ws(":", "slot", "level")), ",")).first()[0]  # of at most FREQUENT
    drop(counts)
    out = bytearray(RARITY_SLOTS)
    for slot, step in (x.split(":") for x in listed.split(",") if x):
        out[int(slot)] = int(step)
    return _value(sets.sparkSession, [x[0] for x in struct.iter_unpack("<q", out)], "array<long>")


def by_rarity(tokens: Column, slots: Column) -> Column:
    """A set's tokens as numbers, rarity above and hash below, so that their order is the common order of tokens."""

    def number(h: Column) -> Column:
        eight = F.get(slots, F.call_function("shiftright", h.bitwiseAND(F.lit(RARITY_SLOTS - 1)), F.lit(3)).cast("int"))
        level = F.call_function("shiftright", eight, F.call_function("shiftleft", h.bitwiseAND(F.lit(7)).cast("int"), F.lit(3))).bitwiseAND(F.lit(127))
        both = F.call_function("shiftleft", level, F.lit(_HASH_BITS)).bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(64 - _HASH_BITS)))
        return F.coalesce(both, F.lit(0).cast("long"))  # never null: numbers that can't be are sorted without comparators

    return F.sort_array(F.transform(tokens, number))


def _alike() -> Column:
    """Whether sizes and sketches of ``a`` and ``b`` leave open that they match."""
    total = F.col("a_n") + F.col("b_n")
    return (BASE + TOP) * F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch"))) <= (BASE - TOP) * total


def _differ_wide() -> Column:
    """The bits in which the part sketches of two sets differ; null if one isn't wide."""
    every, one, other, both = (F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}")) for c in ("sketch", *PARTS))
    ones = lambda x: F.bit_count(x)
    return ones(every.bitwiseXOR(one).bitwiseXOR(other).bitwiseXOR(both)) + ones(one.bitwiseXOR(both)) + ones(other.bitwiseXOR(both)) + ones(both)


def _alike_wide() -> Column:
    """As ``_alike`` with the part sketches of sets that are wide; true for others."""
    return F.coalesce((BASE + TOP) * _differ_wide() <= (BASE - TOP) * (F.col("a_n") + F.col("b_n")), F.lit(True))


def _apart() -> Column:
    """In how many tokens of a thousand of both two sets differ at least, by their sketches."""
    differ = F.coalesce(_differ_wide(), F.bit_count(F.col("a_sketch").bitwiseXOR(F.col("b_sketch"))))
    return (1000 * differ / (F.col("a_n") + F.col("b_n"))).cast("int")


def prefix(numbers: Column) -> Column:
    """Of a stored or projected column, the rarest tokens of a set, as many as the prefix filter needs, by 31 bits of their hashes: numbers that happen to
    be equal may add candidates, never lose one."""

    needed = F.call_function("div", F.size(numbers) * TOP + BASE - 1, F.lit(BASE)).cast("int")  # rounded up
    return F.transform(F.slice(numbers, 1, F.size(numbers) - needed + COMMON), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))


def sketch(tokens: Column) -> Column:
    """64 bits, each whether an odd number of tokens falls there: two sets differ in as many tokens at least as their sketches
    in bits."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(bit(h)))


def part_sketches(tokens: Column) -> list[Column]:
    """Of sets of ``WIDE`` tokens and more the sketches of those with one bit of the hash, with another, and with both, else null. With the sketch of all they make 256 bits,
    since many tokens fill 64."""
    part = lambda bits: F.when(F.size(tokens) >= WIDE, sketch(F.filter(tokens, lambda h: h.bitwiseAND(F.lit(bits)) == bits)))
    return [part(bits).alias(c) for bits, c in zip((64, 128, 192), PARTS)]


def described(sets: DataFrame) -> DataFrame:
    """``k, first, n, sketch``, of sets of ``NEAR_WORDS`` and more the ``prefix``, and signatures ``s``: two of the ends of the
    tokens, of wide sets two more of the middle, of smaller sets one of all."""
    near = F.size("tokens") >= NEAR_WORDS
    # a step of its own, used more than once: within the lambdas of others the numbers would be boxed and sorted by comparators
    sets = sets.withColumn("slots", rarity(sets)).select("k", "first", "tokens", by_rarity(F.col("tokens"), F.col("slots")).alias("numbers"))
    ordered = F.when(near, prefix(F.col("numbers")))
    ends = lambda x: (F.xxhash64(F.slice(x, 1, 3)), F.xxhash64(F.slice(x, -3, 3)))
    above, below = F.filter("tokens", lambda h: h >= 0), F.filter("tokens", lambda h: h < 0)
    two = F.when(F.size("tokens") >= WIDE, F.array(*ends("tokens"), ends(above)[0], ends(below)[1])).otherwise(F.array(*ends("tokens")))
    return sets.select("k", "first", F.size("tokens").alias("n"), ordered.alias("prefix"), sketch(F.col("tokens")).alias("sketch"), *part_sketches(F.col("tokens")), F.when(near, two).otherwise(F.array(F.xxhash64(F.lit("all"), F.col("tokens")))).alias("s"))


def _only(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``k`` may be in one of ``pairs``: a bit table of bounded size that saves the joins that follow most
    of its rows while there are few enough, and nothing but time beyond."""
    size = min(BLOOM_WORDS, 1 << max(6, pairs.count() // 2).bit_length())
    bit = lambda c: F.xxhash64(c).bitwiseAND(F.lit(64 * size - 1))
    word = lambda c: F.call_function("shiftright", c, F.lit(6)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    keys = pairs.select(F.explode(F.array("a", "b")).alias("k")).select(bit(F.col("k")).alias("bit"))
    bits = [0] * size
    for i, w in keys.groupBy(word(F.col("bit")).alias("i")).agg(F.bit_or(one).alias("w")).collect():  # at most BLOOM_WORDS rows
        bits[i] = w
    known = _value(table.sparkSession, bits, "array<long>")
    return table.filter(F.getbit(F.get(known, word(bit(F.col("k")))), bit(F.col("k")).bitwiseAND(F.lit(63)).cast("int")) == 1)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of stored pairs ``a, b`` of set numbers, the later one of those that match: ``k``."""
    some = _only(sets, pairs)
    side = lambda x: some.select(F.col("k").alias(x), F.col("first").alias(f"{x}_first"), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(F.col("a_first") != F.col("b_first"))
    match = (BASE + TOP) * F.size(F.array_intersect("a_tokens", "b_tokens")) >= TOP * (F.size("a_tokens") + F.size("b_tokens"))
    return both.filter(match).select(F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a")).alias("k")).distinct()


def _to_lead(signed: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each set and the leader ``b`` of one of its signatures, where sizes and sketches leave a match open."""
    leads = leads.select("s", F.col("m.k").alias("b"), *[F.col(f"m.{c}").alias(f"b_{c}") for c in ("n", "sketch")])
    both = signed.select(F.col("k").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "sketch")], "s").join(leads, "s")
    return both.filter((F.col("a") != F.col("b")) & _alike()).select("a", "b").distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """Of each ``a`` the pair whose sketches are nearest."""
    return pairs.groupBy("a").agg(F.max(F.struct(-F.col("apart"), "c", "b")).alias("m")).select("a", F.col("m.b").alias("b"))


def later_sets(sets: DataFrame) -> DataFrame:
    """``k`` of every set of the stored table that an earlier one matches, as a stored table."""
    facts = cut(described(sets), "line-facts", "snappy")

    # the first of those that share a signature
    signed = facts.select("k", "first", "n", "sketch", F.explode("s").alias("s"))
    least = F.min(F.struct("first", "k", "n", "sketch")).alias("m")
    leads = signed.groupBy("s").agg(least, F.count("*").alias("c")).filter("c > 1")
    to_lead = cut(_to_lead(signed, leads), "line-leaders")
    settled = cut(_verified(to_lead, sets), "settled-lines")
    drop(to_lead)

    # the rest, by prefix tokens
    marks = facts.filter(F.col("n") >= NEAR_WORDS).select("k", F.col("first.id").alias("id"), "n", "sketch", *PARTS, "prefix").join(settled.withColumn("done", F.lit(True)), "k", "left")
    marks = cut(marks.withColumn("done", F.coalesce("done", F.lit(False))), "line-marks", "snappy")
    drop(facts)
    few = sets.count() // FEW
    parts = []
    for part in range(1 + ROUNDS):
        parts.append(cut(_joined(marks, part), "line-pairs"))
        if part < ROUNDS and parts[-1].count() > few // (ROUNDS if part else FIRST):  # those that the likeliest of their pairs settles need no more parts
            best = cut(_best(parts[-1]), "best-pairs")
            first = cut(_verified(best, sets), "settled-lines")
            fewer = cut(marks.join(first.withColumn("now", F.lit(True)), "k", "left").withColumn("done", F.col("done") | F.col("now").isNotNull()).drop("now"), "line-marks", "snappy")
            both = cut(settled.union(first).distinct(), "settled-lines")
            drop(best, first, marks, settled)
            marks, settled = fewer, both
    drop(marks)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    still = found.join(settled.select(F.col("k").alias("a")), "a", "left_anti")  # all their parts were joined
    pairs = cut(still.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("apart").alias("apart")).filter(F.col("c") >= COMMON), "line-pairs")
    drop(*parts)
    if pairs.count() > few:  # else one step is cheaper than two
        best = cut(_best(pairs), "best-pairs")
        first = cut(settled.union(_verified(best, sets)), "settled-lines")
        rest = cut(pairs.join(best, ["a", "b"], "left_anti").join(first, F.col("a") == F.col("k"), "left_anti"), "line-pairs")
        drop(pairs, best, settled)
        settled, pairs = first, rest
    out = cut(settled.union(_verified(pairs, sets)).distinct(), "later-sets")
    drop(settled, pairs)
    return out


def _joined(marks: DataFrame, part: int) -> DataFrame:
    """``a, b, c, apart``: a set that isn't settled, one that isn't of a later document, how many prefix tokens of this part they
    share at places that, with their sizes and sketches, leave room for enough common tokens, and how far the sketches are apart."""
    early = F.pmod("token", F.lit(FIRST)) == 0
    mine = ~early & (F.pmod("token", F.lit(ROUNDS)) == part - 1) if part else early
    post = lambda s: s.select("k", "id", "n", "sketch", *PARTS, F.posexplode("prefix").alias("p", "token")).filter(mine)
    open_, done = post(marks.filter("not done")), post(marks.filter("done"))
    a = open_.select("token", *[F.col(c).alias(f"a_{c}") for c in ("k", "id", "n", "p", "sketch", *PARTS)])
    out = None
    for right in (open_, done):
        b = right.select("token", *[F.col(c).alias(f"b_{c}") for c in ("k", "id", "n", "p", "sketch", *PARTS)])
        total = F.col("a_n") + F.col("b_n")
        room = F.least(F.col("a_n") - F.col("a_p"), F.col("b_n") - F.col("b_p"))
        # what stands from here on, with the tokens that may have been found before, must reach the overlap that is needed; the
        # first COMMON common tokens of sets that match pass this
        fits = ((BASE + TOP) * (room + COMMON - 1) >= TOP * total) & (BASE * F.col("a_n") >= TOP * F.col("b_n")) & (BASE * F.col("b_n") >= TOP * F.col("a_n"))
        # of two sets of one document either may be the later; the pair is verified once for each
        earlier = (F.col("a_k") != F.col("b_k")) & (F.col("b_id").isNull() | (F.col("b_id") <= F.col("a_id")))
        found = a.join(b, (a["token"] == b["token"]) & earlier & _alike() & _alike_wide() & fits).select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), _apart().alias("apart"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("apart").alias("apart"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every later matching line removed from the texts; all rows stay, with the columns that they had."""
    sets = cut(line_sets(docs, id_col, text_col), "line-sets", "snappy")
    later = later_sets(sets)
    i, t, keep = (unused(docs.columns, x) for x in ("_id", "_t", "_keep"))
    kept = sets.select("k", "first").join(later, "k", "left_anti").groupBy(F.col("first.id").alias(i), F.col("first.t").alias(t)).agg(F.collect_list("first.line_no").alias(keep))
    kept = cut(kept, "kept-lines")
    drop(sets, later)
    joined = docs.join(kept, docs[id_col].eqNullSafe(kept[i]) & (F.xxhash64(docs[text_col]) == kept[t]), "left")
    blank = lambda lines: F.filter(F.transform(lines, lambda x, j: F.when(~_has_words(x), j)), lambda x: x.isNotNull())
    stays = lambda lines: F.array_sort(F.concat(F.coalesce(kept[keep], F.array().cast("array<int>")), blank(lines)))
    rebuilt = let(F.split(docs[text_col], "\n"), lambda lines: let(stays(lines), lambda s: F.when(F.size(s) < F.size(lines), F.array_join(F.transform(s, lambda j: F.get(lines, j)), "\n"))))
    out = F.coalesce(rebuilt, docs[text_col])
    return joined.select(*[out.alias(c) if c == text_col else docs[c] for c in docs.columns])
