"""N-gram Jaccard join with set-relation skipping: exact links between all texts whose shingle sets are alike, and their classes.

Two sets link when ``100 * intersection >= 80 * union`` (a parameter). Equal sets are one set from the start. Every set's
prefix, its rarest shingles, goes into index lists by shingle; two sets that link share a shingle of both prefixes.

* Lists are skipped by position. Entries of a list are ordered by set size and cut into blocks; from the positions and sizes
  of two blocks follows the largest overlap that any of their pairs can have, and whole blocks are passed over.
* Answers of alike sets are derived. A set that links to the *leader* of its group (a set that many others resemble) takes
  the leader's place in the lists; its distance to the leader is kept. What links to a member lies, by the triangle
  inequality of the set difference, within the leader's distance plus the member's, so the leader's computed distances
  settle nearly all of the members' answers: either the leaders link or are connected otherwise, and so are all, or no member can
  link, or only the members near enough are compared on their own.

So a group of a million near copies costs a million comparisons with its leader, not their square, and no link is lost. Rarity
is counted over all texts; only the order of the most frequent shingles is broadcast, in a table of bounded size (any
order that all sets share gives right results, so the bound costs nothing but time).

A pair of candidates is first compared by parity sketches, whose difference bounds that of the sets from below, so that only
pairs that are nearly alike need their sets. Members of two groups, leaders and sets without a group are compared so within the
join that pairs them, by sketches folded to one size.

Sets are never stored for all texts: they are derived from the text again for those that have a candidate, which a Bloom
filter of bounded size picks out.

Nulls and edge cases: a null or empty text has no shingle and links with nothing, not even its like; a null id has no
component (null); rows that share an id are one document; repeated rows link as equal sets; texts shorter than a shingle are one
shingle of all their words; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bloom import BlockedBloom
from plumbline.llm.common import cut, drop, slices
from plumbline.llm.components import components
from plumbline.llm.shingles import LEAST_BITS, folded, least_difference, parity_sketch, set_identity, shingle_sets, signatures

POST = np.dtype([("token", "<u8"), ("key", "<i8"), ("least", "<u4"), ("most", "<u4"), ("pos", "<u4")])
#: Bounds of what is broadcast: shingles with a known rank, groups with a leader, shingles of all leaders.
FREQUENT, FREQUENT_MIN, LEADERS, GROUP_MIN, LEADER_SHINGLES = 100_000, 24, 4_000, 12, 3_000_000
PER_GROUP = 6  # sets that lead a group; each set joins the nearest
BUCKET_POSTINGS = 250_000
#: What a Python worker holds at most: postings before they are packed, identities of sets that it has met.
HELD, SEEN = 250_000, 50_000


#: Columns of a sketch of ``LEAST_BITS``.
FOLDED = tuple(f"w{k}" for k in range(LEAST_BITS // 64))


def _u(x: int) -> np.uint64:
    return np.uint64(x & ((1 << 64) - 1))


def describe_sets(docs: DataFrame) -> DataFrame:
    """Kind 0: ``doc_id, n, hi, lo, s1, s2, s3, sketch`` of every text; kind 1: shingles that a run of texts has several times
    (``lo``, with its count ``n``)."""
    fields = [("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("s3", pa.int64()), ("sketch", pa.binary())]

    def batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values, n = values[n >= 4].view(np.int64), n[n >= 4]
        none = pa.nulls(len(n), pa.int64())
        return batch([np.ones(len(n), np.int8), none, n.astype(np.int64), none, values, none, none, none, pa.nulls(len(n), pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"))
            rows = [(len(s), *set_identity(s), *signatures(s), parity_sketch(s)) if len(s) else (0, None, None, None, None, None, None) for s in sets]
            yield batch([np.zeros(len(sets), np.int8), part.column("doc_id"), *[list(c) for c in zip(*rows)]])
            held += sets
            size += sum(map(len, sets))
            if size > 1_500_000:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return docs.mapInArrow(run, "kind byte, doc_id long, n long, hi long, lo long, s1 long, s2 long, s3 long, sketch binary")


class Order:
    """All sets' common order of shingles: those that aren't known as frequent first, then by count, then by hash."""

    def __init__(self, rows: list[tuple[int, int]]):
        tokens = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        counts = np.array([r[1] for r in rows], np.int64)
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def rarest(self, s: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` shingles of a sorted set in the common order."""
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
            known = self.tokens[at] == s
            if known.any():
                weight = np.where(known, self.counts[at], 0)
                return s[np.argsort(weight, kind="stable")[:k]]
        return s[:k]


def links(inter, n1, n2, share: tuple[int, int]):
    return share[1] * inter >= share[0] * (n1 + n2 - inter)


def list_pairs(posts: np.ndarray, share: tuple[int, int], dense: int = 64, block: int = 256) -> np.ndarray:
    """Pairs of keys that a bucket's lists can't rule out: an array of two columns, the smaller key first.

    Entries are one per (shingle, key), with the least and largest size and the least position behind the key."""
    if not len(posts):
        return np.zeros((0, 2), np.int64)
    posts = posts[np.lexsort((posts["key"], posts["token"]))]
    head = np.ones(len(posts), bool)
    head[1:] = (posts["token"][1:] != posts["token"][:-1]) | (posts["key"][1:] != posts["key"][:-1])
    at = np.flatnonzero(head)
    token, key = posts["token"][at], posts["key"][at]
    least, most, pos = np.minimum.reduceat(posts["least"], at), np.maximum.reduceat(posts["most"], at), np.minimum.reduceat(posts["pos"], at)
    by = np.lexsort((pos, least, token))
    token, key = token[by], key[by]
    least, most, pos = least[by].astype(np.int64), most[by].astype(np.int64), pos[by].astype(np.int64)
    room = most - pos  # the largest overlap from this position on
    top, base = share
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    out = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        can = (top + base) * np.minimum(room[i], room[j]) >= top * (least[i] + least[j])
        can &= (base * most[i] >= top * least[j]) & (base * most[j] >= top * least[i])
        i, j = i[can], j[can]
        if len(i):
            out.append(np.unique(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], 1), axis=0))

    short = (sizes >= 2) & (sizes <= dense)
    left = np.repeat(sizes, sizes) - (np.arange(len(token)) - np.repeat(starts, sizes)) - 1
    left[np.repeat(~short, sizes)] = 0
    for step in range(1, dense):
        i = np.flatnonzero(left >= step)
        if not len(i):
            break
        keep(i, i + step)
    for s, n in zip(starts[sizes > dense].tolist(), sizes[sizes > dense].tolist()):
        edges = list(range(s, s + n, block)) + [s + n]
        spans = list(zip(edges, edges[1:]))
        limits = [(least[a:b].min(), most[a:b].max(), room[a:b].max()) for a, b in spans]
        for x, (a, b) in enumerate(spans):
            for y in range(x, len(spans)):
                c, d = spans[y]
                (l1, m1, r1), (l2, m2, r2) = limits[x], limits[y]
                if base * m1 < top * l2:
                    break  # entries are in order of size: all later ones are too large
                if (top + base) * min(r1, r2) < top * (l1 + l2):
                    continue  # no pair of the two blocks can overlap enough
                i, j = np.divmod(np.arange((b - a) * (d - c)), d - c)
                i, j = i + a, j + c
                if x == y:
                    i, j = i[i < j], j[i < j]
                keep(i, j)
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def jaccard_components(docs: DataFrame, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    facts = cut(describe_sets(rows), "sets")
    texts = facts.filter("kind = 0").select("doc_id", "n", "hi", "lo", "s1", "s2", "s3", "sketch")
    found, tables = _set_links(spark, rows, facts, texts, share)
    # sets -> documents: the least id of each set stands for it
    sets = texts.filter("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    named = found.join(sets.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("rep").alias("a")), ["a_hi", "a_lo"]).join(sets.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.col("rep").alias("b")), ["b_hi", "b_lo"])
    classes = components(named.select("a", "b"))
    drop(*tables)
    own = sets.join(classes, sets["rep"] == classes["node"], "left").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.coalesce("component", "rep").alias("_component"))
    out = texts.join(own, (texts["hi"] == own["_hi"]) & (texts["lo"] == own["_lo"]), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("_component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _set_links(spark: SparkSession, rows: DataFrame, facts: DataFrame, texts: DataFrame, share: tuple[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """Links between different sets that connect all that are connected: ``a_hi, a_lo, b_hi, b_lo``; and the tables that it reads."""
    context = spark.sparkContext
    frequent = facts.filter("kind = 1").groupBy("lo").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_MIN)
    order = Order([(r[0], r[1]) for r in frequent.orderBy(F.desc("n"), "lo").limit(FREQUENT).collect()])

    # Groups of sets with a common signature; of each, a few sets lead, picked by hashes of their identities. Bounded: the largest groups.
    distinct = texts.filter("n > 0").groupBy("hi", "lo").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), *[F.first(s).alias(s) for s in ("s1", "s2", "s3")])
    signed = distinct.select(F.explode(F.array("s1", "s2", "s3")).alias("s"), "hi", "lo", "n", "doc_id")
    picks = [F.min(F.struct(F.xxhash64("lo", F.lit(k)).alias("h"), "lo", "hi", "n", "doc_id")).alias(f"lead{k}") for k in range(PER_GROUP)]
    groups = signed.filter(F.col("doc_id").isNotNull()).groupBy("s").agg(F.count("*").alias("members"), *picks)
    groups = groups.filter(F.col("members") >= GROUP_MIN).orderBy(F.desc("members"), "s").limit(LEADERS).collect()
    leads: dict[tuple[int, int], int] = {}
    room = LEADER_SHINGLES
    for k in range(PER_GROUP):  # the first of every group, then the second
        for g in groups:
            lead = g[f"lead{k}"]
            who = (lead["hi"], lead["lo"])
            if who not in leads and lead["n"] <= room:
                leads[who] = lead["doc_id"]
                room -= lead["n"]
    leader_of = {g["s"]: list(dict.fromkeys(w for k in range(PER_GROUP) for w in [(g[f"lead{k}"]["hi"], g[f"lead{k}"]["lo"])] if w in leads)) for g in groups}
    wanted = {lo for _, lo in leads}
    leader_sets: dict[tuple[int, int], np.ndarray] = {}
    if leads:
        ids = spark.createDataFrame([(x,) for x in sorted(set(leads.values()))], "id long")  # at most PER_GROUP * LEADERS rows
        picked = rows.join(F.broadcast(ids), rows["doc_id"] == ids["id"]).select("doc_id", "text")
        for r in _sets_of(picked, None).filter(F.col("lo").isin(sorted(wanted))).dropDuplicates(["hi", "lo"]).collect():
            leader_sets[(r["hi"], r["lo"])] = np.frombuffer(r["shingles"], np.uint64)
    leader_of = {s: [w for w in ws if w in leader_sets] for s, ws in leader_of.items()}
    known = context.broadcast((order, leader_of, leader_sets))

    n_postings = (texts.agg(F.sum("n")).first()[0] or 0) * (1 - share[0] / share[1]) + 1
    buckets = max(64, int(n_postings // BUCKET_POSTINGS) + 1)
    first = cut(_postings(rows, known, share, buckets), "postings")
    members = first.filter("kind = 1").select("hi", "lo", "n", "l_hi", "l_lo", "d").distinct()
    posted = first.filter("kind = 0").select("bucket", "blob")
    pairs = cut(_candidates(posted, share, buckets), "candidates")

    spread = cut(members.groupBy(F.col("l_lo").alias("lo")).agg(F.max("d").alias("d"), F.max("n").alias("n")), "spread")

    # Distances of the candidates, leader to leader; then of the members that these can't settle.
    likely = cut(_sketched(pairs, texts, spread, share), "likely")
    drop(pairs)
    checked = cut(_distances(rows, likely, share), "distances")
    drop(likely)
    linked = checked.filter("linked").select("a_hi", "a_lo", "b_hi", "b_lo")
    stars = members.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("l_hi").alias("b_hi"), F.col("l_lo").alias("b_lo"))
    result = linked.unionByName(stars)
    top, base = share
    far = checked.filter("not linked").join(spread.select(F.col("lo").alias("a_lo"), F.col("d").alias("da"), F.col("n").alias("ma")), "a_lo", "left")
    far = far.join(spread.select(F.col("lo").alias("b_lo"), F.col("d").alias("db"), F.col("n").alias("mb")), "b_lo", "left").filter("da is not null or db is not null")
    # two sets link only if their difference is at most (base - top) / (base + top) of their sizes' sum
    near = lambda d, n: (base + top) * d <= (base - top) * n
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    open_ = far.filter(near(F.col("d") - zero("da") - zero("db"), F.greatest(zero("ma"), "na") + F.greatest(zero("mb"), "nb"))).select("a_lo", "b_lo", "d", "na", "nb")
    open_ = cut(open_.distinct(), "open")
    tables = [first, spread, checked, open_]

    def unsettled(pairs: DataFrame) -> DataFrame:
        """Of pairs of leaders those in different classes: members of groups that are connected already have the same class and need no
        answers of their own."""
        known = components(result.select(F.col("a_lo").alias("a"), F.col("b_lo").alias("b")))
        of = lambda x: known.select(F.col("node").alias(f"{x}_lo"), F.col("component").alias(f"{x}_class"))
        classed = pairs.join(of("a"), "a_lo", "left").join(of("b"), "b_lo", "left")
        one, other = F.coalesce("a_class", "a_lo"), F.coalesce("b_class", "b_lo")
        out = cut(classed.filter(one != other).select(*pairs.columns, F.least(one, other).alias("c1"), F.greatest(one, other).alias("c2")), "open")
        tables.append(out)
        return out

    each = members.select("l_lo", "lo", "n", "d").unionByName(members.select("l_lo", F.col("l_lo").alias("lo"), F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("d")).distinct())

    def of_members(pairs: DataFrame) -> DataFrame:
        """The links between members of pairs of leaders, of which the distances to the leaders leave some open."""
        slack = lambda d, n: (base + top) * d + (base - top) * n  # noqa: E731  (near, turned: a pair is open if both slacks add up to what its leaders' distance needs)
        needs = (base + top) * F.col("d")
        peaks = each.filter("n is not null").groupBy("l_lo").agg(F.max(slack(F.col("d"), F.col("n"))).alias("peak"))
        known = pairs.join(peaks.select(F.col("l_lo").alias("a_lo"), F.col("peak").alias("pa")), "a_lo", "left").join(peaks.select(F.col("l_lo").alias("b_lo"), F.col("peak").alias("pb")), "b_lo", "left")

        def side(x: str, other: str) -> DataFrame:
            """Of each pair the members of group ``x`` that with the largest slack of the other group may be open; the others meet nobody."""
            own = each.select(F.col("l_lo").alias(f"{x}_lo"), F.col("lo").alias("m"), F.col("n").alias("mn"), F.col("d").alias("md"))
            here = known.join(own, f"{x}_lo", "left").withColumn("s", slack(zero("md"), F.coalesce("mn", f"n{x}")))
            some = here.filter(F.col("s") + F.greatest(F.col(f"p{other}"), (base - top) * F.col(f"n{other}")) >= needs)
            some = some.select("a_lo", "b_lo", "d", F.coalesce("m", f"{x}_lo").alias(x), F.coalesce("mn", f"n{x}").alias(f"{x}_n"), F.col("s").alias(f"{x}_s"), (zero("md") > 0).alias(f"{x}_off"))
            return some.join(words.select(F.col("lo").alias(x), *[F.col(w).alias(f"{x}_{w}") for w in FOLDED]), x)

        left, right = side("a", "b"), side("b", "a").drop("d")
        bits = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in FOLDED), F.lit(0))
        alike = near(F.greatest(bits, F.abs(F.col("a_n") - F.col("b_n"))), F.col("a_n") + F.col("b_n"))
        both = left.join(right, ["a_lo", "b_lo"]).filter((F.col("a_s") + F.col("b_s") >= needs) & (F.col("a_off") | F.col("b_off")) & alike)
        more = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        likely = cut(_sketched(more, texts, spread.limit(0), share), "likely")
        drop(more)
        tables.append(cut(_distances(rows, likely, share), "distances"))
        drop(likely)
        return tables[-1].filter("linked").select("a_hi", "a_lo", "b_hi", "b_lo")

    if not open_.isEmpty():
        open_ = unsettled(open_.select("a_lo", "b_lo", "d", "na", "nb"))
    if not open_.isEmpty():
        ends = open_.select(F.explode(F.array("a_lo", "b_lo")).alias("l_lo")).distinct()
        words = cut(_folded(texts, ends.select(F.col("l_lo").alias("lo")).union(members.join(ends, "l_lo", "left_semi").select("lo")).distinct()), "words")
        tables.append(words)
        # the nearest leaders of two classes first: one link between their members settles all other pairs of these classes
        pair = F.struct("a_lo", "b_lo", "d", "na", "nb")
        nearest = cut(open_.groupBy("c1", "c2").agg(F.min_by(pair, F.struct("d", "a_lo", "b_lo")).alias("p")).select("p.*"), "nearest")
        result = result.unionByName(of_members(nearest))
        rest = open_.drop("c1", "c2").join(nearest.select("a_lo", "b_lo"), ["a_lo", "b_lo"], "left_anti")
        rest = unsettled(rest)
        tables.append(nearest)
        if not rest.isEmpty():
            result = result.unionByName(of_members(rest))
    return result, tables


def _postings(rows: DataFrame, known, share: tuple[int, int], buckets: int) -> DataFrame:
    """Kind 0: ``bucket, blob`` of index entries; kind 1: a set, its size, its leader and their difference."""
    top, base = share
    fields = [("kind", pa.int8()), ("bucket", pa.int32()), ("blob", pa.binary()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("l_hi", pa.int64()), ("l_lo", pa.int64()), ("d", pa.int64())]

    def batch(kind: int, columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int8()) if name == "kind" else pa.array(columns[name], t) if name in columns else pa.nulls(n, t) for name, t in fields], names=[n for n, _ in fields])

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        posts = np.concatenate(held)
        # entries of one (shingle, key) are one entry: members of a group stand as their leader
        posts = posts[np.lexsort((posts["key"], posts["token"], posts["token"] % np.uint64(buckets)))]
        head = np.r_[True, (posts["token"][1:] != posts["token"][:-1]) | (posts["key"][1:] != posts["key"][:-1])]
        at = np.flatnonzero(head)
        few = posts[at].copy()
        few["least"], few["most"], few["pos"] = np.minimum.reduceat(posts["least"], at), np.maximum.reduceat(posts["most"], at), np.minimum.reduceat(posts["pos"], at)
        bucket = (few["token"] % np.uint64(buckets)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(few)]
        return batch(0, {"bucket": bucket[cuts[:-1]], "blob": [few[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}, len(cuts) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, leader_of, leader_sets = known.value
        held, size, seen = [], 0, set()
        for part in slices(batches, "text"):
            stars = []
            for s in shingle_sets(part.column("text")):
                n = len(s)
                if not n:
                    continue
                who = set_identity(s)
                if who in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(who)
                key, best = who[1], None
                for lead in dict.fromkeys(w for sig in signatures(s) for w in leader_of.get(sig, ())) if leader_of else ():
                    if lead != who:
                        other = leader_sets[lead]
                        inter = len(np.intersect1d(s, other, assume_unique=True))
                        if links(inter, n, len(other), share) and (best is None or n + len(other) - 2 * inter < best[0]):
                            best = (n + len(other) - 2 * inter, lead)
                if best:
                    key = best[1][1]
                    stars.append((*who, n, *best[1], best[0]))
                need = -(-top * n // base)
                prefix = order.rarest(s, n - need + 1)
                post = np.empty(len(prefix), POST)
                post["token"], post["key"], post["least"], post["most"], post["pos"] = prefix, key, n, n, np.arange(len(prefix))
                held.append(post)
                size += len(post)
            if stars:
                yield batch(1, dict(zip(("hi", "lo", "n", "l_hi", "l_lo", "d"), zip(*stars))), len(stars))
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return rows.mapInArrow(run, "kind byte, bucket int, blob binary, hi long, lo long, n long, l_hi long, l_lo long, d long")


def _candidates(posted: DataFrame, share: tuple[int, int], buckets: int) -> DataFrame:
    """``a, b``: keys of sets that share a shingle of both prefixes and may overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                p = list_pairs(np.concatenate(held), share)
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        for part in batches:
            for bucket, blob in zip(part.column("bucket").to_pylist(), part.column("blob")):
                if bucket != now:
                    yield from close()
                    now, held = bucket, []
                held.append(np.frombuffer(blob.as_buffer(), POST))
        yield from close()

    dealt = posted.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _sketched(pairs: DataFrame, texts: DataFrame, spread: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` that their sketches don't rule out, with room for the members of both groups."""
    top, base = share
    own = texts.filter("n > 0").select("lo", "hi", "n", "sketch").dropDuplicates(["lo", "hi"]).join(spread.select("lo", F.col("d").alias("room"), F.col("n").alias("most")), "lo", "left")
    own = own.select("lo", "sketch", F.coalesce("room", F.lit(0)).alias("room"), F.greatest("n", "most").alias("most"))
    side = lambda x: own.select(F.col("lo").alias(x), F.col("sketch").alias(f"{x}_sketch"), F.col("room").alias(f"{x}_room"), F.col("most").alias(f"{x}_most"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sketch", "b_sketch", (F.col("a_room") + F.col("b_room")).alias("room"), (F.col("a_most") + F.col("b_most")).alias("most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            least = [least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(part.column("a_sketch"), part.column("b_sketch"))]
            room, most = part.column("room").to_numpy(), part.column("most").to_numpy()
            can = pa.array((base + top) * (np.array(least, np.int64) - room) <= (base - top) * most)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(can), part.column("b").filter(can)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long").distinct()


def _folded(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``lo`` of the keys, with their sketches as columns of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                every = np.stack([folded(x.as_buffer()) for x in part.column("sketch")]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("lo"), *[pa.array(every[:, k].copy()) for k in range(len(FOLDED))]], names=["lo", *FOLDED])

    own = texts.filter("n > 0").select("lo", "sketch").join(keys, "lo", "left_semi").dropDuplicates(["lo"])
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in ("lo", *FOLDED)))


def _sets_of(rows: DataFrame, bloom) -> DataFrame:
    """``hi, lo, n, shingles`` of the rows' texts; with ``bloom``, only of sets whose ``lo`` it may contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(part.column("text")) if len(s)]
            who = [set_identity(s) for s in sets]
            if bloom is not None and who:
                hit = bloom.value.might_contain(np.array([lo for _, lo in who], np.int64).view(np.uint64))
            else:
                hit = np.ones(len(who), bool)
            at = []
            for k in np.flatnonzero(hit).tolist():
                if who[k] not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(who[k])
                    at.append(k)
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([who[k][0] for k in at]), pa.array([who[k][1] for k in at]), pa.array([len(sets[k]) for k in at]), pa.array([sets[k].tobytes() for k in at], pa.binary())], names=["hi", "lo", "n", "shingles"])

    return rows.mapInArrow(run, "hi long, lo long, n long, shingles binary")


def _distances(rows: DataFrame, pairs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """For each pair of keys ``a, b``: identities, sizes, set difference ``d``, and whether the sets link."""
    spark = rows.sparkSession
    keys = pairs.select(F.col("a").alias("lo")).union(pairs.select("b")).distinct()
    n = keys.count()
    bloom = BlockedBloom(n, 12, 8 << 20)
    size = len(bloom.words)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockedBloom(n, 12, 8 << 20)
        for part in batches:
            own.add(part.column("lo").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([own.words.tobytes()], pa.binary())], names=["words"])

    for r in keys.coalesce(4).mapInArrow(bits, "words binary").toLocalIterator():  # a few parts of a fixed size
        bloom.words |= np.frombuffer(r[0], np.uint64, size)
    sets = _sets_of(rows, spark.sparkContext.broadcast(bloom))
    sets = sets.join(keys, "lo", "left_semi").dropDuplicates(["lo", "hi"])
    a = sets.select(F.col("lo").alias("a"), F.col("hi").alias("a_hi"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("lo").alias("b"), F.col("hi").alias("b_hi"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    joined = pairs.join(a, "a").join(b, "b").select("a_hi", F.col("a").alias("a_lo"), "b_hi", F.col("b").alias("b_lo"), "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            inter = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(part.column("sa"), part.column("sb"))]
            inter = np.array(inter, np.int64)
            na, nb = part.column("na").to_numpy(), part.column("nb").to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(na + nb - 2 * inter), pa.array(links(inter, na, nb, share))], names=[*part.schema.names[:6], "d", "linked"])

    return joined.mapInArrow(run, "a_hi long, a_lo long, b_hi long, b_lo long, na long, nb long, d long, linked boolean")


def keep_one_of_each(docs: DataFrame, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class stays, that with the least id; columns as they were. Rows without shingles or id stay."""
    classes = jaccard_components(docs, share, id_col, text_col).filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_later")).distinct()
    gone = cut(classes, "later-copies")
    return docs.join(gone, docs[id_col].cast("long") == gone["_later"], "left_anti")
