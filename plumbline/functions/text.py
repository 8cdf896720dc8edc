"""Labels, the token grammar of answers, and prompts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions.once import once

# The token grammar, and the prompt texts that models were trained with.
TOKEN = r"(?is)<ref>\s*(.*?)\s*</ref>|<box>\s*<(\d+)>\s*<(\d+)>(?:\s*<(\d+)>\s*<(\d+)>)?\s*</box>"
REF = r"(?is)<ref>\s*(.*?)\s*</ref>"
POINT = r"(?i)<box>\s*<(\d+)>\s*<(\d+)>\s*</box>"
BOX = r"(?i)<box>\s*<(\d+)>\s*<(\d+)>\s*<(\d+)>\s*<(\d+)>\s*</box>"
NONE = r"(?i)<box>\s*None\s*</box>"
COMPACT_PROMPT = r"(?s)^<image><image>\nLocate the single (.+?) containing point <box><(\d+)><(\d+)></box> in horizontal box format\. Return None if absent\.$"
COMPACT_ANSWER = r"(?s)^<ref>(.*?)</ref><box>(None|(?:<\d+>){4})</box>$"
PROMPTS = {
    "address": "Image 1 is the global scene. Image 2 is the point-indexed local view for address A1. In Image 2, point {p} addresses one {r}. "
    "Return exactly one box for that {r} in Image 2 coordinates. If no {r} contains the address point, return None.",
    "local": "Locate the single {r} containing point {p} in the local view. Return its complete horizontal box, or None if the complete boundary is unavailable.",
    "pilot": "Locate the single {r} containing point {p} in horizontal box format. Return None if absent.",
    "global": "Locate the single {r} containing point {p} in the global image. Return its horizontal box, or None if absent.",
}
DISCOVERY = "Point to all instances that match the following categories: "
SINGLE = "Point to a single instance that matches the following description: "


def canonical_label(value: Column) -> Column:
    """Lower case, underscores as spaces, white space collapsed and trimmed; null is the empty label."""
    spaced = F.regexp_replace(F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("_"), F.lit(" ")), r"(?U)\s+", " ")
    return F.trim(spaced)


def point_token(p: Column) -> Column:
    return F.concat(F.lit("<box><"), p["x"].cast("int").cast("string"), F.lit("><"), p["y"].cast("int").cast("string"), F.lit("></box>"))


def box_token(b: Column) -> Column:
    """The token of a grid box; null is the explicit ``None``."""
    parts = [F.concat(F.lit("<"), b[n].cast("int").cast("string"), F.lit(">")) for n in ("x1", "y1", "x2", "y2")]
    return F.when(b.isNull(), F.lit("<box>None</box>")).otherwise(F.concat(F.lit("<box>"), *parts, F.lit("</box>")))


def prompt(kind: str, reference: Column, p: Column, images: int = 0) -> Column:
    """A prompt of one of ``PROMPTS`` for a reference and a grid point, after ``images`` image marks."""
    pieces, rest = [F.lit("<image>" * images + "\n")] if images else [], PROMPTS[kind]
    while rest:
        at = min((k for k in (rest.find("{p}"), rest.find("{r}")) if k >= 0), default=-1)
        if at < 0:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[:at]), point_token(p) if rest[at + 1] == "p" else reference]
        rest = rest[at + 3 :]
    return F.concat(*pieces)


def discovery_prompt(classes: Column) -> Column:
    """The prompt for a list of classes; an empty list or label is an error."""
    labels = F.transform(classes, canonical_label)
    bad = (F.size(labels) <= 0) | F.exists(labels, lambda x: x == "")
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("discovery needs class names that aren't empty"))).otherwise(F.concat(F.lit(DISCOVERY), F.array_join(labels, "</c>"), F.lit(".")))


def tokens(answer: Column) -> Column:
    """The answer's tokens in order: ``label`` of a reference, or the ``v`` numbers of a box."""

    def one(t: Column) -> Column:
        is_ref = F.lower(F.substring(t, 1, 5)) == "<ref>"
        return F.struct(
            F.when(is_ref, canonical_label(F.regexp_extract(t, REF, 1))).alias("label"),
            F.when(~is_ref, F.transform(F.regexp_extract_all(t, F.lit(r"<(\d+)>"), F.lit(1)), lambda n: n.cast("long"))).alias("v"),
        )

    return F.transform(F.regexp_extract_all(answer, F.lit(TOKEN), F.lit(0)), one)


def labelled_tokens(answer: Column) -> Column:
    """Boxes with the label of the reference before them (empty without one), in order."""
    start = F.struct(F.lit("").alias("label"), F.expr("cast(array() as array<struct<label:string,v:array<bigint>>>)").alias("out"))

    def step(a: Column, t: Column) -> Column:
        boxed = F.concat(a["out"], F.array(F.struct(a["label"].alias("label"), t["v"].alias("v"))))
        return F.struct(F.coalesce(t["label"], a["label"]).alias("label"), F.when(t["v"].isNull(), a["out"]).otherwise(boxed).alias("out"))

    return F.aggregate(tokens(answer), start, step, lambda a: a["out"])


def parse_points(answer: Column, width, height) -> Column:
    """Labelled points of an answer: boxes count as their centres; without a label nothing counts; repeated (label, grid point)s count once."""

    def point(t: Column) -> Column:
        two = F.size(t["v"]) == 2
        mid = lambda a, b: F.rint((F.get(t["v"], a) + F.get(t["v"], b)) / 2).cast("long")
        x = g.clamp(F.when(two, F.get(t["v"], 0)).otherwise(mid(0, 2)), 0, g.GRID).cast("int")
        y = g.clamp(F.when(two, F.get(t["v"], 1)).otherwise(mid(1, 3)), 0, g.GRID).cast("int")
        return F.struct(
            t["label"].alias("label"), x.alias("nx"), y.alias("ny"), g.from_grid(x, width).alias("x"), g.from_grid(y, height).alias("y"),
            F.when(two, "point").otherwise("box_center_fallback").alias("source"), F.concat_ws(":", t["label"], x.cast("string"), y.cast("string")).alias("point_id"),
        )

    found = F.transform(F.filter(labelled_tokens(answer), lambda t: t["label"] != ""), point)
    return once(found, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda q: q["point_id"] == p["point_id"])))


def parse_boxes(answer: Column, label: Column, width, height) -> Column:
    """All boxes of the label with ordered, clamped corners and some area."""

    def shaped(t: Column) -> Column:
        v = [g.clamp(F.get(t["v"], k), 0, g.GRID).cast("int") for k in range(4)]
        low, high = F.least, F.greatest
        return F.struct(low(v[0], v[2]).alias("x1"), low(v[1], v[3]).alias("y1"), high(v[0], v[2]).alias("x2"), high(v[1], v[3]).alias("y2"))

    mine = F.filter(labelled_tokens(answer), lambda t: (F.size(t["v"]) == 4) & (t["label"] == canonical_label(label)))
    grid = F.filter(F.transform(mine, shaped), lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    return F.transform(grid, lambda b: g.box_from_grid(b, width, height))


def parse_single_box(answer: Column, label: Column, width, height) -> Column:
    """The answer's one box of the label, null without any; more than one is an error."""
    several = F.raise_error(F.lit("an answer for one address has several boxes")).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    return once(parse_boxes(answer, label, width, height), lambda found: F.when(F.size(found) > 1, several).otherwise(F.get(found, 0)))


def count_tokens(answer: Column) -> Column:
    n = lambda p: F.regexp_count(answer, F.lit(p)).cast("int")
    return F.struct(n(REF).alias("refs"), n(POINT).alias("points"), n(BOX).alias("boxes"), n(NONE).alias("nones"))


def turns_text(turns: Column, roles: tuple[str, ...] = ("gpt", "assistant"), role: str = "from", value: str = "value") -> Column:
    """The joined texts of the turns of some roles."""
    mine = F.filter(turns, lambda t: F.lower(F.coalesce(t[role], F.lit(""))).isin(*roles))
    return F.array_join(F.transform(mine, lambda t: F.coalesce(t[value], F.lit(""))), "")


def one_turn_text(turns: Column, wanted: str, role: str = "from", value: str = "value") -> Column:
    """The text of the only turn of a role; none or several are an error."""
    mine = F.filter(turns, lambda t: t[role] == wanted)
    return F.when(F.size(mine) == 1, F.get(mine, 0)[value]).otherwise(F.raise_error(F.concat(F.lit(f"expected one {wanted} turn, found "), F.size(mine).cast("string"))))


def replace_first(text: Column, old: str, new: str = "") -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(text)


def row_label(value: Column, aliases: Column) -> Column:
    """The canonical label after the row's aliases (canonical on both sides)."""
    label = canonical_label(value)
    pairs = F.transform(F.map_entries(aliases), lambda e: F.struct(canonical_label(e["key"]).alias("k"), canonical_label(e["value"]).alias("v")))
    hit = F.get(F.filter(pairs, lambda e: e["k"] == label), 0)["v"]
    return F.coalesce(hit, label)


def class_prompts(classes: Column, prompts: Column, aliases: Column) -> Column:
    """Each class's name for the model, or the class itself; empty names are an error."""
    named = F.transform(F.map_entries(prompts), lambda e: F.struct(row_label(e["key"], aliases).alias("k"), F.trim(e["value"]).alias("v")))
    bad = F.exists(named, lambda e: F.coalesce(e["v"], F.lit("")) == "")
    out = F.transform(classes, lambda c: F.coalesce(F.get(F.filter(named, lambda e: e["k"] == c), 0)["v"], c))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a class prompt is empty")).cast("array<string>")).otherwise(out)


def suffix(path: Column, known: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"), other: str = ".img") -> Column:
    found = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(found.isin(*known), found).otherwise(F.lit(other))


def content_path(split: Column, digest: Column, ext: Column, top: str = "images") -> Column:
    """The place of a file that is named by its content."""
    return F.concat_ws("/", F.lit(top), split, F.substring(digest, 1, 2), F.concat(digest, ext))


def scope_of_path(path: Column, names: tuple[str, ...]) -> Column:
    """The one part of a path that is one of ``names``; none or several are an error."""
    hits = F.array_intersect(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))
    return F.when(F.size(hits) == 1, F.get(hits, 0)).otherwise(F.raise_error(F.concat(F.lit("no single scope in path "), path)))


def safe_member(path: Column) -> Column:
    """Whether an archive member's path stays inside the folder it is unpacked to."""
    return ~(path.startswith("/") | F.array_contains(F.split(path, "/"), ".."))


def is_digest(value: Column, length: int = 64) -> Column:
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{length}}}$"), F.lit(False))


def supplied_points(points: Column, aliases: Column, space: Column, width, height) -> Column:
    """Points that a manifest gives, in pixels, with grid points and ids; repeats of (label, grid point) count once. An
    unknown coordinate space is an error; null is pixels."""
    space = F.coalesce(F.nullif(space, F.lit("")), F.lit("pixel"))

    def shaped(p: Column, i: Column) -> Column:
        label = row_label(p["label"], aliases)
        raw = lambda k: F.get(p["point"], k).cast("double")
        pixel = lambda k, extent: F.when(space == "normalized_0_1000", g.from_grid(raw(k), extent)).when(space == "pixel", raw(k)).otherwise(F.raise_error(F.lit("unknown coordinate space")).cast("double"))
        x, y = pixel(0, width), pixel(1, height)
        nx, ny = g.to_grid(x, width), g.to_grid(y, height)
        fallback = F.concat_ws(":", label, nx.cast("string"), ny.cast("string"), i.cast("string"))
        return F.struct(label.alias("label"), x.alias("x"), y.alias("y"), nx.alias("nx"), ny.alias("ny"), F.coalesce(F.nullif(p["point_id"], F.lit("")), fallback).alias("point_id"))

    found = F.transform(points, shaped)
    same = lambda p, q: (p["label"] == q["label"]) & (p["nx"] == q["nx"]) & (p["ny"] == q["ny"])
    return once(found, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda q: same(p, q))))


def ground_truth(targets: Column, aliases: Column, space: Column, width, height) -> Column:
    """Targets as labelled pixel boxes."""
    space = F.coalesce(F.nullif(space, F.lit("")), F.lit("pixel"))

    def shaped(t: Column) -> Column:
        raw = [F.get(t["hbox"], k).cast("double") for k in range(4)]
        scaled = [F.when(space == "normalized_0_1000", g.from_grid(v, e)).otherwise(v) for v, e in zip(raw, (width, height, width, height))]
        return F.struct(row_label(t["label"], aliases).alias("label"), g.box(*scaled).alias("box"))

    ok = space.isin("pixel", "normalized_0_1000")
    return F.when(ok, F.transform(targets, shaped)).otherwise(F.raise_error(F.lit("unknown coordinate space")).cast("array<struct<label:string,box:struct<x1:double,y1:double,x2:double,y2:double>>>"))
