"""Strict manifests, documents, pointers, recipes and plans: what they refuse and what they give."""

from __future__ import annotations

import pytest

from plumbline.operators import expand
from plumbline.sources import jsonl, sinks

KINDS = "image_id string, image_path string, objects array<struct<raw_class_name:string,class_name:string,hbox:array<double>>>"
BOX = [1.0, 2.0, 3.0, 4.0]


def strict(spark, *rows, files=None):
    return expand.strict_manifest(spark.createDataFrame(list(rows), KINDS), "b", ["crane", "tug"], "harbour", {}, {}, files).collect()


def test_strict_manifest(spark):
    files = spark.createDataFrame([("p",), ("q",)], "path string")
    rows = strict(spark, ("1", "p", [(" tug ", "boat", BOX)]), ("2", "q", None), files=files)
    assert [(r["sample_key"], [o["label"] for o in r["gt"]]) for r in sorted(rows, key=lambda r: r["image_id"])] == [("b:1", ["tug"]), ("b:2", [])]
    for row, message in (
        (("1", "p", [("tug", "", BOX), (None, "tug", BOX)]), "image 1 object 1: no raw label"), (("1", "p", [(" ", "tug", BOX)]), "no raw label"), (("1", "p", [("boat", "tug", BOX)]), "outside harbour: boat"),
        (("1", "p", [("tug", "", [1.0, 2.0, 1.0, 4.0])]), "degenerate"), (("1", "p", [("tug", "", None)]), "degenerate"), (("2", "z", []), "no such image: z"),
    ):
        with pytest.raises(Exception, match=message):
            strict(spark, row, files=files)
    with pytest.raises(Exception, match="comes twice: 1"):
        strict(spark, ("1", "p", []), ("1", "q", []))


def test_documents_pointers_recipes_and_plans(spark, tmp_path):
    at = str(tmp_path / "a b/doc.json")
    sinks.write_document(at, {"b": 1, "a": [2]})
    sinks.write_document(at, {"b": 3, "a": "é"})
    assert sinks.read_document(at) == {"a": "é", "b": 3} and [p.name for p in (tmp_path / "a b").iterdir()] == ["doc.json"]
    for target in ("step-1", "step-2"):
        sinks.point_to(str(tmp_path / "last"), target)
    assert sinks.read_document(str(tmp_path / "last")) == {"target": "step-2"}
    recipe, files = spark.createDataFrame([("x", 1), ("y", 2)], "path string, k int"), spark.createDataFrame([("x",), ("y",), ("y",)], "path string")
    assert sorted(map(tuple, sinks.resolved(recipe, files).collect())) == [("x", 1), ("y", 2)]
    with pytest.raises(Exception, match="isn't there: y"):
        sinks.resolved(recipe, files.filter("path = 'x'")).collect()
    (tmp_path / "c/d").mkdir(parents=True)
    (tmp_path / "c/a.jsonl").write_text("{}\n\n{}\n")
    (tmp_path / "c/d/b.jsonl").write_text("")
    (tmp_path / "c/d/other.txt").write_text("x\n")
    plan = jsonl.curriculum_plan(spark, str(tmp_path / "c")).first()
    assert (plan["files"], plan["bytes"], plan["records"]) == (2, 7, 2)
    (tmp_path / "sums").write_text("0" * 64 + "  a\n" + "1" * 64 + "  a\n")
    with pytest.raises(Exception, match="comes twice in the ledger: a"):
        jsonl.ledger(spark, str(tmp_path / "sums")).collect()
