"""Numbered lines are the same wherever files are cut."""

from __future__ import annotations

import gzip
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.sources import jsonl, ranges
from plumbline.sources.store import open_store


def expected(raw: bytes) -> list[tuple[int, str]]:
    if not raw:
        return []
    parts = raw.split(b"\n")
    if parts[-1] == b"":
        parts.pop()
    return [(k, p[:-1].decode("utf-8", "replace") if p.endswith(b"\r") else p.decode("utf-8", "replace")) for k, p in enumerate(parts, 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"\n", b"\r\n", b"\r", "é".encode(), "𐍈".encode(), b"a", b"bc" * 5, b""])), st.integers(1, 9), st.integers(1, 7))
def test_any_cut_of_any_bytes(tmp_path_factory, parts, split, chunk):
    raw = b"".join(parts)
    path = tmp_path_factory.mktemp("r") / "f"
    path.write_bytes(raw)
    store, at = open_store(str(path))
    lines, no = [], 0
    for first in range(0, len(raw), split):
        last = min(first + split, len(raw))
        mine = [x for some in ranges.lines_in(store, at, first, last, chunk) for x in some]
        assert len(mine) == ranges.count_starts(store, at, first, last)
        lines += [(no + k, ranges._text([x])[0].as_py()) for k, x in enumerate(mine, 1)]
        no += len(mine)
    assert lines == expected(raw)


def test_splits_make_no_difference(spark, tmp_path):
    rng = random.Random(1)
    texts = {
        "a.jsonl": "".join('{"k": "' + rng.choice("xé𐍈") * rng.randint(0, 40) + '"}' + rng.choice(["\n", "\r\n"]) for _ in range(200)).encode(),
        "sub/b c%20d.jsonl": '{"k": "no end"}'.encode(), "empty.jsonl": b"", "long.jsonl": b'{"k": "' + b"y" * 100_000 + b'"}\n{"k": 1}\n', "odd.jsonl": b'{"k": "\xff\xe9"}\r\n',
    }
    (tmp_path / "sub").mkdir()
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "z.jsonl.gz").write_bytes(gzip.compress(texts["a.jsonl"]))
    due = sorted((name, *x) for name, raw in texts.items() for x in expected(raw)) + [("z.jsonl.gz", *x) for x in expected(texts["a.jsonl"])]
    for split in (1, 7, 64, 5000, ranges.SPLIT):
        if split < 64:
            got = ranges.numbered_lines(spark, [str(tmp_path / "sub"), str(tmp_path / "odd.jsonl")], split)
            want = [d for d in due if d[0].startswith(("sub", "odd"))]
        else:
            got, want = ranges.numbered_lines(spark, str(tmp_path), split), due
        found = sorted((r["path"].split(f"{tmp_path.name}/", 1)[1], r["line_no"], r["line"]) for r in got.collect())
        assert found == sorted(want), split


def test_a_blank_line_has_its_place(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"k": 1}\n' * 50 + "  \n" + '{"k": 2}\n' * 50)
    for split in (30, ranges.SPLIT):
        with pytest.raises(Exception, match=r"blank line at \S*bad.jsonl:51"):
            jsonl.scan(spark, str(path), split_bytes=split).collect()
        kept = jsonl.scan(spark, str(path), "k int", strict=False, split_bytes=split)
        assert sorted(r["line_no"] for r in kept.collect()) == [k for k in range(1, 102) if k != 51]


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ranges.numbered_lines(spark, str(tmp_path / "none"))
    (tmp_path / "e").write_bytes(b"")
    assert ranges.numbered_lines(spark, str(tmp_path)).count() == 0
