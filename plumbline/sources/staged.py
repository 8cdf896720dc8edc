"""A sink for files with a two-phase commit, as a PySpark data source (format ``staged_files``).

A task writes each file under a name that no other attempt uses, takes its digest while it writes, and moves it to a name that has the digest in it. Nothing
of that counts until the driver commits: it writes a manifest with the next number beside the last one and moves it to its
place, so a reader sees the old files or the new ones. A task that dies, a repeated attempt and a job that fails leave only files
that no manifest lists; ``vacuum`` deletes these.

Because names come from contents, writing the same rows again finds its files there. They are read and their digests compared in the tasks,
and only what is missing or differs is written.

Rows come as ``file`` and ``line`` (text), or as ``file``, ``path`` and ``content`` (tar members), grouped by ``file`` and in order. A file belongs to one task; the
same file from two tasks is an error and nothing is committed.
"""

from __future__ import annotations

import hashlib
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from plumbline.sources.store import open_store, sha256_of

ENTRY = "file string, stored string, sha256 string, bytes long, rows long"
PLAIN_MODE = 0o644


class Hashed:
    """An output stream that knows its digest and size."""

    def __init__(self, out):
        self.out, self.digest, self.size = out, hashlib.sha256(), 0

    def write(self, data) -> int:
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        return len(data)


class Done(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


def stored_name(name: str, digest: str) -> str:
    """``a/b.ext`` with the digest: ``a/b-<16 hex>.ext``."""
    folder, _, last = name.rpartition("/")
    stem, dot, ext = last.partition(".")
    return f"{folder}{'/' if folder else ''}{stem}-{digest[:16]}{dot}{ext}"


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.append = options["path"].rstrip("/"), options.get("how", "replace") == "append"
        self.tar = "content" in columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, root = open_store(self.path)
        files, now, out = [], None, None

        def close() -> None:
            nonlocal out
            if out is not None:
                files.append(self._finish(store, root, *out))
                out = None

        for batch in iterator:
            names = batch.column("file").to_pylist()
            edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if names[a] != now or out is None:
                    close()
                    now = names[a]
                    if not now or now.startswith("/") or ".." in now.split("/"):
                        raise ValueError(f"no name for a file of the sink: {now!r}")
                    temporary = f"{root}/_staging/{uuid.uuid4().hex}"
                    store.create_dir(f"{root}/_staging", recursive=True)
                    hashed = Hashed(store.open_output_stream(temporary, compression=None))
                    out = [now, temporary, hashed, tarfile.open(fileobj=hashed, mode="w|", format=tarfile.PAX_FORMAT) if self.tar else None, 0]
                out[4] += self._add(out, batch.slice(a, b - a))
        close()
        return Done(files)

    def _add(self, out: list, rows: pa.RecordBatch) -> int:
        if out[3] is None:
            lines = rows.column("line").to_pylist()
            if None in lines:
                raise ValueError(f"a null line for {out[0]}")
            out[2].write("".join(x + "\n" for x in lines).encode())
            return len(lines)
        for path, content in zip(rows.column("path"), rows.column("content")):
            data = content.as_buffer()
            info = tarfile.TarInfo(path.as_py())
            info.size, info.mode = len(data) if data is not None else 0, PLAIN_MODE  # owner and times are zero
            out[3].addfile(info, pa.BufferReader(data) if data is not None else None)
        return rows.num_rows

    @staticmethod
    def _finish(store, root: str, name: str, temporary: str, hashed: Hashed, archive, rows: int) -> dict:
        from pyarrow import fs

        if archive is not None:
            archive.close()
        hashed.out.close()
        digest = hashed.digest.hexdigest()
        entry = {"file": name, "stored": stored_name(name, digest), "sha256": digest, "bytes": hashed.size, "rows": rows, "written": True}
        target = f"{root}/{entry['stored']}"
        there = store.get_file_info(target)
        if there.type == fs.FileType.File and there.size == hashed.size and sha256_of(store, target)[0] == digest:
            store.delete_file(temporary)
            entry["written"] = False
        else:
            store.create_dir(target.rpartition("/")[0], recursive=True)
            if there.type == fs.FileType.File:
                store.delete_file(target)
            store.move(temporary, target)
        return entry

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        entries = [e for m in messages if m is not None for e in m.files]
        number, before = current(store, root)
        names = [e["file"] for e in entries]
        if len(set(names)) < len(names):
            raise ValueError(f"files from several tasks: {sorted({n for n in names if names.count(n) > 1})[:5]}")
        if self.append:
            old = {e["file"]: e for e in before}
            if changed := [e["file"] for e in entries if e["file"] in old and old[e["file"]]["sha256"] != e["sha256"]]:
                raise ValueError(f"already stored with other rows: {sorted(changed)[:5]}")
            entries = [e for e in entries if e["file"] not in old] + before
        written = sum(e.get("written", False) for e in entries)
        text = json.dumps({"files": sorted(({k: v for k, v in e.items() if k != "written"} for e in entries), key=lambda e: e["file"]), "written": written}, indent=1)
        store.create_dir(root, recursive=True)
        place = f"{root}/_manifest-{number + 1:08d}.json"
        temporary = f"{root}/_staging-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary, compression=None) as f:
            f.write(text.encode())
        store.move(temporary, place)

    def abort(self, messages) -> None:
        """Files of a failed job have names that no manifest lists; nothing needs to be undone."""


def current(store, root: str) -> tuple[int, list[dict]]:
    """The number and the files of the last manifest; 0 and none where nothing was committed yet."""
    from pyarrow import fs

    found = [x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.is_file and x.base_name.startswith("_manifest-")]
    if not found:
        return 0, []
    last = max(found, key=lambda x: x.base_name)
    with store.open_input_file(last.path) as f:
        return int(last.base_name[10:-5]), json.loads(f.read())["files"]


class StagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite):
        return StagedWriter(dict(self.options), schema.fieldNames())


def _save(rows: DataFrame, path: str, append: bool) -> dict:
    spark = rows.sparkSession
    spark.dataSource.register(StagedFiles)
    rows.write.format("staged_files").option("how", "append" if append else "replace").mode("append").save(path)
    return manifest(path)


def write_lines(rows: DataFrame, path: str, file: Column, order: list[str], line: Column, append: bool = False) -> dict:
    """Commit text files below ``path``: ``file`` names the file of each row, ``line`` is its text, ``order`` the order of lines in a file (then by the line
    itself). Without ``append`` the committed files become exactly these; with it, they are added, and a file that is
    there with other rows is an error. Returns the manifest."""
    own = [f"o{k}" for k in range(len(order))]
    named = rows.select(file.alias("file"), *[F.col(c).alias(o) for c, o in zip(order, own)], line.alias("line"))
    return _save(named.repartition("file").sortWithinPartitions("file", *own, "line").select("file", "line"), path, append)


def write_archives(rows: DataFrame, path: str, archive: str = "archive", member: str = "path", content: str = "content", append: bool = False) -> dict:
    """Commit tar archives: members in the order of their paths (then contents), owner and times zeroed, so equal rows give equal bytes. An archive streams through one
    task, a member at a time, whatever its size."""
    named = rows.select(F.col(archive).alias("file"), F.col(member).alias("path"), F.col(content).cast("binary").alias("content"))
    return _save(named.repartition("file").sortWithinPartitions("file", "path", "content"), path, append)


def manifest(path: str) -> dict:
    """``number`` and ``files`` of the last commit."""
    store, root = open_store(path.rstrip("/"))
    number, files = current(store, root)
    return {"number": number, "files": files}


def committed(path: str) -> list[str]:
    """The places of the committed files, for any reader."""
    return [f"{path.rstrip('/')}/{e['stored']}" for e in manifest(path)["files"]]


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``file, stored, sha256, bytes, rows`` of the committed files in the order of their names: what an inventory lists."""
    return spark.createDataFrame([tuple(e[c] for c in ("file", "stored", "sha256", "bytes", "rows")) for e in manifest(path)["files"]], ENTRY)


def vacuum(path: str) -> list[str]:
    """Delete what the last manifest doesn't list: files of attempts that failed and of earlier commits. Only when no job writes there and none
    reads an earlier commit."""
    from pyarrow import fs

    store, root = open_store(path.rstrip("/"))
    number, files = current(store, root)
    keep = {f"{root}/{e['stored']}" for e in files} | {f"{root}/_manifest-{number:08d}.json"}
    gone = [x.path for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if x.is_file and x.path not in keep]
    for x in gone:
        store.delete_file(x)
    return sorted(g[len(root) + 1 :] for g in gone)
