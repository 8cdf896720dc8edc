"""WARC archives as a PySpark Python data source (format ``warc``), and the writing of pages with revisit records.

Reading plans partitions from the archives (one or more files each, by size), parses a record's headers first, and asks the
pushed-down predicates on the record type and other headers before it touches the payload; unwanted payloads are skipped by
seeking where the length of a record is known, and never decoded. Compressed archives hold a gzip member per record; this
writer notes each member's length in the standard's optional ``sl`` field, so that even compressed records can be skipped.
Members without that field (other writers) are inflated to find their end, and plain ``.warc`` files are skipped by
``Content-Length``.

Writing goes to files with names that no other attempt uses; only the files that the driver's commit lists in a manifest are
read again, so a lost executor or a repeated task leaves nothing that counts. Any store that pyarrow can open will do.

Options: ``path``; ``payload`` (``false`` reads headers alone); ``partition_bytes``; ``file_bytes``; ``compress``.

Nulls and edge cases: a null payload is written as an empty one, a null URL as no header; line ends inside a URL are
percent-encoded; records without an id or type are errors; empty payloads and very long ones are kept whole (lengths of
4 GB and more have no ``sl`` field); repeated rows give repeated records; an empty table gives an archive without records
and reading it an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from plumbline.llm.common import cut, fresh_path

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, content_type string, headers map<string,string>, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "content_type": "content-type"}
EXTRA = struct.Struct("<2s2BIBBH2sHII")  # a gzip header with the sl field


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# Records ----------------------------------------------------------------------------------------------------------


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member that says how long it is."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = EXTRA.size + len(body) + len(tail)
    if max(size, len(raw)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(6) + body + tail
    return EXTRA.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(raw)) + body + tail


def parse_headers(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record starts with {first[:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class Records:
    """Headers of each record of an archive in turn, with a call that reads its block, and seeks over it otherwise."""

    def __init__(self, file, compressed: bool):
        self.file, self.compressed, self.size = file, compressed, file.size()
        self.inflated = 0  # bytes of blocks that were decoded

    def __iter__(self):
        at = 0
        while at < self.size:
            at = yield from (self._member(at) if self.compressed else self._plain(at))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def _plain(self, at: int):
        head = b""
        while b"\r\n\r\n" not in head:
            more = self._read(at + len(head), 8192)
            if not more:
                if head.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return self.size
            head += more
            stripped = head.lstrip(b"\r\n")
            at, head = at + len(head) - len(stripped), stripped
        raw = head.split(b"\r\n\r\n", 1)[0]
        headers = parse_headers(raw)
        start, n = at + len(raw) + 4, int(headers.get("content-length", 0))

        def block() -> bytes:
            self.inflated += n
            return self._read(start, n)

        yield headers, block
        return start + n

    def _member(self, at: int):
        fixed = self._read(at, 10)
        if fixed[:2] != b"\x1f\x8b":
            raise ValueError("an archive's gzip member has no gzip header")
        known = 0
        if fixed[3] & 4:
            (n,) = struct.unpack("<H", self._read(at + 10, 2))
            extra = self._read(at + 12, n)
            while len(extra) >= 4:
                (m,) = struct.unpack("<H", extra[2:4])
                if extra[:2] == b"sl" and m >= 4:
                    (known,) = struct.unpack("<I", extra[4:8])
                extra = extra[4 + m :]
        z = zlib.decompressobj(31)
        pos, head = at, b""
        while b"\r\n\r\n" not in head and not z.eof:
            more = z.unconsumed_tail or self._read(pos, 4096)
            if not z.unconsumed_tail:
                pos += len(more)
            if not more:
                raise ValueError("an archive ends inside a record's headers")
            head += z.decompress(more, 4096)
        raw, rest = head.split(b"\r\n\r\n", 1)
        headers = parse_headers(raw)
        n = int(headers.get("content-length", 0))
        state = {"pos": pos, "body": rest}

        def finish(keep: bool) -> bytes:
            parts = [state["body"]] if keep else []
            tail = z.unconsumed_tail
            while not z.eof:
                if not tail:
                    tail = self._read(state["pos"], 1 << 18)
                    if not tail:
                        raise ValueError("an archive ends inside a record")
                    state["pos"] += len(tail)
                out = z.decompress(tail)
                tail = z.unconsumed_tail
                if keep:
                    parts.append(out)
            return b"".join(parts)

        def block() -> bytes:
            self.inflated += n
            return finish(True)[:n]

        yield headers, block
        if known:
            return at + known
        finish(False)
        return state["pos"] - len(z.unused_data)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What the HTTP message in the block carries; other blocks are the payload themselves."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.split(b"\r\n\r\n", 1)[1] if b"\r\n\r\n" in block else b""
    return block


def hex_digest(value: str | None) -> str | None:
    """``sha1:`` in base 32 or hex as bare lower-case hex."""
    if not value:
        return None
    _, _, digest = value.rpartition(":")
    if len(digest) == 32:
        return base64.b32decode(digest.upper()).hex()
    return digest.lower()


def base32_digest(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


# The data source ----------------------------------------------------------------------------------------------------


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are written once; choose a new path or append")
        return WarcWriter(dict(self.options))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Predicates on headers are decided before a block is read; the others are left to Spark."""
        for f in filters:
            name = HEADER_OF.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, EqualTo):
                self.wanted.append((name, "in", {f.value}))
            elif name and isinstance(f, In):
                self.wanted.append((name, "in", set(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", f.value))
            elif name and isinstance(f, (IsNull, IsNotNull)):
                self.wanted.append((name, "null", isinstance(f, IsNull)))
            else:
                yield f

    def wants(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.wanted:
            have = headers.get(name)
            if how == "null":
                if (have is None) != value:
                    return False
            elif have is None or (have not in value if how == "in" else not have.startswith(value)):
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        infos = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        notes = [x for x in infos if x.base_name.startswith("_manifest-")]
        found = {x.path: x.size for x in infos if x.base_name.endswith((".warc", ".warc.gz"))}
        if notes:
            listed = set()
            for x in notes:
                with store.open_input_file(x.path) as f:
                    listed |= {f"{root.rstrip('/')}/{name}" for name in json.loads(f.read())["files"]}
            if missing := listed - found.keys():
                raise FileNotFoundError(f"listed in a manifest but not there: {sorted(missing)[:5]}")
            found = {k: v for k, v in found.items() if k in listed}
        parts, size = [[]], 0
        for path in sorted(found):
            if parts[-1] and size + found[path] > self.bytes:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += found[path]
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        columns: list[list] = [[] for _ in range(10)]
        held = 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for headers, block in Records(file, path.endswith(".gz")):
                    if not self.wants(headers):
                        continue
                    kind = headers["warc-type"]
                    payload = payload_of(headers, block()) if self.payload and kind != "revisit" else None
                    size = headers.get("warc-x-payload-length")
                    held += len(payload or b"") + 500
                    row = (headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-refers-to"), hex_digest(headers.get("warc-payload-digest")))
                    row += (int(size) if size else len(payload) if payload is not None else None, headers.get("content-type"), list(headers.items()), payload)
                    for c, v in zip(columns, row):
                        c.append(v)
                    if held > 4 << 20:
                        yield _batch(columns)
                        columns, held = [[] for _ in range(10)], 0
        if columns[0]:
            yield _batch(columns)


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str], records: int):
        self.files, self.records = files, records


class WarcWriter(DataSourceArrowWriter):
    """Rows with the columns of the reader; ``headers`` and ``content_type`` of the rows aren't used."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("file_bytes", 64 << 20))
        self.compress = options.get("compress", "true").lower() != "false"

    def _record(self, row: dict) -> bytes:
        if not row["record_id"] or not row["record_type"]:
            raise ValueError("a record needs an id and a type")
        revisit = row["record_type"] == "revisit"
        payload = row.get("payload") or b""
        digest = row.get("payload_digest") or hashlib.sha1(payload).hexdigest()
        uri = row.get("target_uri")
        size = row.get("payload_bytes")
        headers = [
            ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z"),
            ("WARC-Target-URI", uri and uri.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", base32_digest(digest)),
            ("WARC-X-Payload-Length", str(len(payload) if size is None else size)), ("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", PROFILE if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        return record(headers, HTTP if revisit else HTTP + payload)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, out, written, records = [], None, 0, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                raw = self._record(batch.slice(k, 1).to_pylist()[0])
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                    out, written = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                raw = member(raw) if self.compress else raw
                out.write(raw)
                written, records = written + len(raw), records + 1
                if written >= self.limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files, records)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        name = f"{root}/_manifest-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{name}.tmp", compression=None) as f:
            f.write(json.dumps({"files": sorted(x for m in done for x in m.files), "records": sum(m.records for m in done)}).encode())
        store.move(f"{name}.tmp", name)

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        for m in messages:
            for x in m.files if m is not None else []:
                try:
                    store.delete_file(f"{root}/{x}")
                except OSError:
                    pass  # what no manifest lists isn't read


# Pages ----------------------------------------------------------------------------------------------------------------

ID = "urn:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """A record per page. Of equal payloads of ``least_bytes`` or more, the page with the largest id is the response and
    the others revisit it; equal ids there are all responses, and so are pages without an id, which read back without one."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    keyed = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    first = keyed.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written down first: if it is small, its size is then known and the payloads needn't be shuffled
    first = cut(first.select(F.col("payload_digest").alias("d"), "first"), "payloads")
    joined = keyed.join(first, keyed["payload_digest"] == first["d"], "left")
    revisit = F.coalesce((F.col("id") < F.col("first")) & (F.col("payload_bytes") >= least_bytes), F.lit(False))
    uid = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        uid(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(revisit, uid(F.col("first"))).alias("refers_to"), "payload_digest", "payload_bytes", F.lit(None).cast("string").alias("content_type"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str | None = None, **options: str) -> str:
    """Write the pages' records and give the path of the archives."""
    register(pages.sparkSession)
    path = path or fresh_path(pages.sparkSession, "archives")
    page_records(pages).write.format("warc").options(**options).mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(record_id: Column) -> Column:
    return F.regexp_extract(record_id, ID + r"(-?\d+)", 1).try_cast("long")
