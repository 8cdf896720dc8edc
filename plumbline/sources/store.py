"""Files in any store that pyarrow can open, by URI or plain path."""

from __future__ import annotations

import hashlib

CHUNK = 4 << 20


def open_store(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def sha256_of(store, path: str) -> tuple[str, int]:
    """The digest and the size of a file, read in chunks."""
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(path, compression=None) as f:
        while data := f.read(CHUNK):
            digest.update(data)
            size += len(data)
    return digest.hexdigest(), size
