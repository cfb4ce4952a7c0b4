"""Files opened by path inside tasks, so that a task reads only the bytes it needs.

Paths are those Spark lists.  Local files are opened directly, other stores through the file systems of Arrow;
a store that Arrow does not know raises there.
"""

from __future__ import annotations

import bz2
import gzip
from typing import IO
from urllib.parse import urlsplit

from pyarrow import fs


def _split(path: str) -> tuple[fs.FileSystem | None, str]:
    """The store of a path and the path inside it; no store for local files."""
    at = urlsplit(path)
    if at.scheme in ("", "file"):
        return None, path.removeprefix("file://").removeprefix("file:")
    store, _ = fs.FileSystem.from_uri(f"{at.scheme}://{at.netloc}/")
    return store, path.split("://", 1)[1]


def open_file(path: str) -> IO[bytes]:
    """The file for reading, with seeking."""
    store, inside = _split(path)
    return open(inside, "rb") if store is None else store.open_input_file(inside)


def open_plain(path: str) -> IO[bytes]:
    """The file as a stream, unpacked where its name says that it is packed."""
    raw = open_file(path)
    if path.endswith(".gz"):
        return gzip.GzipFile(fileobj=raw)
    return bz2.BZ2File(raw) if path.endswith(".bz2") else raw


def write_file(path: str, content: bytes) -> None:
    """A whole file at once; its folder is made where stores have folders."""
    store, inside = _split(path)
    store = store or fs.LocalFileSystem()
    store.create_dir(inside.rsplit("/", 1)[0])
    with store.open_output_stream(inside) as out:
        out.write(content)
