"""Files of any store that Arrow's file systems open: listings with sizes, and reads of a range. Used inside tasks and, for listings, on the driver."""

from __future__ import annotations

import fnmatch
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs


@lru_cache(maxsize=16)
def _system(scheme: str, host: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if scheme in ("", "file") else fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    parts = urlsplit(uri)
    if len(parts.scheme) < 2:  # no scheme, or a drive
        return _system("", ""), uri
    path = unquote(parts.path)
    return _system(parts.scheme, parts.netloc), path if parts.scheme in ("file", "hdfs", "viewfs") else f"{parts.netloc}{path}"


def listed(uri: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(URI, bytes) of the file at uri, or of all files below that folder whose name matches, hidden ones left out, in the order of their paths."""
    system, path = located(uri)
    root = uri[: len(uri) - len(path)] if uri.endswith(path) else uri.split("://")[0] + "://"
    at = system.get_file_info(path.rstrip("/") or path)
    found = [at] if at.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    names = [(f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, pattern)]
    return sorted((f"{root}{p}", n) for p, n in names)


def opened(uri: str) -> pa.NativeFile:
    """A file for reading at any place; only what is read is fetched."""
    system, path = located(uri)
    return system.open_input_file(path)


def put(uri: str, content: bytes) -> None:
    """Writes a file whole or not at all: under a name of its own first, then renamed. A repeated task writes the same once more."""
    import uuid

    system, path = located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, path)
