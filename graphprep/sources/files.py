"""Files that tasks open themselves, by the paths that Spark tells of them."""

from __future__ import annotations

from pyarrow import fs


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; without a scheme it is a local path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
