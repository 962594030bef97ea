"""Opening one file on an executor through the Arrow file systems."""

from __future__ import annotations


def open_input(path: str):
    """Random-access reader of a local or object-store path."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(_local(path))
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _local(path: str) -> str:
    from urllib.parse import unquote
    return unquote("/" + path[len("file:"):].lstrip("/"))
