"""File systems of addresses."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs


def store(root: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of an address and the path in it; null where only Spark reads it."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root.removeprefix("file:")
    if "://" not in root:
        return fs.LocalFileSystem(), os.path.abspath(root)
    try:
        return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    except (pa.ArrowInvalid, OSError):
        return None
