"""Files by byte range, for formats that Spark itself does not read."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs

#: Names that Spark's file systems have and Arrow's have not.
SCHEMES = {"s3a": "s3", "s3n": "s3", "": "file"}


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a place that Spark names (``file:/x``, ``s3a://bucket/x``, ``hdfs://...``)."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


class Ranges:
    """Reads ranges of one file and counts the bytes."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        self.size, self.bytes = self.file.size(), 0

    def __call__(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset} + {length} is outside of {self.size} bytes")
        self.bytes += length
        return self.file.read_at(length, offset)

    def __enter__(self) -> Callable[[int, int], bytes]:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
