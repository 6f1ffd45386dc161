"""The TIFF container: directories of levels and the place of each block, read by range; and a directory for given block sizes.

Classic and 64-bit files of either byte order, strips and tiles, samples together or by plane, uncompressed and deflate, horizontal predictor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

# fixed values of the format: tags, and the size and code of each field type
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, SUBFILE, SCALE, TIEPOINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 254, 33550, 33922, 34735, 42113
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
KINDS = {1: "u", 2: "i", 3: "f"}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
GEOGRAPHIC, PROJECTED = 2048, 3072


@dataclass
class Level:
    """One directory.  ``offsets`` and ``counts`` are by plane, then by row of blocks."""

    width: int
    height: int
    bands: int
    dtype: str  # as NumPy writes it, with the file's byte order
    block_width: int
    block_height: int
    tiled: bool
    planes: bool  # bands apart
    compression: int
    predictor: int
    reduced: bool
    offsets: Sequence[int]
    counts: Sequence[int]
    nodata: float | None = None
    scale: tuple = ()
    tiepoint: tuple = ()
    epsg: int | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)


def directories(read: Callable[[int, int], bytes], size: int) -> tuple[list[Level], int]:
    """All levels, largest first as the file has them, and where the first directory is.  ValueError for what is no such file."""
    head = read(0, min(16, size))
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("no TIFF byte order")
    version = struct.unpack(order + "H", head[2:4])[0]
    if version not in (42, 43) or version == 43 and len(head) < 16:
        raise ValueError(f"TIFF version {version}")
    big = version == 43
    first = at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    entry, word, seen, levels = (20, "Q", 8, []) if big else (12, "I", 2, [])
    visited = set()
    while at:
        if at in visited:
            raise ValueError("directories in a circle")
        visited.add(at)
        n = struct.unpack(order + ("Q" if big else "H"), read(at, seen))[0]
        raw = read(at + seen, n * entry + (8 if big else 4))
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(order + "HH" + word, raw[k * entry : k * entry + 4 + (8 if big else 4)])
            if kind not in TYPES:
                continue
            width, code = TYPES[kind]
            value = raw[k * entry + 4 + (8 if big else 4) : (k + 1) * entry]
            total = width * count
            if total > len(value):
                value = read(struct.unpack(order + word, value)[0], total)
            tags[tag] = value[:total].rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(order + code * count, value[:total])
        levels.append(_level(tags, order))
        at = struct.unpack(order + word, raw[n * entry :])[0]
    if not levels:
        raise ValueError("no directory")
    return levels, first


def _level(tags: dict, order: str) -> Level:
    for tag in (WIDTH, HEIGHT):
        if tag not in tags:
            raise ValueError(f"tag {tag} is missing")
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    bits, kind = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_FORMAT, (1,)))
    if len(bits) > 1 or len(kind) > 1 or next(iter(bits)) not in (8, 16, 32, 64) or next(iter(kind)) not in KINDS:
        raise ValueError(f"samples of {sorted(bits)} bits and kinds {sorted(kind)}")
    tiled = TILE_WIDTH in tags
    offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
    block = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    if not all((width, height, bands, *block)) or offsets is None or counts is None:
        raise ValueError("a size or the places of blocks are missing")
    nodata = tags.get(NODATA)
    keys = tags.get(GEO_KEYS, ())
    epsg = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    out = Level(
        width, height, bands, f"{order}{KINDS[next(iter(kind))]}{next(iter(bits)) // 8}", *block, tiled, one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1), bool(one(SUBFILE, 0) & 1),
        offsets, counts, float(nodata) if nodata else None, tags.get(SCALE, ()), tags.get(TIEPOINT, ()), epsg.get(PROJECTED, epsg.get(GEOGRAPHIC)),
    )
    want = out.across * out.down * (bands if out.planes else 1)
    if len(offsets) != want or len(counts) != want:
        raise ValueError(f"{len(offsets)} blocks where {want} are due")
    return out


def decode(raw: bytes, dtype: str, shape: tuple[int, int, int], compression: int, predictor: int) -> np.ndarray:
    """A block's samples (rows, columns, samples); a last strip's missing rows are not in ``shape``."""
    if compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif compression != NONE:
        raise ValueError(f"compression {compression}")
    need = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if len(raw) < need:
        raise ValueError(f"a block of {len(raw)} bytes where {need} are due")
    out = np.frombuffer(raw[:need], dtype).reshape(shape)
    if predictor == 2:
        return np.cumsum(out.astype(np.dtype(dtype).newbyteorder("=")), axis=1, dtype=np.dtype(dtype).newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return out


@dataclass
class Plan:
    """A level to be written: tiles of ``block`` by plane; ``counts`` by plane, then by row of tiles (0: no tile)."""

    width: int
    height: int
    bands: int
    counts: Sequence[int]


def layout(plans: Sequence[Plan], block: int, nodata: float | None, scale: Sequence[float], tiepoint: Sequence[float], epsg: int | None) -> tuple[bytes, list[list[int]]]:
    """The bytes before the data of a little-endian float32 deflate file, and each tile's offset.

    Directories come first, then the data of the smallest level, and so on to the full one.
    """
    total = sum(sum(p.counts) for p in plans)
    big = total + 64 * sum(len(p.counts) for p in plans) + 65536 > 1 << 32

    def build(offsets: list[list[int]]) -> bytes:
        out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
        for k, (p, places) in enumerate(zip(plans, offsets, strict=True)):
            wide = 16 if big else 4
            tags = [
                (SUBFILE, 4, [1 if k else 0]), (WIDTH, 4, [p.width]), (HEIGHT, 4, [p.height]), (BITS, 3, [32] * p.bands), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [p.bands]), (PLANAR, 3, [2]),
                (TILE_WIDTH, 4, [block]), (TILE_HEIGHT, 4, [block]), (TILE_OFFSETS, wide, places), (TILE_COUNTS, wide, list(p.counts)), (SAMPLE_FORMAT, 3, [3] * p.bands),
            ]
            if not k and scale:
                tags += [(SCALE, 12, [*scale, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, *tiepoint, 0.0])]
            if not k and epsg:
                degrees = 4000 <= epsg < 5000
                tags.append((GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 2 if degrees else 1, GEOGRAPHIC if degrees else PROJECTED, 0, 1, epsg]))
            if nodata is not None:
                tags.append((NODATA, 2, [f"{nodata:g}".encode() + b"\0"]))
            room, word, entry = (8, "Q", 20) if big else (4, "I", 12)
            begin = len(out)
            after = begin + (8 if big else 2) + entry * len(tags) + room
            fields, extra = bytearray(), bytearray()
            for tag, kind, values in tags:
                raw = values[0] if kind == 2 else struct.pack("<" + TYPES[kind][1] * len(values), *values)
                fields += struct.pack("<HH" + word, tag, kind, len(raw) if kind == 2 else len(values))
                if len(raw) <= room:
                    fields += raw.ljust(room, b"\0")
                else:
                    fields += struct.pack("<" + word, after + len(extra))
                    extra += raw + b"\0" * (-len(raw) % 8)
            following = after + len(extra) if k + 1 < len(plans) else 0
            out += struct.pack("<Q" if big else "<H", len(tags)) + fields + struct.pack("<" + word, following) + extra
        return bytes(out)

    at = len(build([[0] * len(p.counts) for p in plans]))
    offsets: list[list[int]] = [[] for _ in plans]
    for k in reversed(range(len(plans))):
        for count in plans[k].counts:
            offsets[k].append(at if count else 0)
            at += count
    return build(offsets), offsets
