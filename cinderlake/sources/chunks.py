"""A chunked array store in the open Zarr layout (version 2): arrays over (time, row, col), an object a chunk, appended along time.

Cells become chunks by one shuffle, and each task writes its chunks' objects (zlib) to their own names.  What a store holds is what its metadata says: chunks beyond
the committed shape are not seen, so a write is committed by the metadata, which comes last, and a job that fails leaves nothing visible; one that is run again writes
the same objects again.  Appending time steps therefore writes new chunks and metadata only.

Reading starts from the chunks' numbers (a range of Spark's, filtered by the slice that is asked for), so only objects that meet the slice are opened.
One writer at a time is assumed, as the layout has no locks; a writer that finds another commit than it began from stops.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import Kept
from .files import open_fs

CHUNKS = (1, 512, 512)
AXES = ["time", "y", "x"]


@dataclass
class Store:
    """The committed state of a store: times (seconds, ascending) and the shape of each variable's rows and columns."""

    path: str
    chunks: tuple[int, int, int]
    times: list[int]
    shapes: dict[str, tuple[int, int]] = field(default_factory=dict)


def _put(uri: str, name: str, raw: bytes) -> None:
    system, root = open_fs(uri)
    system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{root}/{name}.new") as out:
        out.write(raw)
    system.move(f"{root}/{name}.new", f"{root}/{name}")


def _get(uri: str, name: str) -> bytes | None:
    system, root = open_fs(uri)
    if system.get_file_info(f"{root}/{name}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def open_store(path: str) -> Store:
    """The store at ``path``; FileNotFoundError where none is committed."""
    raw = _get(path, ".zmetadata")
    if raw is None:
        raise FileNotFoundError(f"no store at {path}")
    held = json.loads(raw)["metadata"]
    times = np.frombuffer(_get(path, f"time/{held['time/.zattrs']['object']}"), "<i8")[: held["time/.zarray"]["shape"][0]]
    arrays = {k.split("/")[0]: v for k, v in held.items() if k.endswith("/.zarray") and k != "time/.zarray"}
    chunks = next((tuple(v["chunks"]) for v in arrays.values()), CHUNKS)
    return Store(path, chunks, [int(t) for t in times], {k: (v["shape"][1], v["shape"][2]) for k, v in arrays.items()})


def _commit(store: Store, before: bytes | None) -> None:
    """Write the metadata of ``store`` if the one committed is still ``before``."""
    zlib_of = {"id": "zlib", "level": 6}
    n, name = len(store.times), str(len(store.times))
    # the new list of times is an object of its own, so that readers of the old metadata keep theirs
    _put(store.path, f"time/{name}", np.array(store.times, "<i8").tobytes())
    held = {
        ".zgroup": {"zarr_format": 2},
        "time/.zarray": {"zarr_format": 2, "shape": [n], "chunks": [max(n, 1)], "dtype": "<i8", "compressor": None, "fill_value": 0, "order": "C", "filters": None},
        "time/.zattrs": {"_ARRAY_DIMENSIONS": ["time"], "units": "seconds since 1970-01-01", "object": name},
    }
    for v, shape in store.shapes.items():
        held[f"{v}/.zarray"] = {"zarr_format": 2, "shape": [n, *shape], "chunks": list(store.chunks), "dtype": "<f4", "compressor": zlib_of, "fill_value": "NaN", "order": "C", "filters": None}
        held[f"{v}/.zattrs"] = {"_ARRAY_DIMENSIONS": AXES}
    if _get(store.path, ".zmetadata") != before:
        raise RuntimeError(f"another writer has committed to {store.path}")
    for k, v in held.items():
        if k.startswith("."):
            _put(store.path, k, json.dumps(v).encode())
    for v in store.shapes:
        for part in (".zarray", ".zattrs"):
            _put(store.path, f"{v}/{part}", json.dumps(held[f"{v}/{part}"]).encode())
    _put(store.path, "time/.zarray", json.dumps(held["time/.zarray"]).encode())
    _put(store.path, "time/0", np.array(store.times, "<i8").tobytes())
    _put(store.path, ".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": held}).encode())


def _good(cells: DataFrame) -> DataFrame:
    seconds = F.unix_seconds("time")
    return cells.filter("variable IS NOT NULL AND time IS NOT NULL AND row >= 0 AND col >= 0").select("variable", seconds.alias("at"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("float"))


def _write(spark: SparkSession, store: Store, good: DataFrame, times: list[int], first: int, keep: Kept) -> None:
    """Write the chunks of time steps ``times``, which are number ``first`` and on."""
    ct, cy, cx = store.chunks
    number = spark.createDataFrame([(t, first + k) for k, t in enumerate(times)], "at long, step long")
    path = store.path
    keyed = good.filter("value IS NOT NULL AND NOT isnan(value)").join(F.broadcast(number), "at").withColumns({"i": F.expr(f"step div {ct}"), "j": F.expr(f"row div {cy}"), "k": F.expr(f"col div {cx}")})

    def run(key, t):
        variable, i, j, k = (x.as_py() for x in key)
        block = np.full((ct, cy, cx), np.nan, "<f4")
        value = t.column("value").to_numpy()
        block[t.column("step").to_numpy() - i * ct, t.column("row").to_numpy() - j * cy, t.column("col").to_numpy() - k * cx] = value
        name, raw = f"{variable}/{i}.{j}.{k}", zlib.compress(block.tobytes(), 6)
        _put(path, name, raw)
        return pa.table({"name": [name], "bytes": pa.array([len(raw)], pa.int64())})

    keep(keyed.select("variable", "i", "j", "k", "step", "row", "col", "value").groupBy("variable", "i", "j", "k").applyInArrow(run, "name string, bytes long"))


def _times(good: DataFrame) -> list[int]:
    return [r[0] for r in good.select("at").distinct().orderBy("at").collect()]  # the store's own axis


def write_store(cells: DataFrame, path: str, chunks: tuple[int, int, int] = CHUNKS) -> Store:
    """A new store of variable, time (timestamp), row, col, value.

    Cells with a null or negative place are left out, those that are missing are NaN, and of cells that repeat a place one counts.
    """
    if _get(path, ".zmetadata") is not None:
        raise FileExistsError(path)
    spark = cells.sparkSession
    keep = Kept(spark, "chunks")
    good = keep(_good(cells))
    shapes = {r["variable"]: (r["h"], r["w"]) for r in good.groupBy("variable").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).collect()}
    store = Store(path, chunks, _times(good), shapes)
    _write(spark, store, good, store.times, 0, keep)
    _commit(store, None)
    keep.drop()
    return store


def append(cells: DataFrame, path: str) -> Store:
    """Add later time steps of the store's variables: no chunk that is there is touched.

    Steps must be later than the store's last one, variables and places within its own; a store whose last chunk has room for further steps is refused (chunks of one step never have).
    """
    spark = cells.sparkSession
    before, store = _get(path, ".zmetadata"), open_store(path)
    keep = Kept(spark, "chunks")
    good = keep(_good(cells))
    if len(store.times) % store.chunks[0]:
        raise ValueError("the last chunk is not full: its object would have to be written again")
    for r in good.groupBy("variable").agg(F.min("at").alias("first"), F.max("row").alias("row"), F.max("col").alias("col")).collect():
        height, width = store.shapes.get(r["variable"], (0, 0))
        if r["row"] >= height or r["col"] >= width:
            raise ValueError(f"{r['variable']}: cells outside of {height} x {width}")
        if store.times and r["first"] <= store.times[-1]:
            raise ValueError(f"{r['variable']}: a step at {r['first']} is not after {store.times[-1]}")
    new = _times(good)
    _write(spark, store, good, new, len(store.times), keep)
    store.times = store.times + new
    _commit(store, before)
    keep.drop()
    return store


def chunk_index(spark: SparkSession, store: Store, variable: str) -> DataFrame:
    """name, step_start, step_end, row_start, row_end, col_start, col_end of each chunk, ends exclusive."""
    height, width = store.shapes[variable]
    (ct, cy, cx), n = store.chunks, len(store.times)
    down, across = -(-height // cy), -(-width // cx)
    t = spark.range(-(-n // ct) * down * across).select(F.expr(f"id div {down * across}").alias("i"), F.expr(f"id div {across} % {down}").alias("j"), F.expr(f"id % {across}").alias("k"))
    ends = lambda c, size, top: ((F.col(c) * size), F.least((F.col(c) + 1) * size, F.lit(top)))
    names = [x for axis, c, size, top in (("step", "i", ct, n), ("row", "j", cy, height), ("col", "k", cx, width)) for x in (ends(c, size, top)[0].alias(f"{axis}_start"), ends(c, size, top)[1].alias(f"{axis}_end"))]
    return t.select(F.concat(F.lit(f"{variable}/"), F.concat_ws(".", "i", "j", "k")).alias("name"), *names)


def read_store(spark: SparkSession, path: str, variable: str, times: tuple[int, int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """time (timestamp), row, col, value of the cells with data in a slice (seconds, rows and columns; ends exclusive)."""
    store = open_store(path)
    steps = (int(np.searchsorted(store.times, times[0])), int(np.searchsorted(store.times, times[1]))) if times else None
    index = chunk_index(spark, store, variable)
    slices = {"step": steps, "row": rows, "col": cols}
    for axis, s in slices.items():
        if s is not None:
            index = index.filter((F.col(f"{axis}_start") < s[1]) & (F.col(f"{axis}_end") > s[0]))
    shape, root = store.chunks, store.path
    ddl = "step long, row long, col long, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                raw = _get(root, c["name"])
                if raw is None:  # a chunk without cells
                    continue
                block = np.frombuffer(zlib.decompress(raw), "<f4").reshape(shape)[: c["step_end"] - c["step_start"], : c["row_end"] - c["row_start"], : c["col_end"] - c["col_start"]]
                t, r, k = np.nonzero(~np.isnan(block))
                yield pa.RecordBatch.from_arrays([pa.array(t + c["step_start"]), pa.array(r + c["row_start"]), pa.array(k + c["col_start"]), pa.array(block[t, r, k].astype(float))], ["step", "row", "col", "value"])

    cells = index.mapInArrow(run, ddl)
    for axis, s in slices.items():
        if s is not None:
            cells = cells.filter((F.col(axis) >= s[0]) & (F.col(axis) < s[1]))
    number = spark.createDataFrame([(k, t) for k, t in enumerate(store.times)], "step long, at long")
    return cells.join(F.broadcast(number), "step").select(F.timestamp_seconds("at").alias("time"), "row", "col", "value")
