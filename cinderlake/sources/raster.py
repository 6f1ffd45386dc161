"""Raster files as tables: a directory of blocks that is filtered before anything is decoded, a tiled sink with overviews, checks and ingest.

Reading is two DataFrames.  ``raster_blocks`` has a row for each block of each file, from the files' directories alone (a few kilobytes a file, whatever its size);
filters on its columns are the window, band and level pushdown.  ``read_blocks`` then reads those blocks by byte range, in as many tasks as asked, and no others.
Both take a listing, of a batch or of a stream (``raster_files``), so a stream of new files is read by the same functions with the file
stream's own offsets.

Writing goes the other way: pixels are packed into tiles, each level's tiles are averaged from four of the level below, and a sort by (file, level, block) streams
one file after the other through a writer that holds one batch.  A file's directory needs all its tiles' sizes, so they are written first and a row with
them (24 bytes a tile) leads the file.  Tasks write to a staging folder; the driver's commit moves the files into place, and an abort deletes the folder.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.storage import Kept
from .files import Ranges, open_fs
from .tiff import DEFLATE, NONE, OLD_DEFLATE, Plan, decode, directories, layout

DESCRIBED = (
    "path string, ok boolean, issues array<string>, width long, height long, bands int, dtype string, block_width int, block_height int, tiled boolean, planes boolean, levels int, epsg int, west double, north double, x_step double, y_step double, bytes_read long"
)
BLOCKS = (
    "path string, level int, band int, block_row int, block_col int, row_start long, col_start long, row_end long, col_end long, offset long, count long, dtype string, samples int, block_width int, compression int, predictor int, nodata double, bytes_read long"
)
#: Cells of the tiles that are sent on in one batch.
BATCH_CELLS = 1 << 16
TILE_SIZES = (16, 32, 64, 128, 256, 512, 1024, 2048)


def raster_files(spark: SparkSession, path: str, pattern: str = "*.tif", stream: bool = False) -> DataFrame:
    """path, length, modificationTime of the files below ``path``; contents are not read."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile")
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in ddl.split(", ")])


def describe(files: DataFrame, square: bool = True, overviews: bool = True, planes: bool = True) -> DataFrame:
    """A row a file: its sizes and what is wrong with it.  A file is ``ok`` without issues.

    What cannot be read at all is an issue always; so are blocks outside the file and coding that ``read_blocks`` does not know.
    Tiles that are not square, missing overviews and bands that lie together are issues of a file that is to be read by window over a network.
    """
    schema = _arrow(DESCRIBED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    with Ranges(path) as read:
                        levels, first = directories(read, read.size)
                        size, used = read.size, read.bytes
                except (ValueError, OSError) as e:
                    rows.append(dict.fromkeys(schema.names) | {"path": path, "ok": False, "issues": [str(e)[:200]]})
                    continue
                top = levels[0]
                issues = [f"level {k} has a block outside the file" for k, v in enumerate(levels) if any(o + n > size for o, n in zip(v.offsets, v.counts, strict=True))]
                issues += [f"compression {v}" for v in sorted({v.compression for v in levels} - {NONE, DEFLATE, OLD_DEFLATE})]
                issues += [f"predictor {v}" for v in sorted({v.predictor for v in levels} - {1, 2})]
                if square:
                    issues += ["not tiled"] if not top.tiled else [] if top.block_width == top.block_height else [f"tiles of {top.block_width} x {top.block_height}"]
                if overviews and not any(v.reduced for v in levels[1:]) and max(top.width, top.height) > max(top.block_width, top.block_height):
                    issues.append("no overviews")
                if planes and top.bands > 1 and not top.planes:
                    issues.append("bands are interleaved by pixel")
                if overviews and any(0 < o < first for v in levels for o in v.offsets):
                    issues.append("data before the first directory")
                rows.append({
                    "path": path, "ok": not issues, "issues": issues, "width": top.width, "height": top.height, "bands": top.bands, "dtype": top.dtype[1:], "block_width": top.block_width, "block_height": top.block_height,
                    "tiled": top.tiled, "planes": top.planes, "levels": len(levels), "epsg": top.epsg, "west": top.tiepoint[3] if top.tiepoint else None, "north": top.tiepoint[4] if top.tiepoint else None,
                    "x_step": top.scale[0] if top.scale else None, "y_step": top.scale[1] if top.scale else None, "bytes_read": used,
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").mapInArrow(run, DESCRIBED)


def raster_blocks(files: DataFrame) -> DataFrame:
    """A row for each block of each level and band of each file; files that cannot be read raise (``describe`` tells them apart).

    Rows and columns are the level's own, ends exclusive and cut at its edge.  ``bytes_read`` is what the file's directories took.
    """
    schema = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Ranges(path) as read:
                    levels, _ = directories(read, read.size)
                    used = read.bytes
                for k, v in enumerate(levels):
                    n = v.across * v.down
                    for band in range(v.bands):
                        plane = slice(band * n, band * n + n) if v.planes else slice(0, n)
                        r, c = np.divmod(np.arange(n), v.across)
                        columns = [
                            [path] * n, np.full(n, k, np.int32), np.full(n, band, np.int32), r.astype(np.int32), c.astype(np.int32), r * v.block_height, c * v.block_width,
                            np.minimum((r + 1) * v.block_height, v.height), np.minimum((c + 1) * v.block_width, v.width), np.array(v.offsets[plane], np.int64), np.array(v.counts[plane], np.int64), [v.dtype] * n,
                            np.full(n, 1 if v.planes else v.bands, np.int32), np.full(n, v.block_width, np.int32), np.full(n, v.compression, np.int32), np.full(n, v.predictor, np.int32), [v.nodata] * n, np.full(n, used),
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("path").mapInArrow(run, BLOCKS)


def in_window(blocks: DataFrame, row_start: int, row_end: int, col_start: int, col_end: int) -> DataFrame:
    """Blocks that meet a window (ends exclusive)."""
    return blocks.filter((F.col("row_start") < row_end) & (F.col("row_end") > row_start) & (F.col("col_start") < col_end) & (F.col("col_end") > col_start))


def read_blocks(blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """path, level, band, row_start, col_start, row_end, col_end, data (little-endian float64 by row, NaN for no data), bytes_read (of the block).

    ``parts`` tasks share the blocks of a batch; by default as many as shuffles have.
    """
    keep = ["path", "level", "band", "row_start", "col_start", "row_end", "col_end"]
    ddl = "path string, level int, band int, row_start long, col_start long, row_end long, col_end long, data binary, bytes_read long"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = None, None
        made, n = [], 0

        def batch_of(made: list) -> pa.RecordBatch:
            columns = [[b[k] for b, _ in made] for k in keep] + [[data for _, data in made], [b["count"] for b, _ in made]]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for b in batch.to_pylist():
                if held != b["path"]:
                    if read is not None:
                        read.__exit__()
                    held, read = b["path"], Ranges(b["path"])
                shape = (b["row_end"] - b["row_start"], b["col_end"] - b["col_start"])
                if b["count"] == 0:
                    cells = np.full(shape, np.nan)
                else:
                    block = decode(read(b["offset"], b["count"]), b["dtype"], (shape[0], b["block_width"], b["samples"]), b["compression"], b["predictor"])
                    cells = block[:, : shape[1], b["band"] if b["samples"] > 1 else 0].astype("<f8")
                    if b["nodata"] is not None:
                        cells[cells == b["nodata"]] = np.nan
                made.append((b, cells.tobytes()))
                n += cells.size
                if n >= BATCH_CELLS:
                    yield batch_of(made)
                    made, n = [], 0
        if made:
            yield batch_of(made)
        if read is not None:
            read.__exit__()

    spread = blocks if blocks.isStreaming else blocks.repartition(parts or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "level", "block_row", "block_col").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(run, ddl)


def pixels(tiles: DataFrame) -> DataFrame:
    """path, level, band, row, col, value of the cells that have data."""
    ddl = "path string, level int, band int, row long, col long, value double"
    schema = _arrow(ddl)

    def batch_of(held: list) -> pa.RecordBatch:
        n = [len(r) for _, r, _, _ in held]
        paths = pa.array([t["path"] for t, *_ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), n)))
        level, band = (np.repeat(np.array([t[k] for t, *_ in held], np.int32), n) for k in ("level", "band"))
        rest = [np.concatenate([x[k] for x in held]) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([paths, *(pa.array(x, f.type) for x, f in zip((level, band, *rest), list(schema)[1:], strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # tiles are sent on together, not a batch a tile
        for batch in batches:
            for t in batch.to_pylist():
                block = np.frombuffer(t["data"], "<f8").reshape(t["row_end"] - t["row_start"], t["col_end"] - t["col_start"])
                r, c = np.nonzero(~np.isnan(block))
                held.append((t, r + t["row_start"], c + t["col_start"], block[r, c]))
                n += block.size
                if n >= BATCH_CELLS:
                    yield batch_of(held)
                    held, n = [], 0
        if held:
            yield batch_of(held)

    return tiles.mapInArrow(run, ddl)


TILES = "scene string, level int, band int, block_row long, block_col long, data binary"


def _side(size: int) -> int:
    """Tiles along a side of the squares that are packed together: of 256 cells a side, or of one tile where that is larger."""
    return max(1, 256 // size)


def _tiles(scene: str, level: int, band: int, block_row: np.ndarray, block_col: np.ndarray, data: np.ndarray) -> pa.Table:
    n = len(data)
    columns = [[scene] * n, np.full(n, level, np.int32), pa.array([band] * n, pa.int32()), block_row, block_col, [x.tobytes() for x in data]]
    schema = _arrow(TILES)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def pack(cells: DataFrame, size: int) -> DataFrame:
    """Tiles of level 0 (float32 by row, NaN for missing cells) from scene, band, row, col, value.  Small tiles that lie together are made together."""
    side = _side(size)
    t = cells.select("scene", "band", "row", "col", F.col("value").cast("float").alias("value"), F.floor(F.col("row") / (size * side)).alias("r"), F.floor(F.col("col") / (size * side)).alias("c"))

    def run(key, t):
        scene, band, r, c = (k.as_py() for k in key)
        row, col = t.column("row").to_numpy(), t.column("col").to_numpy()
        held, at = np.unique((row // size - r * side) * side + (col // size - c * side), return_inverse=True)
        block = np.full((len(held), size, size), np.nan, "<f4")
        block[at, row % size, col % size] = t.column("value").to_numpy()
        return _tiles(scene, 0, band, r * side + held // side, c * side + held % side, block)

    return t.groupBy("scene", "band", "r", "c").applyInArrow(run, TILES)


def halve(tiles: DataFrame, size: int) -> DataFrame:
    """The next level: each cell is the mean of its two by two cells that have data."""
    side = _side(size)
    t = tiles.select("scene", "level", "band", F.floor(F.col("block_row") / (2 * side)).alias("r"), F.floor(F.col("block_col") / (2 * side)).alias("c"), "block_row", "block_col", "data")

    def run(key, t):
        scene, level, band, r, c = (k.as_py() for k in key)
        row, col = t.column("block_row").to_numpy(), t.column("block_col").to_numpy()
        held, at = np.unique((row // 2 - r * side) * side + (col // 2 - c * side), return_inverse=True)
        block = np.full((len(held), 2, size, 2, size), np.nan)
        block[at, row % 2, :, col % 2, :] = np.frombuffer(b"".join(t.column("data").to_pylist()), "<f4").reshape(-1, size, size)
        four = block.reshape(-1, size, 2, size, 2).transpose(0, 1, 3, 2, 4).reshape(-1, size, size, 4)
        n = (~np.isnan(four)).sum(axis=3)
        mean = np.where(n > 0, np.nansum(four, axis=3) / np.maximum(n, 1), np.nan).astype("<f4")
        return _tiles(scene, level + 1, band, r * side + held // side, c * side + held % side, mean)

    return t.groupBy("scene", "level", "band", "r", "c").applyInArrow(run, TILES)


ROWS = "scene string, place long, data binary, plan string"


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: list[str]


class TiledTiffSink(DataSource):
    """``df.write.format("tiled_tiff")`` with options path, size, nodata, scale, tiepoint, epsg.

    Rows (``ROWS``) of a scene are together and in ``place`` order; the first has the ``plan``: width, height, bands and tile sizes of each level.
    """

    @classmethod
    def name(cls) -> str:
        return "tiled_tiff"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TiledTiffWriter(dict(self.options), overwrite)


class _TiledTiffWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.staging = f"{options['path'].rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import json

        o = self.options
        numbers = lambda name: [float(x) for x in o[name].split(",")] if o.get(name) else []
        system, staging = open_fs(self.staging)
        folder = f"{staging}/{uuid.uuid4().hex}"  # an attempt's own
        system.create_dir(folder, recursive=True)
        files, sink, scene = [], None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["plan"] is not None:
                        if sink is not None:
                            sink.close()
                        scene = row["scene"]
                        files.append(f"{scene}.tif")
                        sink = system.open_output_stream(f"{folder}/{scene}.tif")
                        head, _ = layout([Plan(**p) for p in json.loads(row["plan"])], int(o["size"]), float(o["nodata"]) if o.get("nodata") else None, numbers("scale"), numbers("tiepoint"), int(o["epsg"]) if o.get("epsg") else None)
                        sink.write(head)
                    elif row["scene"] != scene:
                        raise ValueError(f"a tile of {row['scene']} without its plan")
                    else:
                        sink.write(row["data"])
        finally:
            if sink is not None:
                sink.close()
        return _Staged(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staging = open_fs(self.staging)
        root = staging.rsplit("/", 1)[0]
        moves = [(f"{m.folder}/{f}", f"{root}/{f}") for m in messages if m is not None for f in m.files]
        there = [to for _, to in moves if system.get_file_info(to).type != fs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} and {len(there) - 1} more exist")
        for a, b in moves:
            system.move(a, b)
        system.delete_dir(staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staging = open_fs(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


def write_tiled(cells: DataFrame, path: str, size: int = 512, overwrite: bool = False, **options: str) -> None:
    """Write scene, band (from 0), row, col, value as ``path``/<scene>.tif with overviews down to one tile.

    A cell that is missing, null or NaN has no data; cells that repeat a place keep one of their values.  ``options`` are the sink's (nodata is NaN unless set there).
    """
    if size not in TILE_SIZES:
        raise ValueError(f"tiles of {size}: one of {TILE_SIZES} is needed")
    spark = cells.sparkSession
    keep = Kept(spark, "tiled")
    cells = cells.filter("scene IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL AND row >= 0 AND col >= 0").select("scene", F.col("band").cast("int"), F.col("row").cast("long"), F.col("col").cast("long"), "value")
    extent = keep(cells.groupBy("scene").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"), (F.max("band") + 1).alias("bands")))
    longest = extent.agg(F.max(F.greatest("width", "height"))).first()[0] or 0
    nodata = options.get("nodata")
    level = pack(cells, size)
    every = []
    for k in range(64):
        tiles = keep(level)
        every.append(tiles)
        if longest <= size << k:
            break
        level = halve(tiles, size)
    all_tiles = every[0]
    for more in every[1:]:
        all_tiles = all_tiles.unionByName(more)
    # a scene has its own number of levels
    sized = extent.withColumn("levels", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("width", "height") / size))).cast("int"))
    all_tiles = all_tiles.join(sized, "scene").filter("level <= levels")

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("data").to_pylist():
                block = np.frombuffer(raw, "<f4")
                out.append(zlib.compress((block if nodata is None else np.where(np.isnan(block), np.float32(float(nodata)), block)).tobytes(), 6))
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    columns = all_tiles.select("scene", "level", "band", "block_row", "block_col", "data", "width", "height", "bands", "levels")
    packed = keep(columns.mapInArrow(deflate, columns.schema))
    half = F.expr("shiftleft(1L, level)")
    w, h = F.ceil(F.col("width") / half), F.ceil(F.col("height") / half)
    across, down = F.ceil(w / size), F.ceil(h / size)
    at = (F.col("band") * down + F.col("block_row")) * across + F.col("block_col")
    placed = packed.withColumn("at", at).withColumn("place", ((F.col("levels") - F.col("level")).cast("long") * F.lit(1 << 48)) + F.col("at"))
    # sizes of all tiles of a scene, in the file's order, met by a join of places; tiles without cells have none
    shape = sized.select("scene", "width", "height", "bands", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"))
    shape = shape.select("scene", "level", w.alias("w"), h.alias("h"), "bands", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") * across * down - 1)).alias("at"))
    dense = shape.join(placed.select("scene", "level", "at", F.octet_length("data").alias("n")), ["scene", "level", "at"], "left")
    sizes = dense.groupBy("scene", "level").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.first("bands").alias("bands"), F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("held"))
    plan = sizes.select("scene", "level", F.struct(F.col("w").alias("width"), F.col("h").alias("height"), F.col("bands"), F.transform("held", lambda x: x["n"]).alias("counts")).alias("plan"))
    lead = plan.groupBy("scene").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("level", "plan"))), lambda x: x["plan"])).alias("plan"))
    rows = lead.select("scene", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("data"), "plan").unionByName(placed.select("scene", "place", "data", F.lit(None).cast("string").alias("plan")))
    spark.dataSource.register(TiledTiffSink)
    writer = rows.repartition("scene").sortWithinPartitions("scene", "place").write.format("tiled_tiff").mode("overwrite" if overwrite else "append")
    writer.options(path=path, size=str(size), **({"nodata": "nan"} | options)).save()
    keep.drop()


def ingest(files: DataFrame, out: str, process: Callable[[DataFrame], DataFrame] | None = None, checkpoint: str | None = None, parts: int | None = None, **checks: bool):
    """Validate each file and write the tiles of level 0 of those that pass, after ``process``, to ``out``/tiles, and what was found to ``out``/files.

    For a listing that streams, each micro-batch of new files replaces its own folders, so a batch that is run again after a failure leaves no second copy; the started
    query is returned.  A batch listing is one such batch.
    """

    def one(listed: DataFrame, k: int) -> None:
        describe(listed, **checks).write.mode("overwrite").parquet(f"{out}/files/part={k}")
        found = listed.sparkSession.read.parquet(f"{out}/files/part={k}")
        tiles = read_blocks(raster_blocks(found.filter("ok").select("path")).filter("level = 0"), parts)
        (process(tiles) if process else tiles).write.mode("overwrite").parquet(f"{out}/tiles/part={k}")

    if not files.isStreaming:
        return one(files, 0)
    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint or f"{out}/_checkpoint").trigger(availableNow=True).start()
