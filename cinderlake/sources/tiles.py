"""Tile tables: grids, payloads and a data source of windows.

A tile row is (tile_id, col, row, col_start, row_start, col_end, row_end, data); data is little-endian float32, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TILE_SCHEMA = "tile_id string, col int, row int, col_start int, row_start int, col_end int, row_end int, data binary"


def tile_grid(spark: SparkSession, width: int, height: int, size: int, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` with ``overlap`` on every inner side: the step is size - 2 * overlap, the last ones are cut at the edge."""
    step = size - 2 * overlap
    across, down = -(-width // step), -(-height // step)
    t = spark.range(across * down).select((F.col("id") % across).cast("int").alias("col"), F.floor(F.col("id") / across).cast("int").alias("row"))
    edge = lambda c, off, top: F.least(F.greatest(F.col(c) * step + off, F.lit(0)), F.lit(top)).cast("int")
    return t.select(
        F.format_string("r%d_c%d", "row", "col").alias("tile_id"), "col", "row", edge("col", -overlap, width).alias("col_start"), edge("row", -overlap, height).alias("row_start"),
        edge("col", step + overlap, width).alias("col_end"), edge("row", step + overlap, height).alias("row_end"),
    )


def pack_tiles(grid: DataFrame, size: int, value: str = "value") -> DataFrame:
    """A pixel table (row, col, value) as tiles of ``size``; missing cells are NaN."""
    keyed = grid.select("row", "col", F.col(value).cast("float").alias("v"), F.floor(F.col("row") / size).cast("int").alias("tr"), F.floor(F.col("col") / size).cast("int").alias("tc"))

    def run(key, t):
        tr, tc = key[0].as_py(), key[1].as_py()
        block = np.full((size, size), np.nan, "<f4")
        block[t.column("row").to_numpy() - tr * size, t.column("col").to_numpy() - tc * size] = t.column("v").to_numpy()
        return pa.table(
            {"tile_id": [f"r{tr}_c{tc}"], "col": [tc], "row": [tr], "col_start": [tc * size], "row_start": [tr * size], "col_end": [(tc + 1) * size], "row_end": [(tr + 1) * size], "data": [block.tobytes()]},
            pa.schema([("tile_id", pa.string()), *((n, pa.int32()) for n in ("col", "row", "col_start", "row_start", "col_end", "row_end")), ("data", pa.binary())]),
        )

    return keyed.groupBy("tr", "tc").applyInArrow(run, TILE_SCHEMA)


def unpack_tiles(tiles: DataFrame) -> DataFrame:
    """Tiles as pixels (row, col, value) without missing cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = np.frombuffer(r["data"], "<f4").reshape(r["row_end"] - r["row_start"], r["col_end"] - r["col_start"])
                y, x = np.nonzero(~np.isnan(block))
                yield pa.RecordBatch.from_arrays([pa.array(y + r["row_start"]), pa.array(x + r["col_start"]), pa.array(block[y, x].astype(float))], ["row", "col", "value"])

    return tiles.mapInArrow(run, "row long, col long, value double")


def blend_weight(pos: Column, size: int, overlap: int) -> Column:
    """Feather weight along one axis: (1 - cos(pi m)) / 2 with m rising over the overlap from either side."""
    m = F.least(F.least((pos + 1) / (overlap + 1), (F.lit(size) - pos) / (overlap + 1)), F.lit(1.0))
    return (1 - F.cos(F.pi() * m)) / 2


class _Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class TileWindowSource(DataSource):
    """``spark.read.format("tile_windows")`` with options width, height, size, overlap: one partition a block of window rows."""

    @classmethod
    def name(cls) -> str:
        return "tile_windows"

    def schema(self) -> str:
        return "col int, row int, col_start int, row_start int, col_end int, row_end int"

    def reader(self, schema) -> DataSourceReader:
        return _TileWindowReader({k: int(self.options[k]) for k in ("width", "height", "size")} | {"overlap": int(self.options.get("overlap", 0))})


class _TileWindowReader(DataSourceReader):
    def __init__(self, o: dict[str, int]):
        self.o = o

    def partitions(self) -> list[InputPartition]:
        step = self.o["size"] - 2 * self.o["overlap"]
        down = -(-self.o["height"] // step)
        return [_Rows(a, min(a + 64, down)) for a in range(0, down, 64)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        o = self.o
        step = o["size"] - 2 * o["overlap"]
        for r in range(part.begin, part.end):
            for c in range(-(-o["width"] // step)):
                yield (c, r, max(c * step - o["overlap"], 0), max(r * step - o["overlap"], 0), min((c + 1) * step + o["overlap"], o["width"]), min((r + 1) * step + o["overlap"], o["height"]))
