"""Rasters in tiles: one row holds a square of values, read from .npy files a band of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seatrace.shipping import ship_package

from .archives import file_system

SIDE = 128
TILE = "tile_row int, tile_col int, width int, values array<double>"


@dataclass
class Band(InputPartition):
    path: str
    tile_row: int


def npy_header(f) -> tuple[tuple[int, int], bool, np.dtype, int]:
    """Shape, whether columns lie together, type, and where the values begin."""
    version = np.lib.format.read_magic(f)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) != 2 or dtype.hasobject:
        raise ValueError(f"a raster is a two-dimensional array of numbers, not {dtype} {shape}")
    return shape, by_column, dtype, f.tell()


class TileReader(DataSourceReader):
    def __init__(self, path: str, side: int):
        self.path, self.side = path, side

    def _files(self) -> list[str]:
        fs, where = file_system(self.path)
        if fs.get_file_info(where).type == pa.fs.FileType.File:
            return [self.path]
        prefix = self.path[: len(self.path) - len(where)] if self.path.endswith(where) else ""
        return sorted(prefix + f.path for f in fs.get_file_info(pa.fs.FileSelector(where)) if f.path.endswith(".npy"))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path in self._files():
            fs, where = file_system(path)
            with fs.open_input_file(where) as f:
                (rows, _), _, _, _ = npy_header(f)
            out += [Band(path, k) for k in range(-(-rows // self.side))]
        return out or [Band("", 0)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, where = file_system(partition.path)
        first = partition.tile_row * self.side
        with fs.open_input_file(where) as f:
            (rows, cols), by_column, dtype, begin = npy_header(f)
            n = min(self.side, rows - first)
            if by_column:  # a stretch of each column
                parts = [np.frombuffer(f.read_at(n * dtype.itemsize, begin + (c * rows + first) * dtype.itemsize), dtype) for c in range(cols)]
                band = np.stack(parts, axis=1) if parts else np.zeros((n, 0))
            else:
                band = np.frombuffer(f.read_at(n * cols * dtype.itemsize, begin + first * cols * dtype.itemsize), dtype).reshape(n, cols)
        for k in range(-(-cols // self.side)):
            tile = band[:, k * self.side : (k + 1) * self.side].astype(np.float64)
            values = pa.array([tile.reshape(-1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.tile_row], pa.int32()), pa.array([k], pa.int32()), pa.array([tile.shape[1]], pa.int32()), values], ["path", "tile_row", "tile_col", "width", "values"])


class NpyTiles(DataSource):
    """spark.read.format("npy_tiles").option("side", 128).load(path): a partition for each band of rows of each file."""

    @classmethod
    def name(cls) -> str:
        return "npy_tiles"

    def schema(self) -> str:
        return "path string, " + TILE

    def reader(self, schema: T.StructType) -> TileReader:
        return TileReader(self.options["path"], int(self.options.get("side", str(SIDE))))


def read_tiles(spark: SparkSession, path: str, *, side: int = SIDE) -> DataFrame:
    """(path, tile_row, tile_col, width, values) of .npy rasters; values go row by row, tiles at the far edges are smaller."""
    ship_package(spark)
    spark.dataSource.register(NpyTiles)
    return spark.read.format("npy_tiles").option("side", side).load(path)


def tiled(pixels: DataFrame, *, side: int = SIDE) -> DataFrame:
    """Tiles of a table (row, col, value); cells without a row are NaN. A tile is at most side * side rows."""
    import pandas as pd

    ship_package(pixels.sparkSession)

    def gather(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.full((side, side), np.nan)
        values[pdf["row"].to_numpy() % side, pdf["col"].to_numpy() % side] = pdf["value"].to_numpy(float)
        return pd.DataFrame({"tile_row": [key[0]], "tile_col": [key[1]], "width": [side], "values": [values.reshape(-1)]})

    tile = [F.floor(F.col(c) / side).cast("int").alias(f"tile_{c}") for c in ("row", "col")]
    return pixels.select(*tile, "row", "col", "value").groupBy("tile_row", "tile_col").applyInPandas(gather, TILE)
