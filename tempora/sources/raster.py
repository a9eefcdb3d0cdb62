"""Elevation rasters: little-endian 16-bit cells in row-major files, all of one shape."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIX = ".i16"
NODATA = -32768  # cells that nobody has measured
SCHEMA = "file string, i long, j long, v short"
SPLIT_BYTES, BATCH_CELLS = 32 << 20, 1 << 16


@dataclass
class Stripe(InputPartition):
    """Rows ``first`` up to ``stop`` of one file."""

    file: str
    first: int
    stop: int


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.columns = options["path"], int(options["columns"])
        self.rows = int(options["rows"]) if options.get("rows") else None
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Stripe]:
        """Byte ranges of whole rows; every file's size is compared with the shape here, before any cell is read."""
        where, root = fs.FileSystem.from_uri(self.path)
        info = where.get_file_info(root)
        found = [info] if info.is_file else where.get_file_info(fs.FileSelector(root, recursive=True))
        row, out = 2 * self.columns, []
        for f in sorted((f for f in found if f.is_file and f.path.endswith(SUFFIX)), key=lambda f: f.path):
            if f.size % row or (self.rows is not None and f.size != row * self.rows):
                raise ValueError(f"{f.path}: {f.size} bytes are not {'whole' if self.rows is None else self.rows} rows of {self.columns} cells")
            step = max(1, self.split // row)
            out += [Stripe(f.path, at, min(at + step, f.size // row)) for at in range(0, f.size // row, step)]
        return out or [Stripe("", 0, 0)]

    def read(self, partition: Stripe) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.stop:
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        step = max(1, BATCH_CELLS // self.columns)
        with where.open_input_file(partition.file) as f:
            for at in range(partition.first, partition.stop, step):
                stop = min(at + step, partition.stop)
                v = np.frombuffer(f.read_at((stop - at) * 2 * self.columns, at * 2 * self.columns), "<i2")
                n = np.arange(at * self.columns, stop * self.columns, dtype=np.int64)
                name = pa.array([partition.file.rpartition("/")[2]] * len(v), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(n // self.columns), pa.array(n % self.columns), pa.array(v.astype(np.int16))], names=["file", "i", "j", "v"])


class GridSource(DataSource):
    """``spark.read.format("grid16")``: options ``path``, ``columns``, and ``rows`` where all files have the same number."""

    @classmethod
    def name(cls) -> str:
        return "grid16"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))


def read_grid(spark: SparkSession, path: str, columns: int, rows: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, i, j, v of every cell of the ``.i16`` files under ``path`` (a URI or an absolute path).

    A file that isn't whole rows of ``columns`` cells, or not ``rows`` of them, stops the read before it begins. A task reads a range of
    a file's rows of about ``split_bytes``, a few rows at a time, so no file is ever one row or in memory as a whole.
    """
    spark.dataSource.register(GridSource)
    reader = spark.read.format("grid16").option("columns", columns).option("splitbytes", split_bytes)
    return (reader if rows is None else reader.option("rows", rows)).load(path)


def write_grid(grid: DataFrame, path: str, columns: int, rows: int) -> int:
    """Write (i, j, v) as files of ``rows`` x ``columns`` cells named by their number, and return how many; cells not given are NODATA.

    A file is one task's and is moved into place when it is whole, so a task that runs twice leaves the same file.
    """
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root)

    def put(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((rows, columns), NODATA, "<i2")
        out[pdf["i"].to_numpy() - key[0] * rows, pdf["j"].to_numpy()] = pdf["v"].to_numpy()
        to, folder = fs.FileSystem.from_uri(path)
        part = f"{folder}/.{key[0]}-{uuid.uuid4().hex}"
        with to.open_output_stream(part) as f:
            f.write(out.tobytes())
        to.move(part, f"{folder}/{key[0]:08d}{SUFFIX}")
        return pd.DataFrame({"n": [1]})

    lawful = F.col("i").isNotNull() & F.col("j").between(0, columns - 1) & F.col("v").between(NODATA + 1, 32767)
    cells = grid.select(F.when(lawful, F.col("i").cast("long")).otherwise(F.raise_error(F.lit("a cell lies outside the grid or its value outside 16 bits"))).alias("i"), "j", "v")
    return cells.groupBy(F.floor(F.col("i") / rows).alias("file")).applyInPandas(put, "n long").count()
