"""Rasters as a data source: byte ranges, shapes, missing cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.sources import raster


def test_byte_ranges_of_large_files(spark, tmp_path):
    """Two files, cut into ranges of seven rows, give every cell once; other files in the folder are passed over."""
    files = {f"{k}.i16": np.random.default_rng(k).integers(-32768, 32768, (101, 37)).astype("<i2") for k in range(2)}
    for name, cells in files.items():
        (tmp_path / name).write_bytes(cells.tobytes())
    (tmp_path / "notes.txt").write_text("odd")
    df = raster.read_grid(spark, str(tmp_path), 37, 101, split_bytes=7 * 74)
    assert df.rdd.getNumPartitions() == 2 * 15
    got = df.toPandas().sort_values(["file", "i", "j"])
    assert len(got) == 2 * 101 * 37
    for name, cells in files.items():
        assert (got[got["file"] == name]["v"].to_numpy().reshape(101, 37) == cells).all()
    assert raster.read_grid(spark, "file://" + str(tmp_path / "1.i16"), 37).count() == 101 * 37


@pytest.mark.parametrize("rows", [None, 5])
def test_wrong_size_stops_the_read(spark, tmp_path, rows):
    (tmp_path / "a.i16").write_bytes(b"\0" * (5 * 8))
    (tmp_path / "b.i16").write_bytes(b"\0" * (4 * 8 if rows else 5 * 8 - 2))
    with pytest.raises(Exception, match="rows of 4 cells"):
        raster.read_grid(spark, str(tmp_path), 4, rows).collect()


def test_written_cells_come_back(spark, tmp_path):
    """Cells that weren't given are NODATA, extremes survive, an empty grid leaves an empty folder, a cell outside stops the write."""
    rows = [(0, 1, 5), (2, 0, -7), (3, 2, 32767), (7, 1, -32767)]
    grid = spark.createDataFrame(rows, "i long, j long, v long")
    path = str(tmp_path / "g")
    assert raster.write_grid(grid, path, 3, 2) == 3
    got = raster.read_grid(spark, path, 3, 2)
    assert got.count() == 3 * 6
    back = got.filter(F.col("v") != raster.NODATA).select(F.substring("file", 1, 8).cast("long") * 2 + F.col("i"), "j", "v")
    assert sorted(map(tuple, back.collect())) == rows
    assert raster.write_grid(grid.limit(0), str(tmp_path / "none"), 3, 2) == 0
    assert raster.read_grid(spark, str(tmp_path / "none"), 3).count() == 0
    for bad in ((0, 3, 1), (0, 0, 40000), (None, 0, 1)):
        with pytest.raises(Exception, match="outside"):
            raster.write_grid(spark.createDataFrame([bad], "i long, j long, v long"), str(tmp_path / "bad"), 3, 2)
