"""Rasters as raw numbers, line by line: the interleaved files beside a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import raw


def read_interleaved(spark: SparkSession, path: str, bands: int, cols: int, dtype: str = "<f4", interleave: str = "line", window: tuple[int, int, int, int] | None = None, nodata: float | None = None) -> DataFrame:
    """row, col, b1, b2, ... of a raster of ``bands`` and ``cols`` in NumPy's ``dtype``, interleaved by "line", "pixel" or "band".

    The file's size tells its rows. ``window`` (first row, first column, rows, columns)
    keeps a part, and only its bytes are read. ``nodata`` and what isn't a number are null.
    """
    import numpy as np

    system, inner = raw.open_file(path)
    rows = system.get_file_info(inner).size // (bands * cols * np.dtype(dtype).itemsize)
    shown = None if window is None else ",".join(map(str, window))
    return raw.read_raw(spark, path, rows=rows, cols=cols, bands=bands, dtype=dtype, interleave=interleave, window=shown, nodata=nodata)
