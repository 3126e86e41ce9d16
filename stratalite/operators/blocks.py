"""Rasters as square blocks: one row a block, its values as one binary array, with borders of its neighbours where a step needs them.

Cells are (row, col, value). A block is (br, bc, data): ``size`` x ``size`` doubles, row by
row, NaN where there is no cell. A step over neighbourhoods sends each block once, and
its borders to the blocks around it, in place of a row for each cell and neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import ship

BLOCK = "br int, bc int, data binary"


def to_blocks(cells: DataFrame, size: int) -> DataFrame:
    """Blocks of the cells, each with at least one; of cells that repeat a place one is taken; null values are NaN."""

    def make(key, pdf):
        import numpy as np
        import pandas as pd

        data = np.full((size, size), np.nan)
        data[pdf["row"].to_numpy() - key[0] * size, pdf["col"].to_numpy() - key[1] * size] = pdf["value"].to_numpy(dtype="float64", na_value=np.nan)
        return pd.DataFrame({"br": [key[0]], "bc": [key[1]], "data": [data.tobytes()]})

    placed = cells.select(F.floor(F.col("row") / size).cast("int").alias("br"), F.floor(F.col("col") / size).cast("int").alias("bc"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    return placed.groupBy("br", "bc").applyInPandas(make, BLOCK)


def to_cells(blocks: DataFrame, size: int) -> DataFrame:
    """Cells of blocks; places with NaN have none."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for br, bc, data in pdf[["br", "bc", "data"]].itertuples(index=False):
                block = np.frombuffer(data).reshape(size, size)
                r, c = np.nonzero(~np.isnan(block))
                yield pd.DataFrame({"row": (r + int(br) * size).astype("int32"), "col": (c + int(bc) * size).astype("int32"), "value": block[r, c]})

    return blocks.select("br", "bc", "data").mapInPandas(run, "row int, col int, value double")


def with_borders(blocks: DataFrame, size: int, width: int, step: Callable, schema: str, planes: int = 1) -> DataFrame:
    """``step(br, bc, window)`` of each block, whose window is the block with ``width`` cells of its neighbours around (NaN where there are none).

    A block may hold several planes of doubles behind each other; the window has them as
    its first axis. ``step`` yields tuples of ``schema``. A group is a block and at most
    eight borders.
    """
    if not 0 < width <= size:
        raise ValueError("a border is no wider than a block")
    ship(blocks.sparkSession)
    names = [f.split()[0] for f in schema.split(",")]

    def send(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for br, bc, data in pdf[["br", "bc", "data"]].itertuples(index=False):
                block = np.frombuffer(data).reshape(planes, size, size)
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        part = block[:, _sent(dr, size, width), _sent(dc, size, width)]
                        if (dr, dc) == (0, 0) or not np.isnan(part).all():
                            out.append((br + dr, bc + dc, -dr, -dc, part.tobytes()))
            yield pd.DataFrame(out, columns=["br", "bc", "dr", "dc", "data"])

    def meet(key, pdf):
        import numpy as np
        import pandas as pd

        window = np.full((planes, size + 2 * width, size + 2 * width), np.nan)
        own = False
        for dr, dc, data in pdf[["dr", "dc", "data"]].itertuples(index=False):
            own = own or (dr, dc) == (0, 0)
            place = window[:, _put(dr, size, width), _put(dc, size, width)]
            place[...] = np.frombuffer(data).reshape(place.shape)
        return pd.DataFrame(list(step(int(key[0]), int(key[1]), window)) if own else [], columns=names)

    pieces = blocks.select("br", "bc", "data").mapInPandas(send, "br int, bc int, dr int, dc int, data binary")
    return pieces.groupBy("br", "bc").applyInPandas(meet, schema)


def _sent(d: int, size: int, width: int) -> slice:
    """The part of a block that its neighbour at ``d`` gets."""
    return slice(None) if d == 0 else slice(size - width, size) if d > 0 else slice(0, width)


def _put(d: int, size: int, width: int) -> slice:
    """Where the part of the neighbour at ``d`` goes in a window."""
    return slice(width, width + size) if d == 0 else slice(width + size, None) if d > 0 else slice(0, width)
