"""Moving windows on blocks with borders: a block and its border are sent once, whatever the window's size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import to_blocks, to_cells, with_borders

#: Cells along a block.
SIZE = 256


def _blocked(cells: DataFrame, reach: int, size: int, step, value: str) -> DataFrame:
    """Cells of what ``step`` makes of each window (a block and ``reach`` cells around, NaN where there is nothing)."""
    size = max(size, reach)
    low = cells.agg(F.min("row"), F.min("col")).first()
    r0, c0 = low[0] or 0, low[1] or 0
    blocks = to_blocks(cells.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), F.col(value).alias("value")), size)
    made = with_borders(blocks, size, max(reach, 1), lambda br, bc, w: [(br, bc, step(w[0] if reach else w[0][1:-1, 1:-1]).tobytes())], "br int, bc int, data binary")
    return to_cells(made, size).select((F.col("row") + r0).alias("row"), (F.col("col") + c0).alias("col"), "value")


def _integral(z):
    import numpy as np

    return np.pad(np.cumsum(np.cumsum(z, axis=0), axis=1), ((1, 0), (1, 0)))


def window_mean(cells: DataFrame, radius: int, whole: bool = True, value: str = "value", size: int = SIZE) -> DataFrame:
    """Mean of the known cells of each (2r+1)^2 window, by four look-ups in a running sum; with ``whole`` only where all are known."""
    n = 2 * radius + 1

    def step(w):
        import numpy as np

        known = ~np.isnan(w)
        level = np.nanmean(w) if known.any() else 0.0  # sums of small numbers
        four = lambda s: s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]
        count, total = four(_integral(known.astype("int64"))), four(_integral(np.where(known, w - level, 0.0)))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((count == n * n) if whole else (count > 0), level + total / count, np.nan)

    return _blocked(cells, radius, size, step, value)


def window_median(cells: DataFrame, steps: Sequence[tuple[int, int]], value: str = "value", size: int = SIZE) -> DataFrame:
    """Median of the known cells at the steps (row, column) from each cell that exists or has known ones around; a band of rows at a time."""
    reach = max(max(abs(i), abs(j)) for i, j in steps)

    def step(w):
        import warnings

        import numpy as np

        high, wide = w.shape[0] - 2 * reach, w.shape[1] - 2 * reach
        out = np.full((high, wide), np.nan)
        rows = max(1, (1 << 22) // (wide * len(steps)))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # windows without known cells
            for at in range(0, high, rows):
                n = min(rows, high - at)
                out[at : at + n] = np.nanmedian(np.stack([w[reach + i + at : reach + i + at + n, reach + j : reach + j + wide] for i, j in steps]), axis=0)
        return out

    return _blocked(cells, reach, size, step, value)


def fractal_dimension(cells: DataFrame, window: int = 21, value: str = "value", size: int = SIZE) -> DataFrame:
    """Box-counting dimension of the cells above zero in each odd window inside the raster: log2 of the boxes of one cell over those of two.

    Boxes begin at the window's first row and column; the last box of each takes in the
    rows and columns left over, the last cell of the window too, as published. Windows
    without such cells have none; cells that are missing or null count as zero.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be odd, and 3 at least")
    reach = window // 2
    edge = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()

    def step(w):
        import numpy as np

        on = np.nan_to_num(w) > 0
        high, wide = w.shape[0] - 2 * reach, w.shape[1] - 2 * reach

        def boxes(side):
            starts = list(range(0, window - side, side))  # the last one reaches to the window's end
            spans = [(s, s + side if s != starts[-1] else window) for s in starts]
            strips = []
            for a, b in spans:
                strips.append(np.logical_or.reduce([on[a + k : a + k + high] for k in range(b - a)]))
            total = np.zeros((high, wide), "int64")
            for strip in strips:
                for a, b in spans:
                    total += np.logical_or.reduce([strip[:, a + k : a + k + wide] for k in range(b - a)])
            return total

        one, two = boxes(1), boxes(2)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(one > 0, np.log2(one / two), np.nan)

    found = _blocked(cells, reach, size, step, value)
    if edge[0] is None:
        return found
    return found.where(F.col("row").between(edge[0] + reach, edge[1] - reach) & F.col("col").between(edge[2] + reach, edge[3] - reach))
