"""Rasters and columns as raw numbers: a Spark data source over byte ranges.

``spark.read.format("raw_raster")`` plans ranges of rows. Filters on ``row`` and ``col``
and the option ``window`` prune them, the option ``wanted`` keeps bands, and only the
bytes of what is left are read, into Arrow columns. A folder may hold parts of a raster,
named ``rows-<first row>.raw``, which the writer makes. Files are read through
pyarrow's file systems, so a path may name a store.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from stratalite.session import ship

#: Bytes that a task reads, and numbers that are decoded at once.
TASK_BYTES, BATCH_CELLS = 32 << 20, 1 << 20


@dataclasses.dataclass
class Layout:
    """Where the numbers of a raster lie: shape, kind, order of bands, bytes in front, and value = raw / factor + base."""

    rows: int
    cols: int
    bands: int = 1
    dtype: str = "<f4"
    interleave: str = "line"  # line, pixel or band
    offset: int = 0
    nodata: float | None = None
    factor: float = 1.0
    base: float = 0.0
    upwards: bool = False  # the file's first row is the lowest
    record: int = 0  # payload bytes of a record that has a byte of its length before and after, 0 without records

    def segments(self, row: int, band: int, first: int, last: int) -> tuple[int, int]:
        """Payload offset and size of the columns from ``first`` to ``last`` of a file's row: of one band, or of all if they lie in pixels."""
        import numpy as np

        size = np.dtype(self.dtype).itemsize
        if self.interleave == "pixel":
            return self.offset + (row * self.cols + first) * self.bands * size, (last - first + 1) * self.bands * size
        line = row * self.bands + band if self.interleave == "line" else band * self.rows + row
        return self.offset + (line * self.cols + first) * size, (last - first + 1) * size


def open_file(path: str):
    """A file of any file system that pyarrow knows, for reading at offsets."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)
    return system, inner


def parts_of(path: str) -> list[tuple[str, int]]:
    """The files of a raster with their first rows: one file, or a folder's parts."""
    from pyarrow import fs

    system, inner = open_file(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [(path, 0)]
    names = sorted((int(m[1]), info.base_name) for info in system.get_file_info(fs.FileSelector(inner)) if (m := re.fullmatch(r"rows-(\d+)\.raw", info.base_name)))
    return [(f"{path.rstrip('/')}/{name}", first) for first, name in names]


def geosoft_layout(head: bytes) -> tuple[Layout, dict]:
    """Of a grid's 512 bytes of header: its layout, and its place (x, y of the lower left cell, cell sizes)."""
    import struct

    size, _, cols, rows, _ = struct.unpack_from("<5i", head)
    dx, dy, x0, y0, _, base, factor = struct.unpack_from("<7d", head, 20)
    if size not in (2, 4):
        raise ValueError("only grids of 2-byte integers or 4-byte reals that aren't compressed")
    kind, nodata = ("<i2", -32767.0) if size == 2 else ("<f4", -1e32)
    return Layout(rows, cols, dtype=kind, offset=512, nodata=nodata, factor=factor, base=base, upwards=True), {"x0": x0, "y0": y0, "dx": dx, "dy": dy}


def geopak_layout(head: bytes) -> tuple[Layout, dict]:
    """Of the first record of a blocked grid, 32 reals: its layout and place."""
    import struct

    h = struct.unpack_from("<32f", head)
    return Layout(int(h[0]), int(h[1]), dtype="<i2", offset=128, nodata=h[7], factor=h[2], base=h[3], upwards=True, record=128), {"x0": h[4], "y0": h[5], "dx": h[9], "dy": h[10]}


def _read_payload(file, layout: Layout, at: int, size: int) -> bytes:
    """``size`` bytes of payload from ``at``; records' length bytes are left out."""
    if not layout.record:
        return file.read_at(size, at)
    n = layout.record
    first, last = at // n, (at + size - 1) // n
    raw = file.read_at((last - first + 1) * (n + 2), 1 + first * (n + 2))  # one byte stands before all records
    body = b"".join(raw[k * (n + 2) + 1 : k * (n + 2) + 1 + n] for k in range(last - first + 1))
    return body[at - first * n : at - first * n + size]


def describe(path: str, options: dict) -> tuple[Layout, dict]:
    """The layout and place of a raster: from its header, or from the options."""
    kind = options.get("kind", "interleaved")
    if kind == "interleaved":
        place = {k: float(options.get(k, 1.0 if k in ("dx", "dy") else 0.0)) for k in ("x0", "y0", "dx", "dy")}
        numbers = {k: int(options[k]) for k in ("rows", "cols", "bands", "offset") if k in options}
        reals = {k: float(options[k]) for k in ("nodata", "factor", "base") if options.get(k) not in (None, "")}
        texts = {k: options[k] for k in ("dtype", "interleave") if k in options}
        return Layout(**numbers, **reals, **texts, upwards=options.get("upwards", "false") == "true"), place
    system, inner = open_file(path)
    with system.open_input_file(inner) as file:
        if kind == "geosoft":
            return geosoft_layout(file.read_at(512, 0))
        if kind == "geopak":
            return geopak_layout(_read_payload(file, Layout(1, 1, record=128), 0, 128))
    raise ValueError(kind)


@dataclasses.dataclass
class Range(InputPartition):
    """Rows of a file to read, counted in the file; ``start`` is the raster's row of the file's first."""

    path: str
    start: int
    first: int
    last: int

    def __init__(self, path: str, start: int, first: int, last: int):
        self.path, self.start, self.first, self.last = path, start, first, last


class RawReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.layout, self.place = path, *describe(path, options)
        self.window = {"row": [0, None], "col": [0, self.layout.cols - 1]}
        if options.get("window"):
            r, c, high, wide = map(int, options["window"].split(","))
            self.window = {"row": [r, r + high - 1], "col": [c, min(c + wide, self.layout.cols) - 1]}
        wanted = options.get("wanted")
        self.bands = [int(b) for b in wanted.split(",")] if wanted else list(range(1, self.layout.bands + 1))

    def _columns(self) -> tuple[int, int]:
        """The columns to read: all of a row if less than half of it would be left out."""
        first, last = self.window["col"]
        return (0, self.layout.cols - 1) if 2 * (last - first + 1) > self.layout.cols else (first, last)

    def bytes_of(self, part: Range) -> int:
        """The bytes that a range reads."""
        import numpy as np

        first, last = self._columns()
        bands = self.layout.bands if self.layout.interleave == "pixel" else len(self.bands)
        return (part.last - part.first + 1) * (last - first + 1) * bands * np.dtype(self.layout.dtype).itemsize

    def partitions(self):
        import numpy as np

        first, last = self._columns()
        if self.window["col"][0] > self.window["col"][1]:
            return []
        files, out = parts_of(self.path), []
        wide = (last - first + 1) * self.layout.bands * np.dtype(self.layout.dtype).itemsize
        step = max(1, TASK_BYTES // wide)
        for k, (path, start) in enumerate(files):
            rows = (files[k + 1][1] if k + 1 < len(files) else self.layout.rows) - start
            low, high = self.window["row"]
            a, b = max(low - start, 0), min(rows - 1, rows - 1 if high is None else high - start)
            if self.layout.upwards:
                a, b = rows - 1 - b, rows - 1 - a
            out += [Range(path, start, r, min(r + step - 1, b)) for r in range(a, b + 1, step)]
        return out

    def read(self, part: Range):
        import numpy as np
        import pyarrow as pa

        layout, (first, last) = self.layout, self._columns()
        keep = slice(self.window["col"][0] - first, self.window["col"][1] - first + 1)
        columns = np.arange(first, last + 1, dtype="int32")[keep]
        if part is None or not len(columns):  # no range at all comes as None
            return
        system, inner = open_file(part.path)
        per = max(1, BATCH_CELLS // ((last - first + 1) * max(1, len(self.bands))))
        whole = layout.interleave != "band" and (first, last) == (0, layout.cols - 1) and (layout.interleave == "pixel" or len(self.bands) == layout.bands)
        with system.open_input_file(inner) as file:
            for at in range(part.first, part.last + 1, per):
                rows = range(at, min(at + per, part.last + 1))
                bands = [v[:, keep] for v in self._values(file, layout, rows, first, last, whole)]
                number = np.array(rows, "int64")
                number = part.start + (layout.rows - 1 - number if layout.upwards else number)
                made = [pa.array(np.repeat(number, len(columns)).astype("int32")), pa.array(np.tile(columns, len(rows)))]
                for v in bands:
                    v = v.ravel()
                    bad = ~np.isfinite(v.astype("float64"))
                    if layout.nodata is not None:
                        bad |= v == np.asarray(layout.nodata).astype(v.dtype) if v.dtype.kind == "f" else v == layout.nodata
                    made.append(pa.array(v.astype("float64") / layout.factor + layout.base, mask=bad))
                yield pa.RecordBatch.from_arrays(made, ["row", "col", *[f"b{b}" for b in self.bands]])

    def _values(self, file, layout: Layout, rows: range, first: int, last: int, whole: bool) -> list:
        """Each wanted band's rows, of the columns from ``first`` to ``last``."""
        import numpy as np

        wide, kind = last - first + 1, np.dtype(layout.dtype)
        read = lambda at, size: np.frombuffer(_read_payload(file, layout, at, size), kind)
        if whole:  # neighbouring rows in one read
            start, _ = layout.segments(rows[0], 0, 0, layout.cols - 1)
            data = read(start, len(rows) * layout.bands * layout.cols * kind.itemsize)
            data = data.reshape(len(rows), layout.cols, layout.bands).transpose(2, 0, 1) if layout.interleave == "pixel" else data.reshape(len(rows), layout.bands, layout.cols).transpose(1, 0, 2)
            return [data[b - 1] for b in self.bands]
        if layout.interleave == "pixel":
            data = np.stack([read(*layout.segments(r, 0, first, last)).reshape(wide, layout.bands) for r in rows])
            return [data[:, :, b - 1] for b in self.bands]
        if layout.interleave == "band" and wide == layout.cols:
            return [read(layout.segments(rows[0], b - 1, 0, layout.cols - 1)[0], len(rows) * wide * kind.itemsize).reshape(len(rows), wide) for b in self.bands]
        return [np.stack([read(*layout.segments(r, b - 1, first, last)) for r in rows]) for b in self.bands]


class FilteringReader(RawReader):
    """The same with filters taken into the plan; sessions without that setting refuse such a reader."""

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            value = getattr(f, "value", None)
            if name in self.window and isinstance(value, int) and type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                limits = self.window[name]
                if type(f) is not LessThan and type(f) is not LessThanOrEqual:
                    limits[0] = max(limits[0], value + (type(f) is GreaterThan))
                if type(f) is not GreaterThan and type(f) is not GreaterThanOrEqual:
                    high = value - (type(f) is LessThan)
                    limits[1] = high if limits[1] is None else min(limits[1], high)
            else:
                yield f


class Wrote(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RawWriter(DataSourceArrowWriter):
    """Parts of a raster (first_row, data) as files; a failed job's parts are removed."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        system, inner = open_file(self.path)
        system.create_dir(inner, recursive=True)
        paths = []
        for batch in iterator:
            for row in batch.to_pylist():
                path = f"{inner.rstrip('/')}/rows-{row['first_row']}.raw"
                with system.open_output_stream(path) as out:
                    out.write(row["data"])
                paths.append(path)
        return Wrote(paths)

    def commit(self, messages):
        pass

    def abort(self, messages):
        system, _ = open_file(self.path)
        for m in messages:
            for path in m.paths if m else ():
                system.delete_file(path)


class RawRaster(DataSource):
    """Options: path, kind (interleaved, geosoft, geopak); for interleaved files rows, cols, bands, dtype, interleave, offset, nodata, factor, base; wanted (bands), window (first row, first column, rows, columns)."""

    @classmethod
    def name(cls) -> str:
        return "raw_raster"

    def schema(self) -> str:
        o = dict(self.options)
        if "first_row" in o.get("writes", ""):
            return "first_row long, data binary"
        bands = o["wanted"].split(",") if o.get("wanted") else range(1, int(o.get("bands", 1)) + 1)
        return "row int, col int, " + ", ".join(f"b{b} double" for b in bands)

    def reader(self, schema) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushes") == "true" else RawReader)(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool):
        return RawWriter(self.options["path"])


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RawRaster)


def read_raw(spark: SparkSession, path: str, **options) -> DataFrame:
    """row, col, b1, b2, ... of a raster; what is no number or the null value is null.

    Comparisons of ``row`` and ``col`` with numbers reach the plan of byte ranges where
    ``spark.sql.python.filterPushdown.enabled`` is set, as ``session.builder`` does;
    elsewhere Spark applies them to what is read, and ``window`` still prunes.
    """
    _ready(spark)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("raw_raster").option("pushes", pushes).options(**{k: v for k, v in options.items() if v is not None}).load(path)


def write_raw(cells: DataFrame, path: str, bands: list[str], dtype: str = "<f4", interleave: str = "line", nodata: float = -99999.0, rows_a_part: int = 1024) -> dict:
    """Cells (row, col from 0, bands) as a folder of raw parts; returns the options to read them with. Missing cells and nulls are ``nodata``."""
    import numpy as np

    if interleave not in ("line", "pixel"):
        raise ValueError("parts are written by line or by pixel")
    _ready(cells.sparkSession)
    high, wide = cells.agg(F.max("row"), F.max("col")).first()
    if high is None:
        raise ValueError("a raster without cells has no size")
    wide += 1

    def part(key, pdf):
        import pandas as pd

        first = int(key[0]) * rows_a_part
        out = np.full((min(rows_a_part, high + 1 - first), len(bands), wide), nodata, dtype)
        for k, b in enumerate(bands):
            out[pdf["row"].to_numpy() - first, k, pdf["col"].to_numpy()] = pdf[b].fillna(nodata).to_numpy()
        out = out if interleave == "line" else out.transpose(0, 2, 1)
        return pd.DataFrame({"first_row": [first], "data": [np.ascontiguousarray(out).tobytes()]})

    every = cells.sparkSession.range(high // rows_a_part + 1).select((F.col("id") * rows_a_part).cast("int").alias("row"), F.lit(0).alias("col"))  # parts without cells too
    full = every.join(cells.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands]), ["row", "col"], "full")
    parts = full.groupBy(F.floor(F.col("row") / rows_a_part).alias("part")).applyInPandas(part, "first_row long, data binary")
    parts.write.format("raw_raster").option("writes", "first_row").mode("append").save(path)
    return {"rows": high + 1, "cols": wide, "bands": len(bands), "dtype": dtype, "interleave": interleave, "nodata": nodata}


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, rows_a_task: int = 1 << 20) -> DataFrame:
    """A database of one binary file a column (``name.PD`` with 512 bytes in front, its type in ``name.vec``): row, line and the columns, by ranges of rows.

    ``columns`` names those to read, by default all. A column of several bands becomes
    ``name_1``, ``name_2``, ... The column ``index`` has the first row and the number of
    further rows of each line, ``line`` or ``linenumber`` its name. Null values are null.
    """
    import numpy as np
    import pandas as pd
    from pyarrow import fs

    kinds = {"IEEE4ByteReal": "<f4", "IEEE8ByteReal": "<f8", "Signed32BitInteger": "<i4", "Signed16BitInteger": "<i2"}  # the format's names
    system, inner = open_file(path)
    files = {f.base_name[:-3].lower(): f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".PD")}
    heads = {}
    for name, file in files.items():
        with system.open_input_stream(file[:-3] + ".vec") as f:
            pairs = dict(re.findall(r"(\w+)\s*=\s*(\S+)", f.read().decode("utf-8", "replace")))
        kind = np.dtype(kinds[pairs.get("CellType", "IEEE4ByteReal")])
        bands = int(pairs.get("NrOfBands", 1))
        heads[name] = (kind.str, bands, float(pairs["NullCellValue"]), (system.get_file_info(file).size - 512) // (kind.itemsize * bands))
    line = "linenumber" if "linenumber" in heads else "line"
    shown = [n for n in sorted(heads) if n not in (line, "line", "linetype", "index") and (columns is None or n in columns)]
    rows = min([heads[n][3] for n in heads if n not in (line, "linetype", "index")], default=0)
    fields = [(n, f"{n}_{k + 1}" if heads[n][1] > 1 else n, k) for n in shown for k in range(heads[n][1])]

    def values(s, name: str, first: int, count: int):
        kind, bands, null, _ = heads[name]
        size = np.dtype(kind).itemsize * bands
        with s.open_input_file(files[name]) as f:
            raw = np.frombuffer(f.read_at(count * size, 512 + first * size), kind).reshape(-1, bands)
        return np.where((raw == np.asarray(null).astype(kind)) | ~np.isfinite(raw.astype("float64")), np.nan, raw.astype("float64"))

    def read(frames):
        s, _ = open_file(path)
        index, lines = (values(s, n, 0, heads[n][3]) for n in ("index", line))  # a row for each line
        for pdf in frames:
            for first in pdf["id"]:
                count = min(rows_a_task, rows - int(first))
                at = np.arange(int(first), int(first) + count)
                k = np.searchsorted(index[:, 0], at, side="right") - 1
                on = (k >= 0) & (at <= index[np.maximum(k, 0), 0] + index[np.maximum(k, 0), 1])
                out = {"row": at, "line": np.where(on, lines[np.maximum(k, 0), 0], np.nan)}
                held = {n: values(s, n, int(first), count) for n in shown}
                out |= {label: held[n][:, b] for n, label, b in fields}
                yield pd.DataFrame(out).astype({c: object for c in out if c != "row"}).where(lambda d: d.notna(), None)

    schema = "row long, line double" + "".join(f", `{label}` double" for _, label, _ in fields)
    ship(spark)
    return spark.range(0, rows, rows_a_task).repartition(max(1, -(-rows // rows_a_task))).mapInPandas(read, schema)
