"""The data source of raw rasters: values, pruned byte ranges, headers, columns, parts."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from stratalite.sources import raw


def cells_of(df):
    return {(r.row, r.col): tuple(r)[2:] for r in df.collect()}


def stored(values, interleave):
    """bands x rows x cols in the order of a file."""
    return {"line": values.transpose(1, 0, 2), "pixel": values.transpose(1, 2, 0), "band": values}[interleave].tobytes()


@pytest.fixture(scope="module")
def values():
    v = np.random.default_rng(1).integers(-500, 500, (3, 40, 17)).astype(">i2")
    v[1, 5, 5] = -999
    return v


@pytest.mark.parametrize("interleave", ["line", "pixel", "band"])
def test_windows_and_bands(spark, tmp_path, monkeypatch, values, interleave):
    (tmp_path / "r.raw").write_bytes(b"head" + stored(values, interleave))
    monkeypatch.setattr(raw, "TASK_BYTES", 300)
    monkeypatch.setattr(raw, "BATCH_CELLS", 50)
    options = {"rows": 40, "cols": 17, "bands": 3, "dtype": ">i2", "interleave": interleave, "offset": 4, "nodata": -999}
    df = raw.read_raw(spark, str(tmp_path / "r.raw"), **options)
    want = {(r, c): tuple(None if v == -999 else float(v) for v in values[:, r, c]) for r in range(40) for c in range(17)}
    assert cells_of(df) == want
    part = df.where("row >= 5 AND row < 9 AND col > 3 AND col <= 6")
    assert cells_of(part) == {k: v for k, v in want.items() if 5 <= k[0] < 9 and 3 < k[1] <= 6}
    assert cells_of(raw.read_raw(spark, str(tmp_path / "r.raw"), window="30,2,20,4", wanted="3,1", **options)) == {k: (v[2], v[0]) for k, v in want.items() if k[0] >= 30 and 2 <= k[1] < 6}
    assert cells_of(df.where("row = 100")) == cells_of(df.where("col = 99")) == {}


@pytest.mark.parametrize(("interleave", "all_bands"), [("line", False), ("pixel", True), ("band", False)])
def test_filters_prune_bytes(tmp_path, values, interleave, all_bands):
    """A window of a large raster reads no other rows, and of narrow windows no other columns."""
    (tmp_path / "r.raw").write_bytes(stored(values, interleave))
    options = {"rows": "40", "cols": "17", "bands": "3", "dtype": ">i2", "interleave": interleave, "wanted": "2"}
    reader = raw.FilteringReader(str(tmp_path / "r.raw"), options)
    other = GreaterThan(("b2",), 5)
    left = list(reader.pushFilters([GreaterThanOrEqual(("row",), 10), LessThan(("row",), 14), GreaterThan(("col",), 3), LessThanOrEqual(("col",), 6), other]))
    assert left == [other]
    parts = list(reader.partitions())
    assert sum(reader.bytes_of(p) for p in parts) == 4 * 3 * 2 * (3 if all_bands else 1)
    opened = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            opened.append(n)
            return self.f.read_at(n, at)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    class System:
        def open_input_file(self, path):
            from pyarrow import fs

            return Counting(fs.LocalFileSystem().open_input_file(path))

    before = raw.open_file
    raw.open_file = lambda path: (System(), path)
    try:
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    finally:
        raw.open_file = before
    assert sum(opened) == sum(reader.bytes_of(p) for p in parts)
    assert {(r["row"], r["col"]): r["b2"] for r in rows} == {(r, c): float(values[1, r, c]) for r in range(10, 14) for c in range(4, 7)}
    reader = raw.FilteringReader(str(tmp_path / "r.raw"), options)
    assert list(reader.pushFilters([EqualTo(("row",), 7)])) == [] and [(p.first, p.last) for p in reader.partitions()] == [(7, 7)]


def test_geosoft_grid(spark, tmp_path):
    """Values are raw / factor + base, rows from below, the null value none."""
    rows, cols = 3, 4
    data = np.arange(12, dtype="<i2").reshape(rows, cols)
    data[0, 1] = -32767
    head = struct.pack("<5i", 2, 1, cols, rows, 1) + struct.pack("<7d", 25.0, 25.0, 100.0, 200.0, 0.0, 7.0, 4.0)
    (tmp_path / "g.grd").write_bytes(head.ljust(512, b"\0") + data.tobytes())
    want = {(rows - 1 - r, c): (None if (r, c) == (0, 1) else data[r, c] / 4 + 7,) for r in range(rows) for c in range(cols)}
    df = raw.read_raw(spark, str(tmp_path / "g.grd"), kind="geosoft")
    assert cells_of(df) == want
    assert cells_of(df.where("row = 2")) == {k: v for k, v in want.items() if k[0] == 2}
    assert raw.describe(str(tmp_path / "g.grd"), {"kind": "geosoft"})[1] == {"x0": 100.0, "y0": 200.0, "dx": 25.0, "dy": 25.0}


def test_geopak_grid(spark, tmp_path):
    """Records of 128 bytes with their length before and after."""
    rows, cols = 9, 31
    data = np.random.default_rng(3).integers(-90, 90, (rows, cols)).astype("<i2")
    data[2, 3] = -32767
    header = np.zeros(32, "<f4")
    header[:10] = [rows, cols, 10, 5, 1000, 2000, 0, -32767, 1, 50]
    header[10] = 50
    payload = header.tobytes() + data.tobytes()
    payload += b"\0" * (-len(payload) % 128)
    body = b"".join(b"\x81" + payload[k : k + 128] + b"\x81" for k in range(0, len(payload), 128))
    (tmp_path / "g.grd").write_bytes(b"\x4b" + body + b"\x82")
    want = {(rows - 1 - r, c): (None if (r, c) == (2, 3) else data[r, c] / 10 + 5,) for r in range(rows) for c in range(cols)}
    df = raw.read_raw(spark, str(tmp_path / "g.grd"), kind="geopak")
    got = cells_of(df)
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k][0] - want[k][0]) < 1e-12 for k in want)
    assert raw.describe(str(tmp_path / "g.grd"), {"kind": "geopak"})[1] == {"x0": 1000.0, "y0": 2000.0, "dx": 50.0, "dy": 50.0}


def test_columns(spark, tmp_path):
    """One file a column, lines by first row and number of further rows, bands side by side."""
    n = 25
    columns = {"x": ("IEEE8ByteReal", np.arange(n) * 1.5, 1), "mag": ("IEEE4ByteReal", np.where(np.arange(n) == 3, -5e30, np.arange(n)).astype("f4"), 1), "spec": ("Signed16BitInteger", np.arange(2 * n).astype("i2"), 2), "linenumber": ("Signed32BitInteger", np.array([10, 20, 30], "i4"), 1), "index": ("Signed32BitInteger", np.array([[0, 9], [10, 4], [15, 8]], "i4"), 2)}
    for name, (kind, data, bands) in columns.items():
        (tmp_path / f"{name}.PD").write_bytes(b"\0" * 512 + data.astype({"IEEE8ByteReal": "<f8", "IEEE4ByteReal": "<f4", "Signed16BitInteger": "<i2", "Signed32BitInteger": "<i4"}[kind]).tobytes())
        (tmp_path / f"{name}.vec").write_text(f"DatasetHeader Begin\n\tCellType\t= {kind}\n\tNullCellValue = {'-5e30' if kind.startswith('IEEE') else '-32767'}\n\tNrOfBands = {bands}\n")
    got = sorted(tuple(r) for r in raw.read_columns(spark, str(tmp_path), rows_a_task=7).select("row", "line", "mag", "spec_1", "spec_2", "x").collect())
    line = [10.0] * 10 + [20.0] * 5 + [30.0] * 9 + [None]
    assert got == [(r, line[r], None if r == 3 else float(r), 2.0 * r, 2.0 * r + 1, 1.5 * r) for r in range(n)]
    assert raw.read_columns(spark, str(tmp_path), ["x"]).columns == ["row", "line", "x"]


@pytest.mark.parametrize("interleave", ["line", "pixel"])
def test_parts_round_trip(spark, tmp_path, interleave):
    cells = spark.range(37 * 11).select((F.col("id") / 11).cast("int").alias("row"), (F.col("id") % 11).cast("int").alias("col"), F.when(F.col("id") % 9 != 0, F.col("id")).cast("double").alias("a"), (-F.col("id")).cast("double").alias("b")).where("row <> 20")
    path = str(tmp_path / "parts")
    options = raw.write_raw(cells, path, ["a", "b"], interleave=interleave, rows_a_part=5)
    assert len(list((tmp_path / "parts").glob("rows-*.raw"))) == 8
    want = {(r.row, r.col): (r.a, r.b) for r in cells.collect()} | {(20, c): (None, None) for c in range(11)}
    df = raw.read_raw(spark, path, **options)
    assert cells_of(df) == want
    assert cells_of(df.where("row BETWEEN 18 AND 21 AND col = 3")) == {k: v for k, v in want.items() if 18 <= k[0] <= 21 and k[1] == 3}


def test_without_pushed_filters(spark, tmp_path, values):
    """A session that doesn't push filters gets the same rows."""
    (tmp_path / "r.raw").write_bytes(stored(values, "line"))
    options = {"rows": 40, "cols": 17, "bands": 3, "dtype": ">i2"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        got = cells_of(raw.read_raw(spark, str(tmp_path / "r.raw"), **options).where("row = 7 AND col < 3"))
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert got == {(7, c): tuple(map(float, values[:, 7, c])) for c in range(3)}
