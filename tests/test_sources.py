"""Readers on small files of each format."""

import struct

from pyspark.sql import functions as F

from stratalite.sources import grids, nordic, points

F32 = lambda v: struct.unpack("f", struct.pack("f", v))[0]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def test_cg5_and_gps(spark, tmp_path):
    reading = "10.0 {} 0 2639.271 0.01 1.5 -2.5 0.1 -0.02 60 0 08:15:30 41000.34375 0.0"
    path = put(tmp_path, "x.txt", "/ CG-5 SURVEY\n/ LINE STATION\n" + "\n".join(reading.format(s) for s in (1, 88888)) + "\nLine 10\n")
    got = points.read_cg5(spark, path).orderBy("station").collect()
    assert [r.station for r in got] == [1.0, 88888.0] and got[0].grav == F32(2639.271) and got[0].time == "08:15:30" and got[0].dur == 60
    gps = points.read_gps(spark, put(tmp_path, "gps.csv", "Line,Station,Latitude,Longitude,Elevation\n10,1,-27.5,25.25,1400\n10,base,-27,25,1300\n"))
    assert rows(gps, "elevation") == [(10.0, None, -27.0, 25.0, 1300.0), (10.0, 1.0, -27.5, 25.25, 1400.0)]


def test_fault_planes_and_intensities(spark, tmp_path):
    planes = points.read_fault_planes(spark, put(tmp_path, "f.csv", "lon,lat,depth,strike,dip,rake,x,mag\n25.5,-27,10,120,45,-90,0,4.5\n"))
    assert rows(planes, "longitude") == [(25.5, -27.0, 10.0, 120.0, 45.0, -90.0, 4.5)]
    line = f"{-27.5:10.4f}{25.25:10.4f}{'4+':>5}{'A':<5}{'0001':<10}{'Pretoria':<20}"
    found = points.read_intensities(spark, put(tmp_path, "m.txt", f"one\ntwo\n{line}\n"))
    assert rows(found, "lat") == [(-27.5, 25.25, 4.0, "A", "0001", "Pretoria")]


def test_block_model_and_delimited(spark, tmp_path):
    model = points.read_block_model(spark, put(tmp_path, "b.csv", "# made by hand\nx,y,z,dx,dy,dz,volume,lith\n5,5,95,10,10,10,1000,Sand\n15,25,85,10,10,10,1000,blank\n"))
    assert rows(model.select("i", "j", "k", "lith"), "i") == [(0, 2, 0, "Sand"), (1, 0, 1, "Background")]
    table = points.read_delimited(spark, put(tmp_path, "d.csv", "Line, Long, Lat, V\n1,25,-27,-999\n2,26,-28,5\n"), nodata=-999)
    assert rows(table.select("line", "x", "y", "v"), "x") == [("1", 25.0, -27.0, None), ("2", 26.0, -28.0, 5)]


def test_ascii_grid_registrations(spark, tmp_path):
    body = "1 2\n-9999 4\n"
    corner = grids.read_ascii_grid(spark, put(tmp_path, "a.asc", "ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n" + body))
    centre = grids.read_ascii_grid(spark, put(tmp_path, "c.asc", "ncols 2\nnrows 2\nxllcenter 11\nyllcenter 21\ncellsize 2\nNODATA_value -9999\n" + body))
    want = [(0, 0, 11.0, 23.0, 1.0), (0, 1, 13.0, 23.0, 2.0), (1, 0, 11.0, 21.0, None), (1, 1, 13.0, 21.0, 4.0)]
    for got in (corner, centre):
        assert rows(got.drop("file"), "row", "col") == want


def test_nordic_odd_lines(spark, tmp_path):
    head = " 2005  1 2 0304  5.6 L " + f"{-27.5:7.3f}{25.25:8.3f}{10.0:5.1f}"
    text = head.ljust(79) + "1\n" + " Region:    Somewhere".ljust(79) + "3\n" + head.replace("2005", "1999").ljust(79) + "1\n\n" + " " * 79 + "3\n"
    events, phases = nordic.read_events(spark, put(tmp_path, "n.out", text))
    got = events.orderBy("event").collect()
    assert [(r.event, r.year, r.latitude, r.longitude, r.depth, r.region) for r in got] == [(0, 2005, -27.5, 25.25, 10.0, "Somewhere"), (1, None, None, None, None, None)]
    assert phases.count() == 0


def test_order_over_many_splits(spark, tmp_path):
    """Sums and last values over a file that is read in many splits and by many tasks, and over several files."""
    from stratalite.sources import lines

    texts = [f"{k} {'mark' if k % 37 == 5 else 'x'} {'y' * (k % 50)}" for k in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(texts) + "\n")
    (tmp_path / "b.txt").write_text("1 mark\n2 x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = lines.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 10
        k = F.split("text", " ")[0].cast("long")
        found = lines.with_latest(lines.with_running(read, "n", F.lit(1)), "mark", F.when(F.col("text").contains("mark"), k)).select(k.alias("k"), "n", "mark", F.col("file").endswith("a.txt").alias("a")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.k, r.n, r.mark) for r in found if r.a) == [(k, k + 1, None if k < 5 else (k - 5) // 37 * 37 + 5) for k in range(4000)]
    assert sorted((r.k, r.n, r.mark) for r in found if not r.a) == [(1, 1, 1), (2, 2, 1)]


def test_sorted_totals(spark):
    """Running totals over ranges, and day numbers, without one window over a table."""
    from stratalite.operators import catalog

    values = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "mag double")
    assert {(r.mag, r.n, r.above) for r in catalog.reverse_cumulative(df, "mag").collect()} == {(v, values.count(v), sum(x >= v for x in values)) for v in values}
    assert {(r.mag, r.day_no) for r in catalog.day_index(df, "mag").collect()} == {(v, sorted(set(values)).index(v) + 1) for v in values} | {(None, None)}
    assert catalog.reverse_cumulative(df.where("false"), "mag").count() == 0


def test_running_sums_send_no_lines(spark, tmp_path):
    from stratalite.sources import lines

    texts = ["" if k % 7 == 3 else f"line {k}" for k in range(30000)]
    read = lines.read_lines(spark, put(tmp_path, "a.txt", "\n".join(texts) + "\n"))
    found = lines.with_running(read, "n", (F.col("text") == "").cast("int"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1 and "SortMergeJoin" not in plan  # the window of the blocks' sums
    got, total = {r["at"]["i"]: r["n"] for r in found.collect()}, 0
    for k, text in enumerate(texts):
        total += text == ""
        assert got[k] == total
