"""Streams of several files: batches add up, a later call goes on, nulls and ties."""

import tempfile
from datetime import datetime, timedelta

from stratalite.streaming import running

ROWS = [(i % 3 if i % 10 else None, float(i * 7 % 11) if i % 4 else None, i, datetime(2024, 1, 1) + timedelta(hours=5 * i)) for i in range(40)]
SCHEMA = "k long, v double, id long, ts timestamp"


def written(spark, rows):
    """A folder with five files."""
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    spark.createDataFrame(rows, SCHEMA).repartition(5, "id").write.parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_add_up_and_go_on(spark):
    path, folder = written(spark, ROWS[:30]), tempfile.mkdtemp(prefix="spark-")
    run = lambda: rows(running.folded(running.statistics(running.growing(spark, path, 1), ["k"], "v"), ["k"], folder))
    for n in (30, 40):
        if n == 40:
            spark.createDataFrame(ROWS[30:], SCHEMA).write.mode("append").parquet(path)
        want = {}
        for k, v, *_ in ROWS[:n]:
            want.setdefault(k, []).extend([] if v is None else [v])
        got = {k: (count, mean) for k, count, mean, _ in run()}
        assert {k: c for k, (c, _) in got.items()} == {k: len(v) for k, v in want.items()}
        assert all(abs(got[k][1] - sum(v) / len(v)) < 1e-9 for k, v in want.items() if v)


def test_best(spark):
    path = written(spark, [*ROWS, (7, None, 99, None), (1, 10.0, 98, None)])
    got = {k: (v, i) for k, v, i in rows(running.folded(running.best(running.growing(spark, path, 1), ["k"], "v", "id"), ["k"], tempfile.mkdtemp(prefix="spark-")))}
    want = {k: max(((v, i) for j, v, i, _ in [*ROWS, (1, 10.0, 98, None)] if j == k and v is not None)) for k in (None, 0, 1, 2)}
    assert got == want | {7: (None, None)}


def test_windows_without_time_and_empty(spark):
    def days(r):
        stream = running.windows(running.growing(spark, written(spark, r), 1), "ts", "v", [], "1 day", "100 days")
        return rows(running.folded(stream, ["start"], tempfile.mkdtemp(prefix="spark-")))

    got = days([*ROWS, (1, 5.0, 50, None)])
    assert len(got) == len({t.date() for *_, t in ROWS}) and sum(n for _, n, _ in got) == sum(v is not None for _, v, *_ in ROWS)
    assert days([]) == []
