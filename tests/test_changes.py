"""Change feeds of models: any order of batches gives what the whole feed gives; sums of parts; odd rows."""

import collections
import random

import pytest

from stratalite.streaming import changes, running

SCHEMA = "i int, j int, k int, lith string, version long"


def _feed(spark, tmp_path, rows, files, seed):
    rows = rows[:]
    random.Random(seed).shuffle(rows)
    folder = f"file://{tmp_path}/feed{seed}"
    for f in range(files):
        spark.createDataFrame(rows[f::files], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return running.growing(spark, folder, 1)


def _rows():
    g = random.Random(3)
    rows = [(g.randrange(3), g.randrange(3), g.randrange(4), g.choice(["sand", "clay", "salt", None]), g.randrange(40)) for _ in range(150)]
    return [*rows, *rows[:20], (None, 1, 1, "sand", 1), (1, 1, None, "sand", 1), (1, 1, 1, "sand", None)]


def _newest(rows):
    best = {}
    for i, j, k, lith, version in rows:
        if None not in (i, j, k, version):
            e = (version, lith is not None, lith or "")
            best[i, j, k] = max(best.get((i, j, k), e), e)
    return {p: e[2] for p, e in best.items() if e[1]}


@pytest.mark.parametrize("seed, files", [(1, 5), (2, 3)])
def test_counts_follow(spark, tmp_path, seed, files):
    rows = _rows()
    deltas = changes.voxel_deltas(_feed(spark, tmp_path, rows, files, seed))
    found = changes.follow(deltas, changes.count_deltas, ["lith"], "n", f"file://{tmp_path}/out{seed}", parts=2)
    assert {r["lith"]: r["n"] for r in found.collect() if r["n"]} == dict(collections.Counter(_newest(rows).values()))


def test_field_follows_and_goes_on(spark, tmp_path):
    rows, amount = _rows(), {"sand": 2.0, "clay": 3.5}
    kernel = [(k, di, dj, 1.0 / (1 + k + di * di + dj * dj)) for k in range(4) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    properties, table = spark.createDataFrame([*amount.items()], "lith string, amount double"), spark.createDataFrame(kernel, "k int, di int, dj int, effect double")
    folder = f"file://{tmp_path}/out"
    for part in (rows[:90], rows):  # the second call finds more files in the same folder
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/feed")
        deltas = changes.voxel_deltas(running.growing(spark, f"file://{tmp_path}/feed", 1))
        found = changes.follow(deltas, lambda d: changes.field_deltas(d, properties, table), ["i", "j"], "value", folder, parts=1)
        want = collections.defaultdict(float)
        for (i, j, k), lith in _newest(part).items():
            for k2, di, dj, effect in kernel:
                if k2 == k and lith in amount:
                    want[i + di, j + dj] += amount[lith] * effect
        got = {(r["i"], r["j"]): r["value"] for r in found.collect()}
        assert all(got.get(p, 0.0) == pytest.approx(v) for p, v in want.items()) and all(want.get(p, 0.0) == pytest.approx(v, abs=1e-9) for p, v in got.items())
