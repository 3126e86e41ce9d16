"""Change feeds of voxel models: what a model's changed voxels add to sums over the model, without the model itself.

A feed has rows (i, j, k, lith, version), in any order and batches. Each column of
voxels keeps the newest lithology of its voxels as its state, and says what it takes away
and puts in. Results that are sums over voxels (counts, the field at stations) follow by
adding those up; parts of batches are added together when there are many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalite.session import ship

#: Parts of batches that are kept before they are added up in one.
PARTS = 16


def voxel_deltas(feed: DataFrame) -> DataFrame:
    """A streaming feed as rows (i, j, k, lith, sign): -1 for what a voxel was, 1 for what it is now.

    Of a voxel's rows that with the greatest version counts, of equal versions the greatest
    lithology. A null lithology takes the voxel away, and is the least of equal versions.
    Rows with a null place or version are left out; what changes nothing says nothing.
    State is a column's newest rows: one for each of its layers.
    """
    ship(feed.sparkSession)
    known = feed.where("i IS NOT NULL AND j IS NOT NULL AND k IS NOT NULL AND version IS NOT NULL")
    known = known.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("k").cast("int").alias("k"), F.col("lith").cast("string").alias("lith"), F.col("version").cast("long").alias("version"))

    def change(key, frames, state):
        import pandas as pd

        held = {k: (v, lith) for k, v, lith in zip(*state.get, strict=True)} if state.exists else {}
        was = {}
        rank = lambda e: (e[0], e[1] is not None, e[1] or "")
        for pdf in frames:
            for k, lith, version in zip(pdf["k"].tolist(), pdf["lith"].tolist(), pdf["version"].tolist(), strict=True):
                new, old = (version, lith if isinstance(lith, str) else None), held.get(k)
                if old is None or rank(new) > rank(old):
                    was.setdefault(k, old[1] if old else None)
                    held[k] = new
        state.update(([*held], [v for v, _ in held.values()], [lith for _, lith in held.values()]))
        out = [(key[0], key[1], k, lith, sign) for k, old in was.items() if old != held[k][1] for lith, sign in ((old, -1), (held[k][1], 1)) if lith is not None]
        yield pd.DataFrame({n: pd.Series([r[m] for r in out], dtype=t) for m, (n, t) in enumerate((("i", "int32"), ("j", "int32"), ("k", "int32"), ("lith", "object"), ("sign", "int32")))})

    return known.groupBy("i", "j").applyInPandasWithState(change, "i int, j int, k int, lith string, sign int", "k array<int>, version array<long>, lith array<string>", "append", "NoTimeout")


def field_deltas(deltas: DataFrame, properties: DataFrame, kernel: DataFrame) -> DataFrame:
    """What deltas of voxels add to the field at stations above the columns: i, j, value.

    ``properties`` (lith, amount) and ``kernel`` (k, di, dj, effect): a voxel in layer k adds
    amount x effect to the station at i + di, j + dj. Lithologies without an amount add nothing.
    Changes of a voxel are added up before they meet the kernel.
    """
    net = deltas.join(properties, "lith").groupBy("i", "j", "k").agg(F.sum(F.col("sign") * F.col("amount")).alias("_net")).where("_net <> 0")
    met = net.join(kernel, "k").select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), (F.col("_net") * F.col("effect")).alias("value"))
    return met.groupBy("i", "j").agg(F.sum("value").alias("value"))


def count_deltas(deltas: DataFrame) -> DataFrame:
    """What deltas add to the number of voxels of each lithology: lith, n."""
    return deltas.groupBy("lith").agg(F.sum("sign").alias("n"))


def follow(deltas: DataFrame, effect: Callable[[DataFrame], DataFrame], keys: list[str], value: str, folder: str, parts: int = PARTS) -> DataFrame:
    """Run a stream of deltas over the files there are and return its sums so far: keys, value; sums of 0 of counts included.

    ``effect`` turns the deltas of a batch into what they add. Each batch writes its part to
    ``folder``, which a batch that runs again overwrites. After ``parts`` batches the parts are
    added up in one, named by its last batch; readers take the latest such sum and the parts
    after it, so one that was cut short is not seen. A later call goes on from there.
    """
    spark = deltas.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        effect(rows).select(*keys, value).write.mode("overwrite").parquet(f"{folder}/parts/batch={batch}")
        if (batch + 1) % parts == 0:
            _sums(spark, folder, keys, value, batch).write.mode("overwrite").parquet(f"{folder}/sums/upto={batch}")

    deltas.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return _sums(spark, folder, keys, value)


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Batches up to which there is a whole sum."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/sums")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return [int(p.getName().split("=")[1]) for p in found if p.getName().startswith("upto=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def _sums(spark: SparkSession, folder: str, keys: list[str], value: str, upto: int | None = None) -> DataFrame:
    whole = [b for b in _finished(spark, folder) if upto is None or b < upto]
    rows = spark.read.parquet(f"{folder}/parts").where(F.col("batch") > (max(whole) if whole else -1))
    rows = rows.where(F.col("batch") <= upto) if upto is not None else rows
    rows = rows.select(*keys, value)
    if whole:
        rows = rows.unionByName(spark.read.parquet(f"{folder}/sums/upto={max(whole)}").select(*keys, value))
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))
