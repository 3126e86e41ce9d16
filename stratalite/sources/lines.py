"""Lines of text files in order: what formats with headers and blocks need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at, text: each line with its place (part file, byte range, place in the range).

    The part files of a folder are one ``file``. Large files are split as Spark
    splits them; ``at`` orders the lines of all splits.
    """
    part = F.col("_metadata.file_path")
    whole = F.when(F.col("_metadata.file_name").startswith("part-"), F.regexp_replace(part, "/part-[^/]*$", "")).otherwise(part)
    rows = spark.read.text(path).select(whole.alias("file"), part.alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("text"))
    return rows.select("file", F.struct("p", "b", "i").alias("at"), "text")


def _blocks(lines: DataFrame, total: Column, upto: Column, name: str) -> DataFrame:
    """Of each block of a file (a split's byte range): what the blocks before it come to. A row for each block, however long the lines."""
    blocks = lines.groupBy("file", F.col("at.p").alias("_p"), F.col("at.b").alias("_b")).agg(total.alias("_of"))
    return blocks.select("file", "_p", "_b", upto.over(Window.partitionBy("file").orderBy("_p", "_b").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def _within():
    return Window.partitionBy("file", "at.p", "at.b").orderBy("at.i").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _with_carried(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    here = lines.withColumns({"_p": F.col("at.p"), "_b": F.col("at.b")})
    return here.join(F.broadcast(blocks), ["file", "_p", "_b"], "left").drop("_p", "_b")  # a row for each split


def _summed(lines: DataFrame, name: str) -> DataFrame:
    """The column ``name`` (long) summed within blocks, in the order in which a task reads their lines: none is sorted or sent."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        block, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, k = batch.column(batch.schema.get_field_index("at")), batch.schema.get_field_index(name)
            p, b = at.field("p"), at.field("b")
            new = np.ones(batch.num_rows, bool)
            new[0] = (p[0].as_py(), b[0].as_py()) != block
            new[1:] = pc.or_(pc.not_equal(p[1:], p[:-1]), pc.not_equal(b[1:], b[:-1])).to_numpy(zero_copy_only=False)
            add = pc.fill_null(batch.column(k), 0).to_numpy(zero_copy_only=False)
            upto, starts = np.cumsum(add), np.flatnonzero(new)
            running = upto - np.concatenate([[-total], upto[starts] - add[starts]])[np.cumsum(new)]
            block, total = (p[-1].as_py(), b[-1].as_py()), int(running[-1])
            arrays = [pa.array(running, pa.int64()) if i == k else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return lines.mapInArrow(sums, lines.schema)


def with_running(lines: DataFrame, name: str, of: Column) -> DataFrame:
    """Adds the sum of ``of`` (whole numbers) over a file's lines so far: sums within blocks, and before them those of whole blocks.

    ``lines`` are as read: selected, filtered or with more columns, but in their order.
    """
    blocks = _blocks(lines, F.sum(of), F.sum("_of"), "_before")
    return _with_carried(_summed(lines.withColumn(name, of.cast("long")), name), blocks).withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before")


def with_latest(lines: DataFrame, name: str, of: Column) -> DataFrame:
    """Adds the last value of ``of`` that isn't null, over a file's lines so far."""
    blocks = _blocks(lines, F.max_by(of, F.when(of.isNotNull(), F.col("at"))), F.last("_of", ignorenulls=True), "_before")
    return _with_carried(lines.withColumn(name, F.last(of, ignorenulls=True).over(_within())), blocks).withColumn(name, F.coalesce(name, "_before")).drop("_before")


def fixed(start: int, stop: int, kind: str = "string") -> Column:
    """A field of a fixed-width line, from column ``start`` (counted from 0) to before ``stop``; null if blank or not of its type."""
    text = F.trim(F.substring("text", start + 1, stop - start))
    text = F.when(text != "", text)
    return text if kind == "string" else text.try_cast(kind)


def write_lines(lines: DataFrame, folder: str, order: list[Column | str]) -> None:
    """Write the column ``text`` in order; the part files, one after the other, are the whole file."""
    lines.orderBy(*order).select("text").write.text(folder)
