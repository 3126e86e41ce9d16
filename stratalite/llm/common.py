"""What several operators of this package need: shared folders, written tables, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalite.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the cluster names none (local tests) is one made, below the
    local temporary folder, and set as the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stratalite-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratalite/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, rows: int = 256) -> DataFrame:
    """Rows made from bounded batches of rows, in Python with Arrow.

    ``make`` runs once in each task and returns a function that takes a list of
    values for each column, of at most ``rows`` rows, and yields output tuples.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    names = df.columns
    types = df.sparkSession.createDataFrame([], schema).schema
    out = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = list(f(*(part.column(n).to_pylist() for n in names)))
                columns = zip(*made, strict=True) if made else [[] for _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out, strict=True)], schema=out)

    return df.mapInArrow(run, types)


def text_of(df: DataFrame, column: str = "text"):
    """The column as a string, with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))
