import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from odd_rows import ODD  # noqa: E402


def documents(spark, rows, extra=""):
    """A small documents table from (doc_id, text, lang, source)."""
    data = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = documents(spark, ODD)
    for name in ("row", "key", "epoch", "band", "line", "host", "_text_hash", "_base", "_spans", "bucket", "n_tokens", "component", "kept"):
        df = df.withColumn(name, F.lit("mine"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
