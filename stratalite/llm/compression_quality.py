"""A quality classifier by compression: a text is like the texts whose dictionary makes it smaller.

Two zstandard dictionaries are trained, on windows of texts labelled good and of
texts labelled bad. A text is cut into blocks, and every block is compressed with
either dictionary; the difference of the sizes over the text's bytes is its
feature. A logistic curve, fitted on labelled texts that no dictionary was trained
on, turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

#: Labelled rows of each class that are learned from at most, and characters of each: the bound of what the driver gathers.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 8192
#: Bytes of a dictionary, bytes of a block that is compressed at once, and zstandard's level.
DICTIONARY, BLOCK, LEVEL = 112_640, 4096, 3


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text leaves no rest by 5. A null id isn't held out (it has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """The labelled rows that aren't held out: _id and good (0 or 1)."""
    rows = labels.select(labels["doc_id"].alias("_id"), F.col("quality").cast("int").alias("good"))
    return rows.where(F.col("good").isin(0, 1) & ~held_out(F.col("_id")) & F.col("_id").isNotNull())


def labelled_sample(docs: DataFrame, rows: DataFrame) -> list:
    """Of each class the rows whose salted id hashes come first, with one window of each text, as (order, good, text)."""
    rows = rows.withColumn("order", F.xxhash64("_id", F.lit("quality sample")))
    chosen = [rows.where(F.col("good") == k).orderBy("order", "_id").limit(SAMPLE_ROWS) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * SAMPLE_ROWS rows at most
    texts = docs.select(docs["doc_id"].alias("_id"), text_of(docs).alias("text")).where(F.length("text") > 0)
    start = F.pmod(F.col("order"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    got = texts.join(ids, "_id").select("good", "order", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    return sorted((r.order, r.good, r.text) for r in got.collect())


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve's slope and intercept; without dictionaries, the intercept alone."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def score(self, difference: float) -> float:
        import math

        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * difference + self.intercept))))


def compressors(good: bytes, bad: bytes) -> list:
    import zstandard

    out = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(text: str, pair: list) -> float:
    """Bytes that the bad dictionary needs more than the good one, over the bytes of the whole text; 0 for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    good, bad = (sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in pair)
    return (bad - good) / len(data)


def fit_curve(x, y, weight) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression with a slight ridge, by Newton's method."""
    import numpy as np

    x, y, weight = (np.asarray(v, float) for v in (x, y, weight))
    scale = x.std() or 1.0
    a = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 0.01 * w
        w = w - np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), gradient)
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Even rows of the sample's order train the dictionaries, odd ones the curve, weighted by the classes' shares of all labelled rows.

    Without both classes the score is their smoothed share.
    """
    import math

    import zstandard

    rows = learnable(labels)
    n = {k: 0 for k in (0, 1)} | {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    sample = labelled_sample(docs, rows)
    share = math.log((n[1] + 1) / (n[0] + 1))
    made = []
    for k in (1, 0):
        texts = [text.encode() for _, good, text in [r for r in sample if r[1] == k][::2]]
        blocks = [t[i : i + BLOCK // 2] for t in texts for i in range(0, len(t), BLOCK // 2)]
        try:
            made.append(zstandard.train_dictionary(DICTIONARY, blocks).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too few texts to train on: they are the dictionary
            made.append(b"".join(blocks)[-DICTIONARY:])
    curve = [r for k in (1, 0) for r in [r for r in sample if r[1] == k][1::2]]
    if not all(made) or len({r[1] for r in curve}) < 2:
        return Model(b"", b"", 0.0, share)
    pair, classes = compressors(*made), [g for _, g, _ in curve]
    weight = [n[g] / sum(n.values()) * len(curve) / classes.count(g) for g in classes]
    return Model(*made, *fit_curve([difference(t, pair) for _, _, t in curve], classes, weight))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text. A null text is empty; repeated rows and null ids stay."""

    def make():
        pair = compressors(model.good, model.bad) if model.good else None

        def batch(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                yield key, model.score(difference(text, pair) if pair else 0.0)

        return batch

    out = map_batches(docs.select("doc_id", text_of(docs).alias("text")), make, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
