"""Quality rules: statistics of each text, and lines that many documents of a host share.

A line is normalised (ASCII letters in lower case, digits as 0, blanks as one
space) and hashed to 64 bits. For each host the distinct documents with a line
are counted; exact copies count once, so that copying a document doesn't turn
its lines into boilerplate. A line above the limit is removed from all documents
of the host but the first (the least doc_id), and a document that keeps too few
of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import ship

from .common import map_batches, text_of, written

#: Fixed characters of the base statistics.
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` (a power of two) words that occur twice or more.

    Windows get numbers by doubling: equal pairs of equal halves are equal, so no
    hash can collide. The search ends as soon as all shorter windows differ.
    """
    import numpy as np

    if len(words) < size:
        return 0
    number: dict[bytes, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], "int64")
    step, n = 1, len(number)
    while step < size:
        values, at = np.unique(at[:-step] * n + at[step:], return_inverse=True)
        n, step = len(values), step * 2
        if n == len(at):
            return 0
    starts = np.flatnonzero(np.bincount(at, minlength=n)[at] > 1)
    return int(np.minimum(np.diff(starts), size).sum()) + size if len(starts) else 0


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text; all 0 for null."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII blanks
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, BLANKS))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def line_keys(text: str | None) -> list[tuple[int | None, int]]:
    """The hash (None without a word) and the words of each line, normalised."""
    import xxhash

    zeros, out = bytes.maketrans(b"123456789", b"0" * 9), []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().translate(zeros).split(b"\n"):
        words = line.split()
        out.append((xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63 if words else None, len(words)))
    return out


def line_words(text: str | None) -> dict[int, int]:
    """By the hash of each normalised line with a word: the words of all its occurrences."""
    out = {}
    for key, n in line_keys(text):
        if n:
            out[key] = out.get(key, 0) + n
    return out


def without_lines(text: str, removed) -> str:
    """The text without all lines whose hash is in ``removed``, each with its line end."""
    gone = set(removed)
    return "\n".join(line for line, (key, _) in zip(text.split("\n"), line_keys(text), strict=True) if key not in gone)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """A written table with a row for each document: its statistics, and hash and words of each distinct line.

    ``row`` numbers the rows, so that repeated rows and null ids stay apart; ``same`` is the text's hash, natively.
    """

    def make():
        def batch(keys, hosts, hashes, texts):
            for key, where, same, text in zip(keys, hosts, hashes, texts, strict=True):
                lines = line_words(text)
                yield key, where, same, *statistics(text), list(lines), list(lines.values())

        return batch

    schema = "doc_id long, host string, same long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, line_words array<long>"
    rows = docs.select(docs["doc_id"].cast("long"), text_of(docs, host).alias("host"), F.xxhash64(text_of(docs)).alias("same"), docs["text"].cast("string"))
    return written(map_batches(rows, make, schema).withColumn("row", F.monotonically_increasing_id()), "quality-measures")


def judge(measured: DataFrame, min_docs: int, min_words: int, min_left: float) -> DataFrame:
    """Add base_failed, ``n_left`` (words in lines that stay), ``removed_lines`` (hashes of the others, null if none) and kept to the rows of :func:`measure`.

    A line is frequent if more than ``min_docs`` distinct documents of the host have
    it, however large the host is. A document is rejected if it fails the base
    rules, or keeps fewer than ``min_words`` words or less than ``min_left`` of them.
    """
    lines = measured.select("row", "doc_id", "host", "same", F.explode(F.arrays_zip("line", "line_words")).alias("l")).select(
        "row", "doc_id", "host", "same", F.col("l.line").alias("line"), F.col("l.line_words").alias("words")
    )
    once = lines.groupBy("host", "line", "same").agg(F.min("doc_id").alias("first"))
    frequent = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first")).where(F.col("docs") > min_docs)
    removed = lines.join(frequent.select("host", "line", "first"), ["host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("row").agg(F.sum("words").alias("removed"), F.collect_list("line").alias("removed_lines"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return (
        measured.drop("line", "line_words")
        .join(removed, "row", "left")
        .withColumns({"base_failed": base_failed, "n_left": left})
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= min_words) & (F.col("n_left") >= min_left * F.col("n_words")))
    )


#: A line that over 20 documents of a host share is boilerplate, whatever share of the host that is; a document needs 8 words, and three tenths of its own, without it.
PRODUCTION = {"min_docs": 20, "min_words": 8, "min_left": 0.3}


def quality(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and n_left for each row of ``docs``.

    A null text has no words and fails; a null host is the host "". Columns of
    ``docs`` other than doc_id, text and the host aren't read. An empty table gives none.
    """
    found = judge(measure(docs, host), **PRODUCTION | limits)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


def keep_good(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, without their frequent lines.

    ``text`` loses the lines above the limit (the first document of the host keeps
    them) and ``n_chars`` is counted anew where it does. A verdict depends on id,
    host and text alone, so rows are met by these three, and rows that repeat all stay.
    """
    same = ["_id", "_host", "_same"]
    verdict = judge(measure(docs, host), **PRODUCTION | limits).where("kept").select(F.col("doc_id").alias("_id2"), F.col("host").alias("_host2"), F.col("same").alias("_same2"), F.col("removed_lines").alias("_removed"))
    verdict = verdict.dropDuplicates([c + "2" for c in same])
    rows = docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_id"), text_of(docs, host).alias("_host"), F.xxhash64(text_of(docs)).alias("_same"))
    kept = rows.join(verdict, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_host") == F.col("_host2")) & (F.col("_same") == F.col("_same2"))).select("_row", "_removed")
    ship(docs.sparkSession)

    cleaned = F.udf(lambda text, removed: None if removed is None else without_lines(text, removed), "string", useArrow=True)
    kept = kept.withColumn("_text", cleaned(F.when(F.col("_removed").isNotNull(), F.col("_row.text").cast("string")), F.col("_removed")))
    new = {"text": F.coalesce("_text", F.col("_row.text").cast("string"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("_text").cast(docs.schema["n_chars"].dataType), F.col("_row.n_chars"))
    return kept.select([new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])
