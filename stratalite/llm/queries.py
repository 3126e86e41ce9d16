"""The queries of this package, over the whole of their tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, compression_quality, fill_in_middle, imatch, mixing, ngram_join, pii, quality_rules, secret_scan, suffix_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the byte-level vocabulary."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records and read the archives back."""
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and the frequency of lines on each source."""
    return quality_rules.quality(_table(spark, sf_dir, "documents"))


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all texts with a Jaccard similarity of 0.8 or more on five words."""
    return ngram_join.join(_table(spark, sf_dir, "documents")).drop("text_hash")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they exceed a context of 1024."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024)


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled rows that aren't held out, score every text."""
    docs = _table(spark, sf_dir, "documents")
    return compression_quality.score(docs, compression_quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, their edited texts and their neighbours."""
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each epoch chosen by budgets on the tree of domain, language and source."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by their cohesion."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that documents with smaller ids have, taken out of every text."""
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at lines into prefix, middle and suffix, and restored."""
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_codec, op2_warc_archive, op3_line_frequency, op4_weak_supervision_pii, op5_ngram_join, op6_token_counts, op7_compression_quality, op8_imatch, op9_source_mix, op10_secret_scan, op11_collocations, op12_suffix_dedup, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {"op2_warc_archive": warc.ORACLE, "op11_collocations": collocations.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE}
