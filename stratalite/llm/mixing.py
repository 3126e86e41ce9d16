"""Mixing sources to target weights by budgets on a tree.

The tree has a level for each grouping column (domain, language, source). The
total of tokens is dealt out from the root: each node's budget goes to its
children by weight, but none gets more than its subtree can give (its tokens
times the most epochs); what a child can't take goes to its siblings by weight,
and only what all siblings together can't take is missing from the parent, which
by the same rule was never given it. A leaf fills its budget with whole epochs
and then a prefix of one more, each epoch in an order of its own seed.

All of it is windows and joins: the levels by sorted windows over one row for each
node, the leaves' prefixes in two steps. An epoch's order is cut into ranges by
the leading digits of its hash, the sums of ranges are added up, and single rows
are only ordered inside the range that the budget ends in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import map_batches, text_of, written

LEVELS = ("domain", "lang", "source")
#: Rows of one id and text beyond which each is ordered by its row too.
MANY = 1000


#: Characters of a run with or without white space, from which on a piece may be so long that merging it takes a linear method.
LONG_RUN = 3000


def token_lengths(rows: DataFrame, columns: str, path: str | None, pattern: str | None) -> DataFrame:
    """``rows`` (``columns`` and text) with n_tokens, the byte-level BPE tokens of the whole text, in place of the text."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def make():
        count = token_counter(path, pattern)

        def batch(keys, texts):
            for key, text in zip(keys, texts, strict=True):
                yield key, count(text)

        return batch

    names = [c for c in rows.columns if c != "text"]
    return map_batches(rows.select(F.struct(*names).alias("key"), "text"), make, f"key struct<{columns}>, n_tokens long").select("key.*", "n_tokens")


_loaded: dict[tuple, object] = {}


def token_counter(path: str, pattern: str):
    """Of a Python worker: a text's tokens by the library; texts with very long runs, which it merges in quadratic time, by prefix tables."""
    if (path, pattern) not in _loaded:
        import re

        import tiktoken

        encode = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={}).encode_ordinary
        long_run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}").search

        def count(text: str) -> int:
            if not text or not long_run(text):
                return len(encode(text))
            return bpe.text_encoder(path, pattern)[0]([text])[0].count(" ") + 1

        _loaded[path, pattern] = count
    return _loaded[path, pattern]


def deal(nodes: DataFrame, parent: Sequence[str], weight: str = "weight", capacity: str = "capacity", budget: str = "budget") -> DataFrame:
    """Each node's share of its parent's budget, as ``dealt``.

    The share is min(capacity, level * weight), with the level at which the shares
    of siblings use up the budget. Sorted by capacity over weight, the nodes that
    fill up are a prefix; the level is what they leave, over the weights of the rest.
    """
    order = Window.partitionBy(*parent).orderBy("_at", *[c for c in nodes.columns if c not in (weight, capacity, budget)])
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    n = nodes.withColumn("_at", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf"))))
    n = n.withColumns({"_left": F.col(budget) - F.coalesce(F.sum(capacity).over(so_far), F.lit(0.0)), "_rest": F.sum(weight).over(later)})
    n = n.withColumn("_level", F.when(F.col("_rest") > 0, F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_rest")).otherwise(F.lit(0.0)))
    n = n.withColumn("_full", (F.col("_at") <= F.col("_level")) & (F.col(weight) > 0))
    everyone = Window.partitionBy(*parent)
    level = F.coalesce(F.min(F.when(~F.col("_full") & (F.col(weight) > 0), F.struct("_at", "_level"))).over(everyone)["_level"], F.lit(float("inf")))
    dealt = F.when(F.col(weight) <= 0, 0.0).when(F.col("_full"), F.col(capacity)).otherwise(F.least(F.col(capacity).cast("double"), level * F.col(weight)))
    return n.withColumn("dealt", dealt).drop("_at", "_left", "_rest", "_level", "_full")


def budgets(leaves: DataFrame, total: float, weights: dict[tuple[str, str], float], epochs: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Tokens that each leaf may give: ``leaves`` has the levels and ``tokens``; adds ``budget``.

    ``weights`` has the weight of a node by (level, value), 1 by default. The
    weights of siblings count in proportion.
    """
    known = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("\x1f".join(k), float(v))]) if weights else None
    tree, current = leaves.withColumn("capacity", (F.col("tokens") * epochs).cast("double")), None
    for depth, level in enumerate(levels):
        upper, here = list(levels[:depth]), list(levels[: depth + 1])
        nodes = tree.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
        w = F.coalesce(F.try_element_at(known, F.concat(F.lit(level + "\x1f"), F.col(level))), F.lit(1.0)) if known is not None else F.lit(1.0)
        nodes = nodes.withColumn("weight", w)
        nodes = nodes.withColumn("budget", F.lit(float(total))) if current is None else nodes.join(current, upper)
        current = deal(nodes, upper or [F.lit(0)]).select(*here, F.col("dealt").alias("budget"))
    return leaves.join(current, list(levels))


def select(docs: DataFrame, total_share: float, weights: dict[tuple[str, str], float], epochs: int, seed: str, levels: Sequence[str] = LEVELS, range_rows: int = 20_000) -> DataFrame:
    """The chosen rows of ``docs`` (row, the levels, n_tokens), one for each epoch, with ``epoch`` and ``order``.

    The total is ``total_share`` of all tokens. A row is chosen if its middle, in
    its epoch's order, is within what the leaf's budget leaves for that epoch: a
    prefix that misses the budget by half a text at most. Rows without
    tokens are never chosen. Rows that tie (repeated ones) are told apart by row.
    Ranges are made so narrow that the largest leaf has about ``range_rows`` rows in each.
    """
    docs = written(docs.select("row", "key", *levels, "n_tokens").where("n_tokens > 0"), "mix-rows")
    many = written(docs.groupBy("key").count().where(F.col("count") > MANY).select("key", F.lit(True).alias("_many")), "mix-many")
    if n := many.count():  # rows that repeat so often would all stand in one place of the order
        docs = docs.join(F.broadcast(many) if n <= 100_000 else many, "key", "left").withColumn("key", F.when(F.col("_many"), F.concat_ws("#", "key", "row")).otherwise(F.col("key"))).drop("_many")
    leaves = written(docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-leaves")
    tokens, most = leaves.agg(F.sum("tokens"), F.max("rows")).first()
    total, digits = total_share * (tokens or 0), 1
    while 16**digits * range_rows < (most or 0):
        digits += 1
    budget = budgets(leaves, total, weights, epochs, levels)
    # whole epochs, and what the last one gets
    turns = budget.select(*levels, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "tokens", "budget")
    turns = turns.withColumn("allowed", F.greatest(F.lit(0.0), F.least(F.col("tokens").cast("double"), F.col("budget") - F.col("epoch") * F.col("tokens")))).where("allowed > 1e-6")
    turns = written(turns.select(*levels, "epoch", "allowed"), "mix-turns")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col("key")))
    rows = docs.join(turns, list(levels)).withColumn("order", order).withColumn("_range", F.substring("order", 1, digits))
    sums = rows.groupBy(*levels, "epoch", "allowed", "_range").agg(F.sum("n_tokens").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*levels, "epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).where("_before < allowed").select(*levels, "epoch", "_range", "_before", (F.col("_before") + F.col("_sum") <= F.col("allowed")).alias("_whole"))
    chosen = rows.join(written(sums, "mix-ranges"), [*levels, "epoch", "_range"])
    columns = ["row", *levels, "n_tokens", "epoch", "order"]
    inside = Window.partitionBy(*levels, "epoch", "_range").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    last = chosen.where(~F.col("_whole")).withColumn("_at", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("_at + n_tokens / 2 <= allowed")
    return chosen.where("_whole").select(columns).unionByName(last.select(columns))


#: Targets of the queries: domains by the rest of the source's checksum, English twice as much as the others, four tenths of all tokens, three epochs at most.
PRODUCTION = {"total_share": 0.4, "weights": {("domain", "d0"): 3.0, ("domain", "d1"): 2.0, ("lang", "en"): 2.0}, "epochs": 3, "seed": "mix-1"}


def with_tree(docs: DataFrame, domains: int = 3, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """row, doc_id, key (id and text), the levels and n_tokens of ``documents``, each row of which has a ``row`` or is numbered.

    A null source or language is the node "". The domain is the rest of the source's CRC by ``domains``.
    """
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.xxhash64(text_of(docs))).alias("key"), name("lang").alias("lang"), name("source").alias("source"),
        (docs[ROW] if ROW in docs.columns else F.monotonically_increasing_id()).alias("row"), text_of(docs).alias("text"),
    )
    counted = token_lengths(rows, "doc_id: long, key: string, lang: string, source: string, row: long", path, pattern)
    return counted.withColumn("domain", F.concat(F.lit("d"), (F.crc32("source") % domains).cast("string")))


def mix(docs: DataFrame, path: str | None = None, pattern: str | None = None, **targets) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch and order of the chosen rows of ``documents``, a row for each epoch.

    Texts are whole; null and empty ones have no tokens and are never chosen. Ids that repeat are chosen row by row.
    """
    return chosen_rows(docs, path, pattern, targets).select("doc_id", *LEVELS, "n_tokens", "epoch", "order")


def chosen_rows(docs: DataFrame, path: str | None, pattern: str | None, targets: dict) -> DataFrame:
    rows = written(with_tree(docs, path=path, pattern=pattern), "mix-docs")
    return select(rows, **PRODUCTION | targets).join(rows.select("row", "doc_id"), "row")


#: The column that numbers the rows of a table, where they have to be found again.
ROW = "_mix_row"


def keep_chosen(docs: DataFrame, path: str | None = None, pattern: str | None = None, **targets) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are chosen; once for each epoch that chooses them.

    Rows are numbered and written first, so that of rows with the same id, or a null
    one, just those stay that the budget has room for.
    """
    rows = written(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias(ROW)), "mix-numbered")
    tree = rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), F.col("_row.lang").alias("lang"), F.col("_row.source").alias("source"), ROW)
    found = chosen_rows(tree, path, pattern, targets).select(F.col("row").alias(ROW))
    return rows.join(found, ROW).select("_row.*")
