"""A Jaccard join of texts on their sets of word n-grams, with MinHash banding.

1. Each text becomes its set of hashed n-grams (64 bits), and a signature of
   minima under random functions, cut into bands. Band and row counts follow from
   the similarity and the target recall.
2. Texts with equal sets are one class; only its first row goes on.
3. Rows are shuffled on band hashes. Instead of the pairs of a bucket, each row is
   linked with the bucket's first row; the connected components of these links
   hold every pair that shares a bucket.
4. A component that fits a block is verified whole: its full n-gram sets are
   intersected by counting shared n-grams. In a larger one of near copies each row is
   sent as its difference from the component's first row, which tells intersections as
   exactly: |A and B| = |R| - |R less A| - |R less B| + what both lack + what both add.
   One that unrelated buckets have chained has no such row; it is verified bucket by
   bucket where that is less work: buckets of the same rows once, and each pair in the
   least bucket it shares. Groups that are still larger than a block are dealt over
   blocks of rows of like set sizes; only blocks whose sizes allow the similarity meet,
   each pair of blocks in a task, to which hashed n-grams go, not texts. Only each row's
   number of partners and a spanning tree leave a task. So no pair is lost and none is
   counted twice.
5. The components of the verified links are the near-duplicate groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalite.session import ship

from .common import map_batches, text_of, written
from .components import components

#: Words of an n-gram, least similarity, share of the pairs just so similar that must meet in a band, and most hash functions for that.
WORDS, SIMILARITY, RECALL, FUNCTIONS = 5, 0.8, 0.9995, 256
#: Rows and n-grams of a block at most (a single longer text is a block's worth by itself).
BLOCK_ROWS, BLOCK_GRAMS = 1000, 500_000


def band_shape(similarity: float, recall: float, functions: int) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance meetings) whose bands reach the recall with so many functions."""
    best = (functions, 1)
    for rows in range(1, functions + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows > functions:
            break
        best = bands, rows
    return best


def grams(text: str, words: int = WORDS):
    """The sorted set of hashed n-grams of a text (uint64).

    Words are runs of ASCII letters, digits, ``_`` and all other non-ASCII
    characters of the lower-cased text. A text of fewer words is one n-gram of all
    of them, one without words has none. A word's hash is the sum of its bytes
    times powers of an odd number, taken over all words of the text at once.
    """
    import numpy as np

    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), "uint8")
    inside = np.concatenate(([False], _word_bytes()[data], [False]))
    border = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = border[::2], border[1::2]
    if not len(starts):
        return np.empty(0, "uint64")
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, "uint64"), np.cumsum((data.astype("uint64") + np.uint64(1)) * power[: len(data)])))
    word = _mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype("uint64"))
    n = min(words, len(word))
    gram = word[: len(word) - n + 1].copy()
    for k in range(1, n):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k]
    return np.unique(_mixed(gram + np.uint64(n)))


_tables: dict = {}


def _word_bytes():
    import numpy as np

    if "inside" not in _tables:
        _tables["inside"] = np.array([b > 127 or chr(b).isalnum() or b == 95 for b in range(256)])
    return _tables["inside"]


def _powers(n: int):
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    import numpy as np

    if len(_tables.get("power", ())) < n:
        size = max(1 << 16, 2 * n)
        odd = 0xD6E8FEB86659FD93
        for name, base in (("power", odd), ("inverse", pow(odd, -1, 1 << 64))):
            out = np.full(size, base, "uint64")
            out[0] = 1
            _tables[name] = np.cumprod(out)
    return _tables["power"], _tables["inverse"]


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def band_hashes(gram, bands: int, rows: int):
    """One signed 64-bit hash for each band."""
    import numpy as np

    if ("functions", bands * rows) not in _tables:
        seeds = _mixed(np.arange(1, 2 * bands * rows + 1, dtype="uint64"))
        _tables["functions", bands * rows] = (seeds[::2] | np.uint64(1)).astype("uint32")[:, None], seeds[1::2].astype("uint32")[:, None]
    factor, plus = _tables["functions", bands * rows]
    short, least = (gram >> np.uint64(32)).astype("uint32"), None
    for at in range(0, len(short), 4096):
        part = (factor * short[None, at : at + 4096] + plus).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    least = least.reshape(bands, rows).astype("uint64")
    out = np.arange(1, bands + 1, dtype="uint64")
    for k in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return out.view("int64")


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """A written table: row, doc_id, text_hash (of the text, natively), n, first and second (128 bits of the set) and the band hashes."""

    def make():
        def batch(keys, hashes, texts):
            for key, text_hash, text in zip(keys, hashes, texts, strict=True):
                g = grams(text, words)
                same = hashlib.blake2b(g.tobytes(), digest_size=16).digest()
                first, second = (int.from_bytes(same[i : i + 8], "little", signed=True) for i in (0, 8))
                yield key, text_hash, len(g), first, second, band_hashes(g, bands, rows).tolist() if len(g) else []

        return batch

    schema = "doc_id long, text_hash long, n long, first long, second long, band array<long>"
    rows_in = keyed(docs).select(F.col("_id").alias("doc_id"), "_text_hash", F.col("_text").alias("text"))
    return written(map_batches(rows_in, make, schema, 128).withColumn("row", F.monotonically_increasing_id()), "gram-signatures")


def keyed(docs: DataFrame) -> DataFrame:
    """Every row as one struct, its id, its text and the text's hash: no name of a column of ``docs`` can clash."""
    return docs.select(F.struct("*").alias("_row"), docs["doc_id"].cast("long").alias("_id"), text_of(docs).alias("_text"), F.xxhash64(text_of(docs)).alias("_text_hash"))


def shared_counts(sets: list):
    """The matrix of intersection sizes of sorted arrays of distinct values.

    Values in up to 24 sets add one for each of their pairs; those in more are
    columns of a 0/1 matrix, whose product with itself is taken in slices.
    """
    import numpy as np

    n = len(sets)
    out = np.zeros((n, n), "float32")
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, start = owner[order], np.concatenate(([0], np.cumsum(count)[:-1]))
    for k in range(2, 25):
        at = start[count == k]
        if len(at):
            members = owner[at[:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            out += np.bincount((members[:, i] * n + members[:, j]).ravel(), minlength=n * n).reshape(n, n).astype("float32")
    out += out.T
    many = np.flatnonzero(count > 24)
    for at in range(0, len(many), 2048):
        part = many[at : at + 2048]
        block = np.zeros((n, len(part)), "float32")
        for c, column_at in enumerate(part):
            block[owner[start[column_at] : start[column_at] + count[column_at]], c] = 1
        out += block @ block.T
    return out


#: What turns an n-gram that a set lacks into an element of its difference from another set.
LACKED = 0xA24BAED4963EE407


def difference(gram, base):
    """The difference of one sorted set from another, with what it lacks marked, and how many those are."""
    import numpy as np

    lacked = np.setdiff1d(base, gram, assume_unique=True)
    added = np.setdiff1d(gram, base, assume_unique=True)
    return np.sort(np.concatenate((added, lacked ^ np.uint64(LACKED)))), len(lacked)


def similar(sets: list, side: list[int] | None, similarity: float, sizes=None, lacked=None, base: int = 0):
    """The 0/1 matrix of pairs that are similar; with ``side``, only of pairs on different sides.

    Differences from a base of ``base`` n-grams come with the sizes of their sets and
    how many n-grams of the base each lacks.
    """
    import numpy as np

    size = np.array([len(s) for s in sets] if sizes is None else sizes, "float64")
    shared = shared_counts(sets).astype("float64")
    if base:
        lacked = np.asarray(lacked, "float64")
        shared += base - lacked[:, None] - lacked[None, :]
    near = shared * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(near, False)
    if side is not None:
        side = np.asarray(side)
        near &= side[:, None] != side[None, :]
    return near


def least_reached(near):
    """By row of a symmetric 0/1 matrix: the least row it is connected with."""
    import numpy as np

    n = len(near)
    label = np.arange(n)
    while True:
        best = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def verify_block(rows: list[tuple], across: bool, similarity: float) -> Iterator[tuple[int, int, int]]:
    """Of the rows of a task (group, row, block, copies, sorted n-grams, bands, size of the set, base n-grams lacked, size of the base): row, partners found, least row reached.

    With ``across``, pairs inside one block are another task's, even if the other
    block is empty. Rows with bands are a bucket's (``group``): a pair counts only in
    the least bucket that both rows share.
    """
    import numpy as np

    by: dict[int, dict[int, tuple]] = {}
    for group, row, *rest in rows:
        by.setdefault(group, {})[row] = tuple(rest)  # a repeated row of the table comes once
    for group, members in by.items():
        keys = sorted(members)
        if len(keys) < 2:
            continue
        block, _, sets, _, sizes, lacked, base = zip(*(members[k] for k in keys), strict=True)
        near = similar(list(sets), list(block) if across else None, similarity, sizes, lacked, base[0])
        if members[keys[0]][3] is not None:
            bands = np.array([members[k][3] for k in keys], "int64")
            i, j = np.nonzero(np.triu(near, 1))
            for at in range(0, len(i), 1 << 17):
                x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                other = np.where(bands[x] == bands[y], bands[x], np.iinfo("int64").max).min(axis=1) != group
                near[x[other], y[other]] = near[y[other], x[other]] = False
        partners, reached = near @ [members[k][1] for k in keys], least_reached(near)
        for k, n, to in zip(keys, partners, reached, strict=True):
            if n:
                yield k, int(n), keys[to]


def dealt(groups: DataFrame, similarity: float) -> DataFrame:
    """The rows of groups (group, row, n, and weight, the n-grams to send, by default n) by task: key, group, row, block, across.

    Groups of one block share tasks, whose keys are packs. The rows of a larger group
    are dealt over blocks within classes of set sizes, a class being a factor of
    1 / similarity wide: similar sets are in the same or in neighbouring classes, and
    only blocks of such classes meet.
    """
    groups = groups if "weight" in groups.columns else groups.withColumn("weight", F.col("n"))
    size = _blocks("weight").cast("int")
    per = written(groups.groupBy("group").agg(size.alias("blocks"), F.sum("weight").alias("grams")), "gram-groups")
    packs = int((per.where("blocks = 1").agg(F.sum("grams")).first()[0] or 0) // BLOCK_GRAMS) + 1
    small = groups.join(per.where("blocks = 1").select("group"), "group")
    pack = F.concat_ws(":", F.lit("pack"), F.pmod(F.xxhash64("group"), F.lit(packs)))
    packed = small.select(pack.alias("key"), "group", "row", F.lit(0).alias("block"), F.lit(False).alias("across"))

    large = groups.join(per.where("blocks > 1").select("group"), "group").withColumn("class", F.floor(F.log("n") / math.log(1 / similarity) + 1e-9).cast("int"))
    classes = written(large.groupBy("group", "class").agg(size.alias("blocks")), "gram-classes-of-size")
    beside = Window.partitionBy("group").orderBy("class")
    next_to = lambda f, by: F.when(f("class").over(beside) == F.col("class") + by, f("blocks").over(beside)).otherwise(0)
    classes = classes.withColumns({"below": next_to(F.lag, -1), "above": next_to(F.lead, 1)})
    large = large.join(classes, ["group", "class"]).withColumn("block", F.pmod(F.xxhash64("row", F.lit("block")), F.col("blocks")).cast("int"))

    def met(by: int, blocks: str):
        own, other = F.struct(F.col("class").alias("class"), F.col("block").alias("block")), lambda k: F.struct((F.col("class") + by).alias("class"), k.cast("int").alias("block"))
        pair = lambda k: F.struct(F.least(own, other(k)).alias("low"), F.greatest(own, other(k)).alias("high"))
        return F.when(F.col(blocks) > 0, F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), pair)).otherwise(F.array().cast("array<struct<low:struct<class:int,block:int>,high:struct<class:int,block:int>>>"))

    spread = large.withColumn("pair", F.explode(F.concat(met(0, "blocks"), met(-1, "below"), met(1, "above"))))
    key = F.concat_ws(":", "group", "pair.low.class", "pair.low.block", "pair.high.class", "pair.high.block")
    # the block's name within its group: class and number
    spread = spread.select(key.alias("key"), "group", "row", (F.col("class") * 1_000_000 + F.col("block")).alias("block"), (F.col("pair.low") != F.col("pair.high")).alias("across"))
    return packed.unionByName(spread)


def _blocks(weight: str):
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(weight) / BLOCK_GRAMS))


def differences(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of components larger than a block: (component, size) of all, and a written table of the rows of those in which differences from the first row are less than the sets."""
    sizes = sets.groupBy("component").agg(_blocks("n").alias("blocks"), F.count(F.lit(1)).cast("double").alias("size"), F.min("row").alias("first"), F.sum("n").alias("grams"))
    large = written(sizes.where("blocks > 1"), "gram-large")
    bases = sets.join(large.select(F.col("first").alias("row")), "row").select("component", F.col("gram").alias("base"))
    met = sets.join(bases, "component").select("row", "component", "n", "gram", "base")

    def make():
        import numpy as np

        def batch(rows, components_, sizes_, grams_, bases_):
            for row, component, n, gram, base in zip(rows, components_, sizes_, grams_, bases_, strict=True):
                other = np.frombuffer(base, "uint64")
                apart, lacked = difference(np.frombuffer(gram, "uint64"), other)
                yield row, component, n, len(apart), lacked, len(other), apart.tobytes()

        return batch

    schema = "row long, component long, n long, weight long, lacked long, base long, gram binary"
    apart = written(map_batches(met, make, schema, 64), "gram-differences")
    less = apart.groupBy("component").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).where("2 * weight < n").select("component")
    return large, apart.join(less, "component", "left_semi")


def buckets_of(large: DataFrame, sets: DataFrame, banded: DataFrame) -> DataFrame:
    """The rows of chained components (component, size) in buckets (group, row, n, weight, component), of those in which buckets are less work.

    Less work is fewer pairs to compare and no more sets to send: a whole component
    sends each row to as many tasks as it has blocks, buckets to as many as its row is in.
    """
    rows = sets.join(large.select("component"), "component").select("row", "component", "n")
    inside = written(banded.join(rows, "row"), "gram-banded")
    found = inside.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("least"), F.max("row").alias("most"), F.bit_xor(F.xxhash64("row")).alias("all"))
    buckets = found.where("rows > 1").groupBy("component", "rows", "least", "most", "all").agg(F.min("bucket").alias("bucket"))
    buckets = written(buckets.select("component", "bucket", F.col("rows").cast("double").alias("rows")), "gram-buckets")
    work = buckets.groupBy("component").agg(F.sum(F.col("rows") * F.col("rows")).alias("work"), F.sum("rows").alias("sent"))
    split = large.join(work, "component").where("work < size * size AND sent <= size * blocks").select("component")
    return written(inside.join(split, "component").join(buckets.select("bucket"), "bucket").select(F.col("bucket").alias("group"), "row", "n", F.col("n").alias("weight"), "component"), "gram-by-bucket")


def join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A written row for each row of ``docs``: doc_id, text_hash, class_id, copy_of, n_links and is_first.

    ``class_id`` is the least doc_id that the document is connected with by links
    (pairs of Jaccard similarity ``similarity`` or more), ``copy_of`` the least with
    an equal n-gram set, ``n_links`` the number of other documents linked with it,
    copies included; ``is_first`` marks one row of each class. A text without words
    (null and empty ones too) has no n-grams and no links, and is a class of its own.
    A null id is in a class like any other, and is its class_id only if all are null.
    """
    bands, rows = band_shape(similarity, recall, FUNCTIONS)
    sig = signatures(docs, words, bands, rows)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = sig.where("n > 0").groupBy("first", "second").agg(F.min("row").alias("rep"), F.min(rank).alias("rank"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    classes = written(classes, "gram-classes")
    reps = sig.select("row", "doc_id", "text_hash", "band").join(classes.select(F.col("rep").alias("row"), "copies", "n"), "row")
    reps = written(reps, "gram-reps")

    banded = reps.select("row", F.explode("band").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket", "leader")
    met = banded.join(buckets, "bucket").where("row <> leader").select(F.col("row").alias("a"), F.col("leader").alias("b"))
    candidates = components(met).select(F.col("node").alias("row"), "component")

    members = written(reps.select("row", "doc_id", "text_hash", "copies", "n", "band").join(candidates, "row"), "gram-members")
    ship(docs.sparkSession)
    texts = keyed(docs).select("_id", "_text_hash", F.col("_text").alias("text"))
    full = texts.join(members.select("row", "doc_id", "text_hash"), (F.col("text_hash") == texts["_text_hash"]) & F.col("doc_id").eqNullSafe(texts["_id"])).select("row", "text")
    grams_of = map_batches(full, lambda: lambda rows_, texts_: ((r, grams(t, words).tobytes()) for r, t in zip(rows_, texts_, strict=True)), "row long, gram binary")
    sets = written(grams_of.dropDuplicates(["row"]).join(members.select("row", "component", "n"), "row"), "gram-sets")

    large, apart = differences(sets)
    near = apart.select("component").distinct()
    chained = buckets_of(large.join(near, "component", "left_anti"), sets, banded)
    rest = sets.join(near, "component", "left_anti")
    whole = rest.join(chained.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("group"), "row", "n", F.col("n").alias("weight"))
    whole = whole.unionByName(apart.select(F.col("component").alias("group"), "row", "n", "weight"))
    tasks = dealt(whole, similarity).withColumn("bucket", F.lit(False)).unionByName(dealt(chained.drop("component"), similarity).withColumn("bucket", F.lit(True)))
    payload = rest.select("row", "n", F.lit(0).cast("long").alias("lacked"), F.lit(0).cast("long").alias("base"), "gram").unionByName(apart.select("row", "n", "lacked", "base", "gram"))
    payload = payload.join(members.select("row", "copies", "band"), "row")
    fields = ["group", "row", "block", "copies", "gram", "bands", "n", "lacked", "base"]
    sent = tasks.join(payload, "row").withColumn("bands", F.when(F.col("bucket"), F.col("band"))).select("key", "bucket", "across", *fields)

    def verify(batch):
        import numpy as np
        import pandas as pd

        rows_ = [(g, r, b, c, np.frombuffer(x, "uint64"), None if v is None else list(v), *rest) for g, r, b, c, x, v, *rest in batch[fields].itertuples(index=False)]
        return pd.DataFrame(verify_block(rows_, bool(batch["across"].iloc[0]), similarity), columns=["row", "partners", "reached"])

    found = written(sent.groupBy("key", "bucket").applyInPandas(verify, "row long, partners long, reached long"), "gram-links")
    links = found.groupBy("row").agg(F.sum("partners").alias("partners"))
    groups = components(found.select(F.col("row").alias("a"), F.col("reached").alias("b"))).select(F.col("node").alias("rep"), "component")

    named = classes.join(groups, "rep", "left").join(links.withColumnRenamed("row", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = named.groupBy("component").agg(F.min("rank").alias("head"))
    named = named.join(heads, "component").select("first", "second", F.col("rank.doc_id").alias("copy_of"), "head", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.select("row", "doc_id", "text_hash", "n", "first", "second").join(named, ["first", "second"], "left")
    alone = F.col("n") == 0
    return written(
        out.select(
            "doc_id",
            "text_hash",
            F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
            F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
            (alone | (F.col("row") == F.col("head.row"))).alias("is_first"),
        ),
        "gram-join",
    )


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their class (one of rows that repeat it)."""
    first = join(docs, **how).where("is_first").select(F.col("doc_id").alias("_first_id"), F.col("text_hash").alias("_first_hash"))
    rows = keyed(docs)
    kept = rows.join(first, rows["_id"].eqNullSafe(first["_first_id"]) & (rows["_text_hash"] == first["_first_hash"]), "left_semi")
    return kept.dropDuplicates(["_id", "_text_hash"]).select("_row.*")
