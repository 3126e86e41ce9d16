"""I-Match fingerprints, in DataFrame functions only.

The lexicon has the terms whose inverse document frequency is within a band. Its
size doesn't grow with the corpus: a term in at least a share f of the documents
takes f of all documents' distinct terms, so that there are no more than (mean
distinct terms) / f. That bound is checked before the lexicon is broadcast.

A text's distinct lexicon terms are sorted, and hashed once for the whole lexicon
and once for each of several random subsets of it, from a half to a few
thousandths, so that long texts have subsets that a change leaves alone. Subsets
are classes of the terms' hashes. Texts without a lexicon term have the hash of
all their distinct terms instead.

Texts are shuffled once, to their neighbours by id. Terms are looked up, gathered
and hashed in that same stage.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: The band: ln(documents / documents with the term), from a quarter of the documents to a thousandth.
LEAST_IDF, MOST_IDF = 1.4, 6.9
#: Subsets: (bits, n) are the first n of the 2 ** bits classes that so many bits of a term's hash make. Each group has bits of its own.
SUBSETS = ((1, 1), (3, 4), (5, 12), (7, 24), (9, 16))
#: Most rows of a lexicon that is broadcast; a larger one (texts of over 2,000 distinct terms on average) is joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Rows of neighbouring ids that are ordered together, at least; most ranges of them; bytes of texts for a task; copies that one row stands for.
BUCKET, MOST_RANGES, TASK_BYTES, CHUNK = 512, 1 << 16, 8 << 20, 10_000


def terms(text: Column) -> Column:
    """The distinct words (runs of letters and digits, in lower case) of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> tuple[DataFrame, int]:
    """A written table of the term hashes in the band, and its rows.

    Counts are of all documents; partial sums are formed before the shuffle.
    """
    total = docs.count()
    counts = docs.select(F.explode(terms(text_of(docs))).alias("t")).groupBy(F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("n"))
    found = written(counts.where((idf >= least_idf) & (idf <= most_idf)).select("term"), "imatch-lexicon")
    return found, found.count()


def cut_points(rows: DataFrame, n: int) -> tuple[list[tuple[int, int]], DataFrame | None]:
    """Lower bounds (a, h) of ranges with about BUCKET rows each, and the keys of very many rows, if there are any.

    Both come from a sample of 64 rows for each range, as for any range partitioning:
    they say only where rows are dealt with, not what becomes of them. An id that
    takes several ranges is cut by its texts' hashes.
    """
    wanted = min(MOST_RANGES, n // BUCKET)
    if wanted < 2:
        return [], None
    some = written(rows.select("a", "h").sample(64 * wanted / n, seed=8), "imatch-sample")
    shares = F.split(F.lit(",".join(str(k / wanted) for k in range(1, wanted))), ",").cast("array<double>")
    ids = some.agg(F.percentile_approx("a", shares, 20 * wanted)).first()[0] or []
    bounds = [(a, -(2**63) + k * (2**64 // m)) for a, m in sorted(Counter(ids).items()) for k in range(m)]
    hot = written(some.groupBy("a", "h").count().where(F.col("count") > 4 * 64).select("a", "h"), "imatch-hot")
    return bounds, hot if hot.count() else None


def place(a: Column, h: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of bounds that are no greater than (a, h), by halving."""
    if not bounds:
        return F.lit(0).cast("long")
    size = 1 << len(bounds).bit_length()
    padded = bounds + [(2**63 - 1, 2**63 - 1)] * (size - 1 - len(bounds))
    first, second = (F.split(F.lit(",".join(str(b[k]) for b in padded)), ",").cast("array<bigint>") for k in (0, 1))
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])

    def step(at: Column, by: Column) -> Column:
        x = F.element_at(first, at + by)
        return F.when((x < a) | ((x == a) & (F.element_at(second, at + by) <= h)), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with the text of the next document by descending id: bucket, rn, guest, copies, doc_id, text, next_text.

    After the last comes the first. Rows that share an id go by the hash of their
    text; null ids go as the least long. Rows are dealt to ranges of neighbours,
    whose bounds follow the ids' own distribution, so that texts are shuffled once.
    Each range also gets, as its guest, the row after its last: the first of the
    next range that has any. Where very many rows have the same id and text, all but
    one have themselves as next: they become a row for each CHUNK ``copies``.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumns({"a": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text"), "copies": F.lit(1).cast("long")})
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    bounds, hot = cut_points(rows, n)
    rows = rows.withColumn("bucket", place(F.col("a"), F.col("h"), bounds))
    heads = written(rows.groupBy("bucket").agg(F.max(F.struct("a", "h")).alias("head")), "imatch-heads")  # MOST_RANGES + 1 rows at most
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    lower = heads.select(F.col("bucket").alias("to"), F.coalesce(F.lag("head").over(order), F.max("head").over(Window.partitionBy(F.lit(0)))).alias("head"))
    guests = written(lower.select("to", "head.a", "head.h"), "imatch-guests")

    own, guest = F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    columns = ["bucket", "guest", "copies", "doc_id", "text", "a", "h"]
    spread = lambda df, places: df.withColumn("_place", F.explode(places)).select("_place.bucket", "_place.guest", *columns[2:])
    mixed = rows
    if hot is not None:
        same = rows.join(F.broadcast(hot), ["a", "h"], "left_semi").groupBy("doc_id", "a", "h", "bucket").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
        same = written(same.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil((F.col("n") - 1) / CHUNK)))), "imatch-copies")
        last = same.where("k = 0").withColumn("copies", F.lit(1).cast("long"))
        mixed = rows.join(F.broadcast(hot), ["a", "h"], "left_anti").unionByName(last.select(rows.columns))
        others = same.where("k > 0").withColumn("copies", F.least(F.lit(CHUNK), F.col("n") - 1 - (F.col("k") - 1) * CHUNK))
        others = others.withColumn("bucket", -1 - F.shiftrightunsigned(F.xxhash64("a", "h", "k"), 1))
        copies = spread(others.withColumn("to", F.col("bucket")), F.array(own, guest))
    called = mixed.join(F.broadcast(guests), ["a", "h"], "left")
    placed = spread(called, F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest)))
    if hot is not None:
        placed = placed.unionByName(copies)
    tasks = min(MOST_RANGES, (size or 0) // TASK_BYTES + 1)
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("a"), F.desc("h"))
    placed = placed.repartition(tasks, "bucket")
    return placed.select("bucket", "guest", "copies", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def _no_term() -> Column:
    return F.xxhash64(F.array().cast("array<bigint>"))


def _class(at: int, bits: int):
    """A term's class by ``bits`` bits of its hash from ``at`` on."""
    return lambda t: F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << bits) - 1))


def _below(of, n: int):
    return lambda t: of(t) < n


def _equal(of, k: int):
    return lambda t: of(t) == k


def groups(ordered: Column) -> list[Column]:
    """Of sorted terms: those in a subset of each group."""
    out, at = [], 0
    for bits, n in SUBSETS:
        out.append(F.filter(ordered, _below(_class(at, bits), n)))
        at += bits
    return out


def hashes(ordered: Column, parts: list[Column], everything: Column) -> Column:
    """One hash for the whole lexicon and for each subset; that of all terms alone if none is in the lexicon."""
    out, at = [F.xxhash64(ordered)], 0
    for (bits, n), part in zip(SUBSETS, parts, strict=True):
        out += [F.xxhash64(F.filter(part, _equal(_class(at, bits), k))) for k in range(n)]
        at += bits
    return F.when(F.size(ordered) > 0, F.array(*out)).otherwise(F.array(everything))


def shown(hashed: Column) -> Column:
    """The fingerprint as text: a hash for each subset, ``-`` where that has no term."""
    one = lambda h: F.when(h == _no_term(), F.lit("-")).otherwise(F.lpad(F.hex(h), 16, "0").substr(1, 12))
    return F.concat(F.when(F.size(hashed) == 1, F.lit("all:")).otherwise(F.lit("")), F.concat_ws(",", F.transform(hashed, one)))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the share of subsets with equal terms among those that either has terms of; 1 for equal fingerprints."""
    both = lambda x, y: F.when((x == _no_term()) & (y == _no_term()), F.lit(0)).when(x == y, F.lit(1001)).otherwise(F.lit(1))
    df = df.withColumn("_met", F.aggregate(F.zip_with(a, b, both), F.lit(0), lambda acc, x: acc + x))
    share = F.floor(F.col("_met") / 1000) / F.greatest(F.col("_met") % 1000, F.lit(1)).cast("double")
    return df.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).otherwise(share)).drop("_met")


def edited(text: Column, other: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), other.substr(F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of every whole text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document goes by descending id, see :func:`with_next`. A null text is
    empty. Repeated rows stay, each the next of the one before; an only row is its own next.
    """
    lex, size = lexicon(docs)
    lex = lex.unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term")))  # no text has the empty term: it leads each text's row through the join
    placed = with_next(docs).withColumn("changed", F.when(F.col("guest") == 0, edited(F.col("text"), F.coalesce("next_text", F.lit("")))))
    placed = placed.select("bucket", "rn", "guest", "copies", "doc_id", "text", "changed", terms(F.col("text")).alias("own"), F.coalesce(terms(F.col("changed")), F.array().cast("array<string>")).alias("new"))
    info = F.struct(
        "guest", "copies", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("changed", "UTF-8"), 256).alias("edited_sha256"),
        F.xxhash64(F.sort_array("own")).alias("all_own"), F.xxhash64(F.sort_array("new")).alias("all_new"),
    )
    nothing = F.lit(None).cast("struct<guest: int, copies: bigint, doc_id: bigint, n_chars: bigint, edited_sha256: string, all_own: bigint, all_new: bigint>")
    of = lambda v, column: F.transform(column, lambda t: F.struct(F.lit(v).alias("v"), F.xxhash64(t).alias("term"), nothing.alias("info")))
    row = F.array(F.struct(F.lit(2).alias("v"), F.xxhash64(F.lit("")).alias("term"), info.alias("info")))
    each = placed.select("bucket", "rn", F.inline(F.concat(of(0, "own"), of(1, "new"), row)))
    hits = each.join(F.broadcast(lex) if size <= BROADCAST_ROWS else lex, "term")
    lists = hits.groupBy("bucket", "rn").agg(
        F.collect_list(F.when(F.col("v") == 0, F.col("term"))).alias("own"), F.collect_list(F.when(F.col("v") == 1, F.col("term"))).alias("new"), F.first("info", ignorenulls=True).alias("info")
    )
    # each step is a select of its own, so that what several columns use is made once
    ordered = lists.select("bucket", "rn", "info.*", F.sort_array("own").alias("own"), F.sort_array("new").alias("new"))
    parts = ordered.select("*", *[c.alias(f"{v}{k}") for v in ("own", "new") for k, c in enumerate(groups(F.col(v)))])
    made = parts.select(
        "bucket", "rn", "guest", "copies", "doc_id", "n_chars", "edited_sha256",
        *[hashes(F.col(v), [F.col(f"{v}{k}") for k in range(len(SUBSETS))], F.col(f"all_{v}")).alias(f"{v}_hashes") for v in ("own", "new")],
    )
    out = made.withColumn("next_hashes", F.lead("own_hashes").over(Window.partitionBy("bucket").orderBy("rn"))).where("guest = 0")
    out = likeness(likeness(out, "own_hashes", "new_hashes", "near_edited"), "own_hashes", "next_hashes", "near_next")
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own_hashes")).alias("fingerprint"), shown(F.col("new_hashes")).alias("edited_fingerprint"), "near_edited", "near_next")
