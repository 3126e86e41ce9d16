"""Fill-in-middle transformation: texts cut at unit boundaries and put into prefix, suffix, middle order.

A unit grammar is a list of pairs of neighbouring character classes between which a
unit ends. It becomes one zero-width regular expression of a look-behind and a
look-ahead for each pair, so that Spark's ``split`` keeps every character: the pieces
joined are the text. ``split`` gives one empty piece for an empty text, which has no
units and stays plain. All is native: hashes of the id choose the cuts and the form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: (class before, class after) of a boundary, as Java's regular expressions write classes. Beside each the units as a pattern.
GRAMMARS = {
    "line": [(r"[\n]", r"[\s\S]")],  # [^\n]*\n|[^\n]+
    "word": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]")],  # [^ \t\n-\r]*[ \t\n-\r]+|[^ \t\n-\r]+
    "run": [(r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"), (r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]")],  # [ \t\n-\r]+|[^ \t\n-\r]+
    "sentence": [(r"[.!?]", r"[^.!?]")],  # [^.!?]*[.!?]+|[^.!?]+
    "character": [(r"[^\x{D800}-\x{DBFF}]", r"[\s\S]")],  # code points: never between the halves of a surrogate pair
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50


def boundary(grammar: str) -> str:
    """The zero-width pattern of a grammar's boundaries."""
    return "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[grammar])


def units(text: Column, grammar: str = "line") -> Column:
    """The units of a text; none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed and a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, grammar: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Every row of ``docs`` as doc_id, n (units), form, prefix_chars, middle_chars and output.

    ``rate`` percent of the rows are cut, ``spm_rate`` percent of those in the order
    suffix, prefix, middle, the others in prefix, suffix, middle. Texts that are empty
    (null counts as empty) or hold one of the three marks stay as they are, with form
    ``plain`` and null lengths. Rows that repeat are cut alike; a null id draws as an
    empty key. Long texts are cut whole, in one pass without a shuffle; an empty table
    gives no rows, other columns of ``docs`` are ignored.
    """
    h1, h2, h3, h4 = (F.col(f"_h{k}") for k in range(1, 5))
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("_text"), *[h.alias(f"_h{k}") for k, h in enumerate(draws(docs["doc_id"], seed), 1)])
    rows = rows.withColumn("_units", units(F.col("_text"), grammar)).withColumn("n", F.size("_units").cast("long"))
    rows = rows.withColumns({"_a": F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).cast("int"), "_b": F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).cast("int")})
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    plain = (F.col("_text") == "") | marked | (h3 % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))
    part = lambda start, size: F.array_join(F.slice("_units", start, size), "")
    rows = rows.withColumns({"_prefix": part(F.lit(1), F.col("_a")), "_middle": part(F.col("_a") + 1, F.col("_b") - F.col("_a")), "_suffix": part(F.col("_b") + 1, F.greatest(F.col("n").cast("int") - F.col("_b"), F.lit(0)))})
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in ((PREFIX, "_prefix"), (SUFFIX, "_suffix"), (MIDDLE, "_middle")))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.concat(p, s, m))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.char_length("_prefix").cast("long")).alias("prefix_chars"), F.when(cut, F.char_length("_middle").cast("long")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.

    A cut text holds no marks, and no mark ends as another begins, so the first place
    of each mark is where it was put.
    """
    behind = lambda text, mark: F.substring(text, F.locate(mark, text) + len(mark), F.char_length(text))
    before = lambda text, mark: F.substring_index(text, mark, 1)
    psm = F.concat(before(behind(output, PREFIX), SUFFIX), behind(output, MIDDLE), before(behind(output, SUFFIX), MIDDLE))
    spm = F.concat(before(behind(output, PREFIX), MIDDLE), behind(output, MIDDLE), before(behind(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, grammar: str = "line") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of each output and of the text restored from it."""
    made = transform(docs, grammar)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
