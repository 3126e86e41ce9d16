"""Personal data by weak supervision, in DataFrame functions only.

Base patterns give spans that always count. Looser patterns give candidates of
further kinds, on which three labelers vote: a strict form of the pattern, a
gazetteer, and the words before the candidate. How reliable each labeler is isn't
given but estimated from all candidates of the corpus, by expectation-maximisation
over the counts of vote patterns; the estimated probabilities then train a
logistic classifier of spans, which decides about the candidates.

Only counts of (kind, votes, length class, digit class) reach the driver: there
are ``len(LOOSE) * 27 * 9`` of them at most, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

# The base patterns, in the order of their kinds, with what a text needs to have to be searched.
# Possessive quantifiers and look-behinds leave the matches as they are; they keep long runs of letters or digits linear.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9]"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
)
#: Kinds that the method may add: a loose pattern, its strict form, what a text needs to have, and the words that speak for it.
LOOSE = (
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", r"[0-9]-[0-9]", "ssn|social|security|tax|insurance"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}", "iban|account|bank|transfer|konto|compte|cuenta"),
    ("local_phone", r"(?<![0-9+).-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"(?:\([2-9][0-9]{2}\) |[2-9][0-9]{2}([.-]))[0-9]{3}[.-][0-9]{4}", r"[0-9][ .-][0-9]", "tel|phone|call|fax|mobile|cell|telefon|tél"),
    ("hidden_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({] ?dot ?[\])}] ?|\.)[A-Za-z0-9-]{1,63}){1,4}", r".*(?:\.|dot ?.) ?[A-Za-z]{2,24}", r"[\[({] ?at ?[\])}]", "mail|contact|write|reach|address"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)\.? \p{Lu}\p{L}{1,20}(?: \p{Lu}\p{L}{1,20})?", r"(?:Mr|Mrs|Ms|Dr|Prof|Sra|Sr)\. .*|(?:Herr|Frau|Mme) .*", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra|Sr)\.? \p{Lu}", "name|dear|patient|customer|client|sincerely|signed"),
)
# Country codes of account numbers with the length of a number; top-level domains; given and family names.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()
DOMAINS = "com org net edu gov mil int info biz io app dev ai co me tv uk de fr es it pt nl be ch at ie dk se no fi pl cz sk hu ro bg gr ru ua tr il za eg ng ke in cn jp kr sg my th vn id ph au nz us ca mx br ar cl".split()
NAMES = (
    "Adam Ahmed Alan Albert Alejandro Alex Alexander Alice Ali Amy Ana Andrea Andreas Andrew Angela Ann Anna Anne Anthony Antonio Barbara Ben Benjamin Brian Bruno Carla Carlos Carmen Caroline Charles Charlotte Chris Christian Christine Claire "
    "Claudia Daniel David Diana Diego Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Francisco Frank Gabriel George Hannah Hans Helen Henry Ivan Jack Jacques James Jan Jane Jason Jean Jennifer Jessica John Jonas Jorge Jose José Joseph Juan "
    "Julia Julie Karen Karl Kevin Klaus Laura Leo Lisa Louis Lucas Lucia Luis Manuel Marc Marco Margaret Maria María Marie Mark Martin Mary Matthew Max Michael Miguel Monika Nicolas Nina Olivia Oscar Pablo Patricia Paul Paula Pedro Peter Philip Pierre "
    "Rachel Richard Robert Rosa Ruth Sara Sarah Simon Sofia Sophie Stefan Steven Susan Thomas Tim Tom Victor Walter William "
    "Becker Bernard Brown Clark Davis Dubois Durand Evans Fernández Fischer García Garcia Gómez González Green Hall Harris Hernández Hill Hoffmann Jackson Johnson Jones King Laurent Lee Lewis López Lopez Martínez Meyer Miller Moore Moreau Müller Pérez "
    "Petit Richter Robinson Rodríguez Sánchez Schmidt Schneider Schulz Smith Taylor Walker Weber White Williams Wilson Wolf Wright Young"
).split()
#: Gazetteers, as patterns that a candidate of the kind (blanks removed) contains: areas that numbers were issued for and no specimen; countries with their lengths; the numbering plan's areas and exchanges; domains; names.
GAZETTEER = {
    "ssn": r"^(?!078-05-1120|219-09-9999|123-45-6789)(?:00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6[0-57-9][0-9]|66[0-57-9]|7[0-6][0-9]|77[0-2])-",
    "iban": "^(?:" + "|".join(f"{x[:2]}[0-9]{{2}}[A-Z0-9]{{{int(x[2:]) - 4}}}" for x in IBAN_LENGTHS) + ")$",
    "local_phone": r"^\(?(?![2-9]11|37|96|[2-9]9)[2-9][0-9]{2}\)?[.-]?(?![2-9]11)[2-9][0-9]{2}",
    "hidden_email": "(?:" + "|".join(DOMAINS) + ")$",
    "name": r"(?<!\p{L})(?:" + "|".join(NAMES) + r")(?!\p{Ll})",
}
AGAINST = "version|isbn|order|invoice|ticket|part|serial|model|article|build|page"
BASE_KINDS, KINDS = [k for k, *_ in BASE], [k for k, *_ in BASE] + [k for k, *_ in LOOSE]
PRIOR_WEIGHT = 8.0
#: Items that are added up one by one, and code points of a chunk that a masked text is put together from.
SCAN, CHUNK = 256, 4096


def bound(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before_each(items: Column, value, combine, zero: int) -> Column:
    """For each item the ``combine``d values of all items before it, in time that grows with the number of items.

    Appending to an array copies it, so that only blocks of SCAN items, and the
    blocks themselves, are added up one by one.
    """
    empty = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SCAN).cast("int")), lambda i: F.slice(items, i * SCAN + 1, F.lit(SCAN)))

    def run(start: Column, column: Column, of) -> Column:
        add = lambda acc, x: F.struct(combine(acc["at"], of(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(column, F.struct(start.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    def within(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), lambda acc, x: combine(acc, value(x))))
        return F.flatten(F.zip_with(parts, run(F.lit(zero), totals, lambda t: t), lambda p, start: run(start, p, value)))

    return F.when(F.size(items) > 0, bound(blocks, within)).otherwise(empty)


def matches(text: Column, pattern: str, needs: str, keep=None, context: bool = False) -> Column:
    """Leftmost matches that don't overlap, as an array of (start, end, match), in code points; with ``keep``, those that pass.

    The match and the gap before it alternate; their lengths are added up. With
    ``context``, ``before`` is the end of the gap, in lower case.
    """
    lit = F.lit
    empty = F.array().cast("array<struct<start: int, end: int, match: string" + (", before: string" if context else "") + ">>")
    found = F.regexp_extract_all(text, lit(pattern), lit(0))
    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("match"))

    def part(x: Column) -> Column:
        length = F.coalesce(F.length(x["match"]), lit(0))
        more = [F.lower(F.substring(x["gap"], -32, 32)).alias("before")] if context else []
        return F.struct(F.length(x["gap"]).alias("gap"), length.alias("length"), x["match"].alias("match"), *more)

    def placed(parts: Column) -> Column:
        at = before_each(parts, lambda x: x["gap"] + x["length"], lambda a, b: a + b, 0)

        def row(x: Column, n: Column) -> Column:
            start = n + x["gap"]
            return F.struct(start.alias("start"), (start + x["length"]).alias("end"), x["match"].alias("match"), *([x["before"].alias("before")] if context else []))

        return F.filter(F.zip_with(parts, at, row), lambda m: m["match"].isNotNull() & (keep(m["match"]) if keep else lit(True)))

    return F.when(text.contains(needs) if needs == "@" else text.rlike(needs), bound(F.transform(zipped, part), placed)).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.length(_digits(match))
        return (n >= 12) & (n <= 19) & F.call_function("luhn_check", F.when((n >= 12) & (n <= 19), _digits(match)).otherwise(F.lit("1")))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans as (start, kind number, end), in order."""

    def of(n: int, kind: str, pattern: str, needs: str) -> Column:
        valid = matches(text, pattern, needs, lambda m: _valid(kind, m))
        return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end")))

    return F.sort_array(F.concat(*[of(n, *entry) for n, entry in enumerate(BASE)]))


def candidates(text: Column) -> Column:
    """Loose matches with the votes of the labelers (1 for, -1 against, 0 none) and the classes of length and digits."""

    def of(n: int, kind: str, strict: str, cues: str):
        def build(m: Column) -> Column:
            before = m["before"]
            regex = F.when(m["match"].rlike(f"^(?:{strict})$"), 1).otherwise(-1)
            listed = F.when(F.replace(m["match"], F.lit(" "), F.lit("")).rlike(GAZETTEER[kind]), 1).otherwise(-1)
            context = F.when(before.rlike(rf"(?<!\p{{L}})(?:{cues})"), 1).when(before.rlike(rf"(?<!\p{{L}})(?:{AGAINST})"), -1).otherwise(0)
            n_digits = F.length(_digits(m["match"]))
            length = F.when(m["end"] - m["start"] < 12, 0).when(m["end"] - m["start"] < 20, 1).otherwise(2)
            digits = F.when(n_digits == 0, 0).when(2 * n_digits < m["end"] - m["start"], 1).otherwise(2)
            return F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end"), regex.alias("regex"), listed.alias("listed"), context.alias("context"), length.alias("length"), digits.alias("digits"))

        return build

    return F.concat(*[F.transform(matches(text, p, needs, context=True), of(len(BASE) + i, k, strict, cues)) for i, (k, p, strict, needs, cues) in enumerate(LOOSE)])


VOTES = ("regex", "listed", "context")
FEATURES = (*VOTES, "length", "digits")


@dataclass(frozen=True)
class Classifier:
    """Weights of the votes, of the classes and of each kind; and how reliable EM found each labeler, (kind, labeler) to share."""

    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(FEATURES, 0.0))
    kinds: dict[int, float] = field(default_factory=dict)
    reliable: dict[tuple[int, str], float] = field(default_factory=dict)

    def accepts(self, c: Column) -> Column:
        total = sum((F.lit(self.weights[f]) * c[f] for f in FEATURES), F.lit(0.0))
        for kind, weight in self.kinds.items():
            total = total + F.when(c["kind"] == kind, weight).otherwise(0.0)
        return total > 0


def estimate(rows: list[dict], rounds: int = 50) -> tuple[list[float], dict[tuple[int, str], float]]:
    """Of vote patterns with counts ``n``: the probability of each to be personal data, and each labeler's reliability by kind.

    EM on a naive Bayes model: a labeler that votes is right with its reliability.
    Starts from 0.8 for each; PRIOR_WEIGHT pseudo-votes hold it there where votes are few.
    """
    kinds = {r["kind"] for r in rows}
    share = dict.fromkeys(kinds, 0.5)
    good = {(k, v): 0.8 for k in kinds for v in VOTES}
    p = [0.5] * len(rows)
    for _ in range(rounds):
        for i, r in enumerate(rows):
            logit = math.log(share[r["kind"]] / (1 - share[r["kind"]]))
            logit += sum(r[v] * math.log(good[r["kind"], v] / (1 - good[r["kind"], v])) for v in VOTES)
            p[i] = 1 / (1 + math.exp(-logit))
        for k in kinds:
            mine = [(q, r) for q, r in zip(p, rows, strict=True) if r["kind"] == k]
            total = sum(r["n"] for _, r in mine)
            share[k] = (sum(q * r["n"] for q, r in mine) + PRIOR_WEIGHT / 2) / (total + PRIOR_WEIGHT)
            for v in VOTES:
                right = sum(r["n"] * (q if r[v] > 0 else 1 - q) for q, r in mine if r[v])
                voted = sum(r["n"] for _, r in mine if r[v])
                good[k, v] = min(0.99, max(0.55, (right + 0.8 * PRIOR_WEIGHT) / (voted + PRIOR_WEIGHT)))
    return p, good


def fit(rows: list[dict], p: list[float], steps: int = 400) -> tuple[dict[str, float], dict[int, float]]:
    """A logistic classifier of the patterns, trained on the probabilities ``p`` by gradient steps, counts as weights."""
    names = [*FEATURES, *sorted({r["kind"] for r in rows})]
    w = dict.fromkeys(names, 0.0)
    mass = [math.log1p(r["n"]) for r in rows]
    for _ in range(steps):
        slope = {k: 0.02 * v for k, v in w.items()}
        for r, q, m in zip(rows, p, mass, strict=True):
            z = sum(w[f] * r[f] for f in FEATURES) + w[r["kind"]]
            d = m * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - q) / sum(mass)
            for f in FEATURES:
                slope[f] += d * r[f]
            slope[r["kind"]] += d
        w = {k: v - 1.0 * slope[k] for k, v in w.items()}
    return {f: w[f] for f in FEATURES}, {k: w[k] for k in names if k not in FEATURES}


def train(found: DataFrame) -> Classifier:
    """From the candidates of the whole corpus. Without any, nothing is accepted."""
    keys = ["kind", *FEATURES]
    counts = found.select(F.explode("candidates").alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r.asDict() for r in counts.collect()), key=lambda r: [r[k] for k in keys])
    if not rows:
        return Classifier()
    p, good = estimate(rows)
    weights, kinds = fit(rows, p)
    return Classifier(weights, kinds, good)


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def apart(base: Column, found: Column) -> Column:
    """The candidates that overlap no base span; base spans are in order, and are searched by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def check(reach: Column):
        def alone(c: Column) -> Column:
            begun = lambda n: F.element_at(base, n)["start"] < c["end"]
            n = F.aggregate(steps, F.lit(0), lambda at, by: F.when(F.when(at <= F.size(base) - by, begun(at + by)).otherwise(False), at + by).otherwise(at))
            return bound(n, lambda k: F.when(k == 0, True).otherwise(F.greatest(F.element_at(reach, F.greatest(k, F.lit(1))), F.element_at(base, F.greatest(k, F.lit(1)))["end"]) <= c["start"]))

        return F.filter(found, alone)

    ends = before_each(base, lambda b: b["end"], F.greatest, 0)
    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(bound(ends, check))


def search(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, text_hash, base spans and candidates that overlap none of them, of every row."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"), candidates(text).alias("all"))
    return written(rows.select("doc_id", "text_hash", "base", apart(F.col("base"), F.col("all")).alias("candidates")), "pii-found")


def decide(found: DataFrame, classifier: Classifier) -> DataFrame:
    """Add ``spans``: the base spans and the accepted candidates, in order."""
    added = F.transform(F.filter("candidates", classifier.accepts), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.withColumn("spans", F.sort_array(F.concat("base", added))).drop("candidates")


def personal_data(docs: DataFrame) -> DataFrame:
    """Of every whole text: doc_id, counts and digest of the base spans, and all spans.

    A null text is empty and has no spans; repeated rows and null ids stay; other
    columns aren't read. An empty table trains nothing and gives no rows.
    """
    found = search(docs)
    done = decide(found, train(found))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return done.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE_KINDS)], F.sha2(F.encode(shown(F.col("base")), "UTF-8"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def cut(chunks: Column, start: Column, stop: Column) -> Column:
    """The code points from start to stop of a text in chunks of CHUNK code points."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(stop / CHUNK).cast("int")
    piece = lambda i, at, n: F.coalesce(F.substring(F.get(chunks, i), at, n), F.lit(""))
    inner = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(piece(first, start % CHUNK + 1, F.lit(CHUNK)), inner, piece(last, F.lit(1), stop % CHUNK))
    return F.when(first == last, piece(first, start % CHUNK + 1, stop - start)).otherwise(several)


def masked(text: Column, spans: Column) -> Column:
    """The text with each span as ``<KIND>``; of spans that overlap, the first is shown and all are hidden.

    Pieces are cut out of chunks, not each from the start of the text, and joined once.
    """
    name = lambda s: F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), s["kind"] + 1)

    def joined(chunks: Column) -> Column:
        def pieces(hidden: Column) -> Column:
            one = lambda s, at: F.when(s["start"] >= at, F.concat(cut(chunks, at, s["start"]), name(s))).otherwise("")
            end = F.greatest(F.element_at(hidden, -1), F.element_at(spans, -1)["end"])
            return F.concat(F.array_join(F.zip_with(spans, hidden, one), ""), cut(chunks, end, F.length(text)))

        return bound(before_each(spans, lambda s: s["end"], F.greatest, 0), pieces)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), joined)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars`` counted anew; other columns and null texts stay.

    Rows are written with what was found in them, the classifier is trained on all
    of them, and then decides: texts are searched once, and rows need no key.
    """
    text = F.col("_text")
    row = docs.select(F.struct("*").alias("_row"), docs["text"].cast("string").alias("_text"))
    row = row.withColumn("_base", F.when(text.isNotNull(), base_spans(text))).withColumn("_all", F.when(text.isNotNull(), candidates(text)))
    found = written(row.select("_row", F.col("_base").alias("base"), apart(F.col("_base"), F.col("_all")).alias("candidates")), "pii-rows")
    row = decide(found, train(found)).withColumn("_text", F.col("_row.text").cast("string"))
    row = row.withColumn("_text", F.when(F.size("spans") > 0, masked(text, F.col("spans"))).otherwise(text))
    new = {"text": text, "n_chars": F.coalesce(F.length("_text").cast("long"), F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return row.select([new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])
