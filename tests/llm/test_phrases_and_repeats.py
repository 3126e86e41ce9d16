"""Collocations, repeated byte strings and fill-in-middle against plain versions and their SQL."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences

import __spark_entry__ as entry
from stratalite.llm import collocations, fill_in_middle, suffix_dedup


@pytest.mark.parametrize("name", ["op11_collocations", "op13_fill_in_middle"])
def test_sql(spark, sf, name):
    found = entry.queries()[name](spark, sf)
    assert found.count() > 0
    assert differences(found, entry.oracle_sql()[name], sf) == []


# Collocations


def plain_phrases(rows, least, covered=80, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\n-\r]", (text or "").encode().lower()):
            words = [w for w in re.split(rb"[ \t]+", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    inside = Counter()
    for p, a in candidates.items():
        for n in range(2, len(p) - 1):
            for i in range(1, len(p) - n + 1):
                key = (p[0], *p[i : i + n])
                inside[key] = max(inside[key], a)
    out = {}
    for p, a in candidates.items():
        if 100 * inside[p] < covered * a:
            score, k = min((2_000_000 * a // (counts[p[: k + 1]] + counts[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1))
            out.setdefault(p[0], []).append((-score, -a, b" ".join(p[1:]), counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])]))
    return sorted((lang, i, phrase.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items() for i, (s, a, phrase, l, r) in enumerate(sorted(found)[:top], 1))


def test_collocations_of_drawn_texts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["a", "B", "b", "c\x01", "c", "é", "x-y", "zz", "rare", "\U0001f389"]
    rows = []
    for i in range(300):
        picked = rng.choice(len(words), size=rng.integers(0, 60), p=[0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.01, 0.09])
        gaps = rng.choice([" ", "\t", "  ", ". ", ",", "\n", "!?"], size=len(picked), p=[0.7, 0.05, 0.05, 0.08, 0.04, 0.04, 0.04])
        rows.append((i, "".join(words[p] + g for p, g in zip(picked, gaps, strict=True)), ["en", None, "und", "fr"][i % 4], "s"))
    docs = documents(spark, rows).repartition(5)
    want = plain_phrases([(t, lang) for _, t, lang, _ in rows], 12, top=40)
    assert len(want) > 60
    for block, chunk, range_rows, group in ((8 << 20, 1 << 20, 1_000_000, 64_000), (500, 37, 50, 1)):  # the same by many blocks, chunks, ranges and groups
        for name, value in (("BLOCK_BYTES", block), ("CHUNK", chunk), ("RANGE_ROWS", range_rows), ("TOP_GROUP", group)):
            monkeypatch.setattr(collocations, name, value)
        assert sorted(tuple(r) for r in collocations.collocations(docs, least=12, top=40).collect()) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**32 - 1) | st.integers(0, 3)] * 3), max_size=60))
def test_radix_order_is_a_stable_sort(rows):
    columns = [np.array([r[k] for r in rows], "uint32") for k in range(3)]
    assert collocations.radix_order(columns).tolist() == sorted(range(len(rows)), key=lambda i: rows[i])


def test_collocations_of_odd_rows(spark, odd, none):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = {(r.lang, r.phrase): (r.a, r.n) for r in collocations.collocations(odd, least=2).collect()}
    assert found["en", "the same row twice"][0] == 2  # rows that repeat count again, and the German one apart
    assert ("de", "the same row twice") not in found


# Repeated strings


def plain_removed(rows, length=50):
    """By id and text (ids in order, null last): bytes removed, runs, what is left."""
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for at in range(0, len(order)):
        doc, text = order[at]
        data, cover, reach = (text or "").encode(), bytearray(len((text or "").encode())), 0
        for i in range(len(data) - length + 1):
            first = seen.setdefault(data[i : i + length], (doc is None, doc or 0))
            if first < (doc is None, doc or 0):
                for j in range(max(i, reach), i + length):
                    cover[j] = 1
                reach = i + length
        runs = sum(1 for i in range(len(data)) if cover[i] and (i == 0 or not cover[i - 1]))
        out[doc, text] = len(data), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(data, cover, strict=True) if not c)).hexdigest()
    return out


def removed(docs):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()), key=str)


def test_repeats_by_brute_force(docs, texts):
    want = sorted(((doc, *x) for (doc, _), x in plain_removed(list(texts.items())).items()), key=str)
    assert sum(x[2] for x in want) > 0
    assert removed(docs) == want


@pytest.mark.parametrize(("chunk", "part", "bucket", "hot"), [(16 << 20, 2 << 20, 1_000_000, 20_000), (3000, 500, 40, 20_000), (3000, 700, 40, 3), (1, 1 << 20, 100, 0)])
def test_repeats_by_any_layout(spark, monkeypatch, chunk, part, bucket, hot):
    """Copied passages with drawn neighbours, over many chunks and buckets, by contexts and by single windows."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abé £xyz\n"))
    drawn = lambda n: "".join(rng.choice(letters, n))
    common, other = drawn(160), drawn(49)
    rows = [(i, drawn(int(rng.integers(0, 90))) + (common[int(rng.integers(0, 40)) : int(rng.integers(100, 160))] if i % 3 else other + drawn(1)) + drawn(int(rng.integers(0, 90))), "en", "s") for i in range(120)]
    rows += [(200, rows[5][1], "en", "s"), (3, "q" * 300, "en", "s"), (201, "q" * 120, "en", "s"), (None, rows[7][1], "en", "s"), (202, None, "en", "s"), (203, "ab" * 2000 + common, "en", "s")]
    for name, value in (("CHUNK_BYTES", chunk), ("PART_BYTES", part), ("BUCKET", bucket), ("HOT", hot)):
        monkeypatch.setattr(suffix_dedup, name, value)
    want = sorted(((doc, *x) for (doc, _), x in plain_removed([r[:2] for r in rows]).items()), key=str)
    assert removed(documents(spark, rows).repartition(4)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=30), st.integers(1, 5))
def test_merge_sort_of_segments(texts, parts):
    texts = sorted(texts, key=lambda t: len(t) % parts)  # segments by a class of lengths
    of = np.array([len(t) % parts for t in texts])
    start = np.searchsorted(of, of)
    size = np.bincount(of, minlength=parts)[of]
    compare = lambda a, b: np.array([(texts[i] > texts[j]) - (texts[i] < texts[j]) for i, j in zip(a, b, strict=True)])
    got = suffix_dedup.merge_sorted(np.arange(len(texts)), start, size, compare)
    assert got.tolist() == sorted(range(len(texts)), key=lambda i: (of[i], texts[i], i))


def test_collisions_are_verified(monkeypatch):
    """With a hash that tells nothing apart the bytes decide."""
    rng = np.random.default_rng(3)
    pieces = [rng.integers(97, 99, 50).astype("uint8") for _ in range(6)]
    pieces += [pieces[2], pieces[4]]
    data, sizes = np.concatenate(pieces), np.full(8, 50)
    args = data, sizes, np.zeros(8, "int64"), np.arange(8), np.zeros(8, "uint64")
    assert suffix_dedup.shared_windows(*args).tolist() == [0] * 6 + [1, 1]
    monkeypatch.setattr(suffix_dedup, "prefix_hashes", lambda d: (np.zeros(len(d) + 1, "uint64"), np.zeros(len(d) + 1, "uint64")))
    assert suffix_dedup.shared_windows(*args).tolist() == [0] * 6 + [1, 1]


def test_few_suffixes_are_left_to_the_merges(monkeypatch):
    """Eight bytes after eight tell most suffixes apart, and equal ones needn't be compared."""
    rng = np.random.default_rng(5)
    pieces = [rng.integers(97, 99, 50).astype("uint8") for _ in range(300)]
    pieces += pieces[:200] + [np.append(p[:49], np.uint8(99)) for p in pieces[:20]]
    n, merged, plain = len(pieces), [], suffix_dedup.merge_sorted
    monkeypatch.setattr(suffix_dedup, "merge_sorted", lambda items, *rest: merged.append(len(items)) or plain(items, *rest))
    texts = [p.tobytes() for p in pieces]
    got = suffix_dedup.shared_windows(np.concatenate(pieces), np.full(n, 50), np.zeros(n, "int64"), np.arange(n), np.zeros(n, "uint64"))
    assert got.tolist() == [int(texts.index(x) < k) for k, x in enumerate(texts)]
    assert sum(merged) <= 60


@pytest.mark.parametrize("collide", [False, True])
def test_equal_windows_are_neighbours(monkeypatch, collide):
    rng = np.random.default_rng(6)
    data, start = rng.integers(97, 99, 300).astype("uint8"), rng.integers(0, 279, 500)
    if collide:
        monkeypatch.setattr(suffix_dedup, "_mixed", lambda x: x * np.uint64(0))
    order, new = suffix_dedup.equal_windows(data, start, 21)
    texts = [data[k : k + 21].tobytes() for k in start[order]]
    assert sorted(order.tolist()) == list(range(500))
    assert new.tolist() == [k == 0 or x != texts[k - 1] for k, x in enumerate(texts)] and new.sum() == len(set(texts))


def test_repeats_in_odd_rows(odd, none):
    assert suffix_dedup.digests(none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = plain_removed(rows)
    assert removed(odd) == sorted(((doc, *want[doc, text]) for doc, text in rows), key=str)


# Fill-in-middle

#: The units of each grammar as a pattern of Python.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "run": r"[ \t-\r]+|[^ \t-\r]+", "sentence": r"[^.!?]*[.!?]+|[^.!?]+", "character": r"[\s\S]"}


@pytest.mark.parametrize("grammar", sorted(UNITS))
def test_units(spark, grammar):
    texts = ["", "\n", "a\n\nb", "\n\na b  c\n", "one. two!? three", "...", " \t x\r\n", "é\U0001f389\U0001f389 日本\n", "no end", "\x00 nul"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.u for r in df.select(fill_in_middle.units(df["text"], grammar).alias("u")).collect()] == [re.findall(UNITS[grammar], t) for t in texts]


@pytest.mark.parametrize("grammar", ["line", "word", "character"])
def test_cuts_and_restores(spark, odd, grammar):
    texts = {1: "a\nb\nc\n", 2: "x <P> y\n", 3: None, 4: "", 5: "<\n<S\n<M\nP>\n", 6: "S>M>\n<\nP>", 7: "\U0001f389 é\nb", 8: "one"}
    docs = documents(spark, [(i + 10 * k, t, "en", "s") for k in range(6) for i, t in texts.items()])
    made = fill_in_middle.transform(docs, grammar, rate=90)
    forms = set()
    for r in made.withColumn("back", fill_in_middle.restore(made["output"], made["form"])).collect():
        text = texts[r.doc_id % 10] or ""
        h = hashlib.sha256(f"7:{r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        units = re.findall(UNITS[grammar], text)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.back, r.prefix_chars, r.middle_chars) == (len(units), form, want, text, *((None, None) if form == "plain" else (len(p), len(m))))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(odd).count() == odd.count()
    assert fill_in_middle.digests(odd.where("false")).count() == 0
