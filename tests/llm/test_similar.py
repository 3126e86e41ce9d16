"""The n-gram join and the fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest import documents
from odd_rows import ODD

from stratalite.llm import components, imatch, ngram_join, queries

TOKEN = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+")


def shingles(text, n=5):
    words = TOKEN.findall((text or "").lower())
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(texts):
    """By id: links and class id, for all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    links, up = dict.fromkeys(sets, 0), {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
            links[a] += 1
            links[b] += 1
            i, j = sorted((root(a), root(b)))
            up[j] = i
    return {k: (links[k], root(k)) for k in sets}


def near_copies(n=300, seed=2):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    while k < n:
        words = [draw.choice(vocabulary) for _ in range(draw.choice([1, 4, 6, 30, 120, 400]))]
        for _ in range(draw.choice([1, 1, 2, 5, 20])):
            copy = list(words)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts[k] = " ".join(copy)
            k += 1
    return texts


def joined(df):
    return {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.join(df).collect()}


def test_op5_near_copies(spark, monkeypatch):
    texts = near_copies()
    df = documents(spark, [(k, t, "en", "a") for k, t in texts.items()])
    want = brute(texts)
    assert joined(df) == want
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)  # components and buckets over many blocks
    assert joined(df) == want


def test_op5_chained_component(spark, monkeypatch):
    """Texts that each share words with the next make one component; its rows go to tasks by bucket, in numbers that grow with the rows."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 20)
    shipped, whole = [], ngram_join.dealt
    monkeypatch.setattr(ngram_join, "dealt", lambda *a: (shipped.append(whole(*a)), shipped[-1])[1])
    sent = []
    for n in (200, 800):
        texts = {k: " ".join(f"w{i}" for i in range(20 * k, 20 * k + 150)) for k in range(n)}
        texts |= {n + k: texts[k] + " more" for k in range(0, n, 10)}
        shipped.clear()
        assert joined(documents(spark, [(k, t, "en", "a") for k, t in texts.items()])) == brute(texts)
        sent.append(sum(df.count() for df in shipped))
        assert shipped[1].count() > 0  # by bucket
    assert sent[1] < 6 * sent[0], sent


def test_op5_set_sizes(spark, monkeypatch):
    """A large group of sets of many sizes: brute-force links, fewer rows sent than to all pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 10)
    rows = spark.createDataFrame([(1, k, 5 + k) for k in range(300)], "group long, row long, n long")
    got = ngram_join.dealt(rows, 0.8).collect()
    met = set()
    for key in {r.key for r in got}:
        mine = [r for r in got if r.key == key]
        met |= {(a.row, b.row) for a in mine for b in mine if a.row < b.row and (not a.across or a.block != b.block)}
    assert {(a, b) for a in range(300) for b in range(a + 1, 300) if 5 + a >= 0.8 * (5 + b)} <= met
    assert len(got) < 300 * 30 / 2


def test_op5_whole_table(spark, sf, texts):
    assert {r.doc_id: (r.n_links, r.class_id) for r in queries.op5_ngram_join(spark, sf).collect()} == brute(texts)


def test_op5_odd_rows(odd, none):
    rows = ngram_join.join(odd).collect()
    assert len(rows) == len(ODD) and {r.class_id for r in rows if r.doc_id in (6, 7)} == {6}
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("_text_hash = 'mine'").count() == kept.count() == len(ODD) - 2
    assert ngram_join.join(none).count() == ngram_join.keep_first(none).count() == 0


def test_band_shape():
    bands, rows = ngram_join.band_shape(0.8, 0.9995, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(draw.randrange(100), draw.randrange(100)) for _ in range(60)]
    up = {}
    for a, b in edges:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if a != b:
            both = up[a] | up[b]
            for k in both:
                up[k] = both
    want = {k: min(v) for k, v in up.items() if len(v) > 1}
    assert {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def changed(text, other):
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def neighbours(texts):
    ids = sorted(texts, reverse=True)
    return {k: ids[(i + 1) % len(ids)] for i, k in enumerate(ids)}


def test_op8_whole_table(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.op8_imatch(spark, sf).collect()}
    follows = neighbours(texts)
    assert rows.keys() == texts.keys()
    for k, r in rows.items():
        assert r.n_chars == len(texts[k])
        assert r.edited_sha256 == hashlib.sha256(changed(texts[k], texts[follows[k]]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == rows[follows[k]].fingerprint:
            assert r.near_next == 1
    by_text = {}
    for k, t in texts.items():
        by_text.setdefault(t, set()).add(rows[k].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.7 * len(rows)


def test_op8_fingerprint_against_plain(spark, texts):
    """The lexicon and its counts from a plain pass over all texts."""
    import math

    df = documents(spark, [(k, t, "en", "a") for k, t in texts.items()])
    split = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    plain = [(k, t) for k, t in texts.items() if t.isascii()]
    counts = {}
    for t in texts.values():
        for w in split(t):
            counts[w] = counts.get(w, 0) + 1
    band = {w for w, n in counts.items() if imatch.LEAST_IDF <= math.log(len(texts) / n) <= imatch.MOST_IDF}
    rows = {r.doc_id: r.fingerprint for r in imatch.fingerprints(df).collect()}
    same = {}
    for k, t in plain:
        same.setdefault(frozenset(split(t) & band) or (frozenset(split(t)), "all"), set()).add(rows[k].split(",")[0])
    assert all(len(v) == 1 for v in same.values())
    assert len({next(iter(v)) for v in same.values()}) == len(same)


@pytest.mark.parametrize("ids", [[5], [1, 2], [10**15, 3, -4, 0], list(range(0, 200_000, 7))[:6000] + [10**9, 10**9 + 1], [-(2**63), 0, 2**63 - 1], [0, *range(2**40, 2**40 + 3000), 2**62]])
def test_op8_next(spark, ids):
    texts = {k: f"text {k} {'x' * (k % 5)}" for k in ids}
    df = documents(spark, [(k, t, "en", "a") for k, t in texts.items()])
    got = {r.doc_id: r.next_text for r in imatch.with_next(df).where("guest = 0").collect()}
    assert got == {k: texts[n] for k, n in neighbours(texts).items()} if len(ids) > 1 else len(got) == 1


@pytest.mark.parametrize("kind", ["outlier", "nulls", "hot id", "repeated row"])
def test_op8_uneven_ids(spark, monkeypatch, kind):
    """No range gets more than a few times its share, and each row's next is the one by order, whatever the ids."""
    monkeypatch.setattr(imatch, "BUCKET", 64)
    monkeypatch.setattr(imatch, "CHUNK", 300)
    n = 4000
    rows = {
        "outlier": [(2**62 if i == 0 else i, f"text {i}") for i in range(n)],
        "nulls": [(None if i % 2 else i, f"text {i}") for i in range(n)],
        "hot id": [(7 if i % 3 == 0 else i, f"text {i}") for i in range(n)],
        "repeated row": [(7, "the same") if i % 3 == 0 else (i, f"text {i}") for i in range(n)],
    }[kind]
    df = imatch.with_next(documents(spark, [(k, t, "en", "a") for k, t in rows]).repartition(4))
    got = df.where("guest = 0").collect()
    per = Counter(r.bucket for r in got)
    assert sum(r.copies for r in got) == n and max(per.values()) < 6 * 64
    least = lambda k: -(2**63) if k is None else k
    order = sorted(set(rows), key=lambda r: -least(r[0]))
    ids, follow = [least(k) for k, _ in order], {}
    for r in got:
        follow.setdefault(least(r.doc_id), []).extend([(r.text, r.next_text)] * r.copies)
    texts = {}
    for k, t in rows:
        texts.setdefault(least(k), []).append(t)
    for at, k in enumerate(dict.fromkeys(ids)):
        after = list(dict.fromkeys(ids))[(at + 1) % len(set(ids))]
        mine, nexts = Counter(t for t, _ in follow[k]), Counter(x for _, x in follow[k])
        assert mine == Counter(texts[k])
        left = Counter(texts[k]) - nexts  # all of the id's texts but its first follow one of them, and its last is followed by the next id's first
        assert sum(left.values()) == 1 and sum((nexts - Counter(texts[k])).values()) == 1 and next(iter(nexts - Counter(texts[k]))) in texts[after]


def test_op8_odd_rows(odd, none):
    rows = imatch.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and all(r.fingerprint and r.edited_fingerprint for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1
    assert imatch.fingerprints(none).count() == 0


def test_op8_plan_is_native(odd):
    plan = imatch.fingerprints(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op5_differences(spark, monkeypatch):
    """Large components of near copies go as differences from one row: brute-force links, and far less sent than whole sets."""
    draw = random.Random(3)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 15)
    texts, key = {}, 0
    for group in range(3):
        words = [f"g{group}w{i}" for i in range(300)]
        for _ in range(70):
            own = list(words)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 7])):
                own[draw.randrange(300)] = f"x{draw.randrange(40)}"
            texts[key] = " ".join(own[: draw.choice([300, 300, 290, 250])])
            key += 1
    found = []
    whole = ngram_join.differences
    monkeypatch.setattr(ngram_join, "differences", lambda sets: (found.append(whole(sets)), found[-1])[1])
    assert joined(documents(spark, [(k, t, "en", "a") for k, t in texts.items()])) == brute(texts)
    r = found[0][1].groupBy().sum("weight", "n").first()
    assert found[0][1].select("component").distinct().count() == 3
    assert 3 * r[0] < r[1], r


def test_op5_difference_tells_intersections():
    draw = random.Random(4)
    for _ in range(50):
        base, *sets = [np.unique(np.array([draw.randrange(60) for _ in range(draw.randrange(40))], "uint64")) for _ in range(5)]
        apart, lacked = zip(*(ngram_join.difference(s, base) for s in sets), strict=True)
        near = ngram_join.similar(list(apart), None, 0.3, [len(s) for s in sets], lacked, len(base)) if len(base) else ngram_join.similar(sets, None, 0.3)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i != j and len(a) + len(b):
                    assert near[i, j] == (len(np.intersect1d(a, b)) >= 0.3 * len(np.union1d(a, b)) - 1e-9), (a, b, base)
