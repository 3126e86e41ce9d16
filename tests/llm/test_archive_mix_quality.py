"""WARC archives, source mixing, the quality classifier and the pipeline."""

import gzip
import hashlib
import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from conftest import documents
from odd_rows import ODD
from pyspark.sql import functions as F
from test_rules_and_spans import base_rules

from stratalite.llm import bpe, common, compression_quality, mixing, queries, warc

ROOT = Path(__file__).resolve().parents[2]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def archived(rows):
    most = {}
    for k, _, html in rows:
        most[html or ""] = max(most.get(html or "", k), k)
    for k, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 1000 and k != most[html or ""]
        yield k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", most[html or ""] if revisit else None


ROWS = [(1, "http://a/", "x" * 1000), (2, None, "x" * 1000), (3, "http://c c/\n", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "é", "é" * 700), (8, "u", "WARC/1.1 \r\n\r\n\x1f\u008b\x08" * 200), (9, "u", "y" * 3_000_000), (10, "u", "é" * 700)]


@pytest.mark.parametrize("size", [200, 5000, 64 << 20])
def test_op2_ranges(spark, size):
    got = sorted(tuple(r) for r in warc.archive_pages(pages(spark, ROWS).repartition(3), range_bytes=size).collect())
    assert got == sorted(archived(ROWS))


def test_op2_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in queries.op2_warc_archive(spark, sf).collect()) == Counter(archived(rows))


def test_op2_damage_and_repeats(spark, tmp_path):
    whole = [warc.record(k, f"http://{k}/", b"payload %d" % k * 40, None, "urn:page:", "1970-01-01T00:00:00Z") for k in range(20)]
    junk = bytes(random.Random(1).randrange(256) for _ in range(500)) + warc.MAGIC + b"no member" + gzip.compress(b"not a record")
    (tmp_path / "x.warc.gz").write_bytes(junk + b"".join(whole[:10]) + junk + whole[10][:60] + b"".join(whole[11:]))
    n = (tmp_path / "x.warc.gz").stat().st_size
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", n)], "path string, bytes long")
    for size in (64, 1000, 1 << 20):
        got = sorted(r.record_id for r in warc.read(spark, files, size).collect())
        assert got == sorted(warc.record_uri("urn:page:", k) for k in range(20) if k != 10)
    none = pages(spark, [])
    assert warc.archive_pages(none).count() == 0
    twice = [(None, "u", "z" * 2000), (3, "u", "z" * 2000), (3, "u", "z" * 2000)]
    assert Counter(r.record_type for r in warc.archive_pages(pages(spark, twice)).collect()) == {"response": 2, "revisit": 1}


def fill(total, children):
    """Water filling: (weight, capacity) by child."""
    out, open_, left = dict.fromkeys(children, 0.0), {k for k, (w, _) in children.items() if w > 0}, total
    while open_ and left > 1e-9:
        level = left / sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] <= level * children[k][0]}
        if not full:
            return out | {k: level * children[k][0] for k in open_}
        for k in full:
            out[k] = children[k][1]
            left -= children[k][1]
        open_ -= full
    return out


def plan(leaves, total, weights, epochs):
    """Budget of each leaf (domain, lang, source) from its tokens."""
    budget = {(): total}
    for depth, level in enumerate(mixing.LEVELS):
        capacity = defaultdict(float)
        for leaf, tokens in leaves.items():
            capacity[leaf[: depth + 1]] += tokens * epochs
        after = {}
        for parent, b in budget.items():
            mine = {k: (weights.get((level, k[-1]), 1.0), c) for k, c in capacity.items() if k[:-1] == parent}
            after |= fill(b, mine)
        budget = after
    return budget


def test_op9_budgets_and_prefixes(spark, docs):
    rows = {r.row: r for r in common.written(mixing.with_tree(docs), "t").collect()}
    tokens = defaultdict(int)
    for r in rows.values():
        tokens[r.domain, r.lang, r.source] += r.n_tokens
    chosen = mixing.mix(docs).collect()
    p = mixing.PRODUCTION
    want = plan(tokens, p["total_share"] * sum(tokens.values()), p["weights"], p["epochs"])
    size = {r.doc_id: r.n_tokens for r in rows.values()}
    per = defaultdict(list)
    for r in chosen:
        assert r.n_tokens == size[r.doc_id]
        per[r.domain, r.lang, r.source].append(r)
    for leaf, budget in want.items():
        mine = [r for r in rows.values() if (r.domain, r.lang, r.source) == leaf and r.n_tokens]
        expect = []
        for epoch in range(p["epochs"]):
            allowed, at = min(tokens[leaf], budget - epoch * tokens[leaf]), 0
            order = sorted(mine, key=lambda r: hashlib.md5(f"{p['seed']}|{epoch}|{r.key}".encode()).hexdigest())  # noqa: B023
            for r in order:
                if allowed > 1e-6 and (at + r.n_tokens / 2 <= allowed + 1e-6):
                    expect.append((r.doc_id, epoch))
                at += r.n_tokens
        assert sorted((r.doc_id, r.epoch) for r in per[leaf]) == sorted(expect), leaf
    used = sum(r.n_tokens for r in chosen)
    assert abs(used - p["total_share"] * sum(tokens.values())) < len(want) * max(size.values())


def test_op9_tokens_are_real(spark, docs, texts):
    import public_tokenizers

    count = mixing.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    long = ["a" * 5000, "word " * 5000, " " * 5000, "x" + "日本" * 4000, "\n" * 3500 + "a", "12" * 2000 + "é"]
    df = documents(spark, [(k, t, "en", "a") for k, t in enumerate(long)])
    for table, source in ((docs, texts), (df, dict(enumerate(long)))):
        want = {r.doc_id: r.n_tokens for r in bpe.encode(table, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
        assert {r.doc_id: r.n_tokens for r in mixing.with_tree(table).collect()} == want == {k: count(t) for k, t in source.items()}


def test_op9_rows_that_repeat(spark, monkeypatch):
    """Of rows with one id and text, as many are chosen as the budget has room for, and they are spread over the order."""
    monkeypatch.setattr(mixing, "MANY", 50)
    rows = [(7, "the same row again and again", "en", "a")] * 400 + [(None, "no id", "en", "a")] * 60 + [(i, f"text {i}", "en", "a") for i in range(1000, 1100)]
    df = documents(spark, rows).repartition(4)
    total = sum(r.n_tokens for r in mixing.with_tree(df).collect())
    chosen = mixing.mix(df, total_share=0.5, epochs=1).collect()
    assert abs(sum(r.n_tokens for r in chosen) - total / 2) < 10 and len({r.order for r in chosen}) == len(chosen)
    kept = mixing.with_tree(mixing.keep_chosen(df, total_share=0.5, epochs=1)).collect()
    assert abs(sum(r.n_tokens for r in kept) - total / 2) < 10 and 150 < sum(r.doc_id == 7 for r in kept) < 250
    ranges = Counter(r.order[0] for r in chosen)
    assert max(ranges.values()) < 0.4 * len(chosen)


def test_op9_odd_rows(odd, none):
    kept = mixing.keep_chosen(odd, total_share=1.0, epochs=1)
    assert kept.columns == odd.columns and kept.where("epoch = 'mine'").count() == kept.count() == sum(1 for _, t, *_ in ODD if t)
    assert mixing.mix(none).count() == mixing.keep_chosen(none).count() == 0


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_compression_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.8, auc


def test_op7_only_learns_from_the_rest(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(compression_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression_quality.train(docs, labels) == compression_quality.train(docs, flipped)


def test_op7_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = compression_quality.train(odd, labels)
    assert compression_quality.score(odd, model).count() == len(ODD)
    assert compression_quality.score(none, compression_quality.train(none, labels.where("false"))).count() == 0


def test_pipeline(spark, sf, docs, odd):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "personal_data", "source_mix", "encode"]
    now, kept = docs, None
    for name, stage in c.STAGES[:-1]:
        after = common.written(stage(spark, now, sf), "test-stage")
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        before = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
        assert ids <= set(before)
        if name == "quality":
            assert all(base_rules(before[k])[-1] is False for k in ids)
        if name == "near_duplicates":
            from test_similar import brute

            assert ids == {k for k, (_, first) in brute(before).items() if k == first}
        if name == "personal_data":
            assert ids == set(before) and after.where("text rlike '[a-z]@[a-z]+[.][a-z]'").count() == 0
        now, kept = after, ids
    out = {r.doc_id: r for r in c.run(spark, sf).collect()}
    assert set(out) == kept
    text = {r.doc_id: r.text for r in now.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[k].encode()).hexdigest() for k, r in out.items())


def test_pipeline_odd_rows(spark, sf, odd):
    """What becomes of nulls, empty and very long texts and repeated rows in each stage."""
    import corpus_pipeline as c

    ids = sorted((i for i, *_ in ODD), key=str)
    stages = dict(c.STAGES)
    kept = {name: stage(spark, odd, sf) for name, stage in stages.items()}
    found = {name: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str) for name, df in kept.items()}
    assert found["quality"] == []  # all have fewer than twenty words or repeat theirs
    assert found["near_duplicates"] == sorted({i for i in ids if i != 7}, key=str)  # 7 is a copy of 6, whose row is there twice
    assert found["personal_data"] == found["encode"] == ids
    texts = {(i, t) for i, t, *_ in ODD}
    masked = {(r.doc_id, r.text) for r in kept["personal_data"].collect()}
    assert {x for x in masked if x[0] != 8} == {x for x in texts if x[0] != 8} and (8, "mail me at <EMAIL> or <PHONE>") in masked
    chosen = Counter(found["source_mix"])
    assert not chosen - Counter(i for i, t, *_ in ODD if t) and chosen
    tokens = {r.doc_id: r.n_tokens for r in kept["encode"].collect()}
    assert tokens[1] == tokens[2] == 0 and tokens[6] == tokens[7] == 4 and tokens[5] > 90_000
    for name, df in kept.items():
        assert name == "encode" or df.columns == odd.columns
    assert all(stage(spark, odd.where("false"), sf).count() == 0 for stage in stages.values())


def test_rest_works_without_this_package(tmp_path):
    import shutil

    for p in ("__spark_entry__.py", "stratalite"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "stratalite" / "llm")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_op2_ranges_are_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS key", "concat('http://', id) AS uri", "cast(repeat(sha2(cast(id AS string), 512), 10) AS binary) AS payload", "cast(null AS long) AS refers_to").repartition(4)
    files = warc.write(rows, f"file://{tmp_path}/many")
    got = warc.read(spark, files, range_bytes=16384).groupBy(F.spark_partition_id().alias("task")).count().collect()
    ranges = sum(-(-r.bytes // 16384) for r in files.collect())
    assert ranges > 50 and sum(r["count"] for r in got) == 3000
    assert len(got) > 0.8 * ranges and max(r["count"] for r in got) < 3000 / 10


def test_op2_odd_rows(spark):
    odd = pages(spark, ROWS + [(None, None, None)]).withColumns({c: F.lit("mine") for c in ("payload", "key", "uri", "refers_to", "_same", "path", "record_type")})
    got = warc.archive_pages(odd)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and got.count() == len(ROWS) + 1
