"""Ranked search, the conversation trie and toxicity against brute force, SQL and held-out labels, and on edge cases."""

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from metrifold.llm import lexical, prefix_trie, toxicity
from metrifold.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@have
@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op12_conversation_prefix_trie"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = c.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(want)


# --- 11 ranked search ----------------------------------------------------------------------------------------------
def ranked(docs, items, best=10):
    counted = [(i, collections.Counter(lexical.terms_of((t or "").encode()))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total, df = len(counted), sum(x[2] for x in counted), collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in counted:
            m = 25 + (75 * size * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in collections.Counter(lexical.terms_of((text or "").encode())).items() if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:best], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("slice_, bundle, most", [(7, 2, 200_000), (4096, 256, 0), (3, 1, 0)])
def test_search_equals_full_scoring(spark, monkeypatch, slice_, bundle, most):
    """Small slices and bundles, and the way without a broadcast; copies give ties, and ids and items repeat or are null."""
    for name, value in (("SLICE", slice_), ("BUNDLE", bundle), ("MOST_TERMS", most), ("POSTINGS", 40)):
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(slice_)
    words = ["the"] * 30 + ["of"] * 9 + [f"W{i}" for i in range(40)] + ["été", "x9", "日本"]
    docs = [(i % 50, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(90)]
    docs += [docs[3], docs[3], (None, docs[4][1]), (60, None), (61, ""), (62, " .,"), (63, "the " * 3000 + "W1")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 12)))) for i in range(7)]
    items += [items[0], (None, "w1, W2 the"), (8, None), (9, ""), (10, "unheard")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("slice", F.lit("clash")).withColumn("term", F.lit("clash"))
    got = lexical.search(d, spark.createDataFrame(items, "item_id long, text string").withColumn("bundle", F.lit(1)))
    assert collections.Counter(map(tuple, got.collect())) == ranked(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [("i", 1, 1)]


# --- 12 prefix trie ------------------------------------------------------------------------------------------------
def trie(rows):
    def dig(r, t):
        return hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()

    turns = collections.defaultdict(list)
    for c, turn, r, t in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), dig(r or "", t or ""), r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    whole = {c: tuple(own.get(c - int(math.fmod(c, 5)), [])[: heads[c]] + own[c][heads[c] :]) for c in own}
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    ends = {n: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)) for n, m in members.items()}
    return collections.Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items())


@pytest.mark.parametrize("block, shard, chunk", [(4, 3, 2), (4096, 10, 5), (3, 1000, 8192)])
def test_trie_equals_brute_force(spark, monkeypatch, block, shard, chunk):
    """Several levels of blocks, shards of few turns (so that long prefixes are shared), copies, ties, nulls and turnless conversations."""
    for name, value in (("BLOCK", block), ("SHARD", shard), ("CHUNK", chunk), ("SEGMENT", 3)):
        monkeypatch.setattr(prefix_trie, name, value)
    rnd = random.Random(block)
    rows = [(c if c else None if rnd.random() < 0.3 else 0, None if rnd.random() < 0.1 else rnd.randrange(12), rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None, "é" * rnd.randrange(3)])) for c in range(-6, 20) for _ in range(rnd.randrange(1, 12))]
    rows += [(c, i, "s", str(min(i, 4 + c % 2))) for c in range(40, 56) for i in range(9)] + [(12, 3, "a", "x")] * 3
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("dig", F.lit("clash")))
    assert collections.Counter(map(tuple, got.collect())) == trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_double_array():
    rnd = random.Random(3)
    many = [np.array([rnd.randrange(60) if rnd.random() < 0.5 else rnd.randrange(3) for _ in range(rnd.randrange(7))], np.int64) for _ in range(800)]
    t = prefix_trie.DoubleArray(many)
    slots = {(): 0}
    for ids in many:
        for d in range(len(ids)):
            slots[tuple(ids[: d + 1])] = t.step(slots[tuple(ids[:d])], int(ids[d]))
    assert len(set(slots.values())) == len(slots) == len(t.slots)
    for path, slot in slots.items():
        for kid in {*range(61)} - {p[-1] for p in slots if len(p) == len(path) + 1 and p[:-1] == path}:
            with pytest.raises(KeyError):
                t.step(slot, kid)


# --- 13 toxicity ---------------------------------------------------------------------------------------------------
def _said(rnd, toxic):
    words = [rnd.choice(["the", "and", "river", "stone", "light", "over"]) for _ in range(rnd.choice([3, 30, 400]))]
    for _ in range(len(words) // 20 + 2 if toxic else 0):
        words[rnd.randrange(len(words))] = rnd.choice(["vilefool", "grunchoo", "grunchax", "grunchil"])
    return " ".join(words)


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    """Positives are few, the unlabelled hold others; the held-out third is told by words that it shares, and by a beginning."""
    rnd = random.Random(5)
    toxic = {i: rnd.random() < 0.15 for i in range(900)}
    docs = [(i, _said(rnd, t)) for i, t in toxic.items()] + [(1000, None), (1001, ""), (1002, "grunchun grunchep river stone"), (1002, "grunchun grunchep river stone"), (None, "river")]
    labels = [(i, int(t)) for i, t in toxic.items() if i % 2] + [(None, 1), (5, None), (7777, 1)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("side", F.lit(9)), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(d, l).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in docs if i is not None}
    held = [(toxic[r.doc_id], r.predicted) for r in got if r.doc_id in toxic and r.held_out]
    assert sum(t != p for t, p in held) <= 0.01 * len(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.predicted, r.score))
    assert len(by[1002]) == 1 and {p for p, _ in by[1002]} == {1} and by[1000] == by[1001] and {p for p, _ in by[1000] | by[None]} == {0}


def test_held_out_labels_do_not_move_scores(spark):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, _said(rnd, i % 6 == 0)) for i in range(150)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(150)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted(map(tuple, toxicity.score(docs, x, steps=3).collect())) for x in (labels, turned))
    assert [r[:2] for r in first] == [r[:2] for r in second] and np.allclose([r[2] for r in first], [r[2] for r in second], atol=1e-9)


def test_sums_equal_one_matrix(spark, monkeypatch):
    """Gradients that Spark adds over packed chunks are those of the whole matrix."""
    monkeypatch.setattr(toxicity, "CHUNK", 4)
    rnd = random.Random(8)
    docs = [(rnd.choice([-1, -1, 0, 1, 2]), " ".join(rnd.choice("abcdefgh") * 2 for _ in range(rnd.randrange(6)))) for _ in range(60)]
    hashes = np.array(sorted({zlib.crc32((c * 2).encode()) for c in "abcdef"}))
    design = toxicity._design(spark.createDataFrame(docs, "side int, text string").repartition(3), hashes)
    w = np.random.default_rng(1).normal(size=(len(hashes) + 1, toxicity.FOLDS))
    got = toxicity._sums(design, w)
    at = {int(h): i for i, h in enumerate(hashes)}
    x = np.zeros((len(docs), len(hashes) + 1))
    x[:, -1] = 1
    for i, (_, text) in enumerate(docs):
        for word, tf in collections.Counter(text.split()).items():
            if zlib.crc32(word.encode()) in at:
                x[i, at[zlib.crc32(word.encode())]] = tf / (tf + 1 + len(text.split()) / 100)
    side = np.array([s for s, _ in docs])
    for k in range(toxicity.FOLDS):
        u, p = x[side < 0], x[(side >= 0) & (side != k)]
        s = 1 / (1 + np.exp(-u @ w[:, k]))
        assert np.allclose(got["gradient"][:, k], u.T @ s, atol=1e-5) and np.isclose(got["risk"][k], np.logaddexp(0, u @ w[:, k]).sum(), atol=1e-4)
        assert np.allclose(got["curve"][:, k], u.T @ (s * (1 - s) * u.sum(axis=1)), atol=1e-5)
        assert np.allclose(got["gradient_p"][1][:, k], p.sum(axis=0), atol=1e-5) and got["n"][:, k].tolist() == [len(u), len(p)]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.score(docs, none).collect()] == [(0.0, 0)] * 2
    assert toxicity.score(docs.where("false"), none).count() == 0
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, only, steps=2).count() == 2


@have
def test_toxicity_on_held_out_rows(spark):
    sf = DATA.replace("0.001", "0.01")
    scored = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = scored.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted for r in rows if not r.toxic) == 0
    assert sum(r.predicted for r in rows if r.toxic) >= 0.8 * sum(r.toxic for r in rows)
