"""Searches and near-duplicates against brute force."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import ann, neardup, topk


def vectors():
    rng = np.random.default_rng(4)
    far = rng.standard_normal((3000, 24))
    near = rng.standard_normal(24) + 0.05 * rng.standard_normal((1500, 24))
    return np.concatenate([far, near, far[:5]]) * rng.uniform(0.3, 3, (4505, 1))


def recall(spark, x, step, k=20, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = {}
    for r in ann.nearest(df, "v", F.col("vec_id") % step == 0, k, **how).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    for i in range(0, len(x), step):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len({v for v, _ in got[i].values()} & set(np.argsort(-s)[:k].tolist()))
        assert all(np.isclose(score, x[v] @ x[i]) and v != i for v, score in got[i].values())
    return hit / (k * len(got))


def test_collision_counting_of_mixed_lengths(spark):
    assert recall(spark, vectors(), 100, numbers=60_000) >= 0.9


def test_collision_counting_of_one_length(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 32)) + 1.5 * rng.standard_normal((40, 32))[rng.integers(0, 40, 20_000)]
    assert recall(spark, x / np.sqrt((x * x).sum(axis=1, keepdims=True)), 200) >= 0.9


def test_collisions_are_counted_in_every_class(monkeypatch):
    """No class is searched in another way: each query asks the sorted arrays of each class, small or large."""
    calls = []
    real = ann.Sorted.candidates
    monkeypatch.setattr(ann.Sorted, "candidates", lambda self, at, many: calls.append((self.n, many)) or real(self, at, many))
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    index = ann.Collisions(np.arange(700), x)
    assert len(index.classes) == 1  # lengths of one up to rounding are one class
    index(0, x[0], 3)
    assert calls == [(700, ann.SPARE * 3 + 70)]
    many = ann.Collisions(np.arange(700), x * np.repeat([1.0, 2.0, 5.0, 1e-200, 1e200], 140)[:, None])
    calls.clear()
    for q in (x[0], x[0] * 1e-200, x[0] * 1e300, np.r_[5e-324, np.zeros(7)]):
        assert len(many(-1, q, 3)[0]) == 3
    assert len(calls) == 4 * len(many.classes) == 20


def test_exact_search(spark):
    x = vectors()
    whole = np.floor(64 * x).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(whole)], "vec_id long, v array<long>")
    exact = {}
    for r in topk.top(df.union(df.where("vec_id < 30")), "v", F.col("vec_id") % 100 == 0, 10, numbers=60_000).collect():
        exact[(r.query_id, r.rank)] = (r.vec_id, r.score)
    for i in range(0, len(x), 100):
        s = whole @ whole[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)).tolist() if j != i][:10]
        assert [exact[(i, k + 1)] for k in range(10)] == [(j, int(s[j])) for j in order]
    big = topk.Buckets(np.arange(3), np.array([[2**62, 1], [2**62, 3], [-(2**62), 5]]))
    assert big(-1, np.array([1, 1]), 2)[0].tolist() == [1, 0]


def test_classes(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(8, 200))]
        for _ in range(rnd.randint(1, 12)):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 40))):
                t[rnd.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(40)]) for _ in range(40)] + texts[:7]
    got = {r.doc_id: r.class_id for r in neardup.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seqs = [neardup.kmers(h) for h in neardup.word_hashes(texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or neardup.similarity(seqs[i], seqs[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert got == {i: r for i, r in enumerate(root)}


def test_star_of_copies(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefgh", k=8))
    texts = []
    for size in (120, 40):
        base = [word() for _ in range(304)]
        texts.append(" ".join(base))
        for _ in range(size):
            t = list(base)
            for i in rnd.sample(range(6, 298, 6), 6):
                t[i] = word()
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seqs = [neardup.kmers(h) for h in neardup.word_hashes(texts)]
    assert all(neardup.similarity(seqs[0], x) >= 0.8 for x in seqs[:121]) and neardup.similarity(seqs[1], seqs[2]) < 0.8
    nodes = {bytes(r.node): r.doc_id for r in neardup.nodes_of(df).join(df, "text").collect()}
    for limit in (neardup.LIMIT, 8):  # one group a bucket; finer buckets and blocks
        root = {nodes[bytes(r.node)]: bytes(r.root) for r in neardup.classes(df, limit=limit).collect()}
        assert len(root) == len(texts) and len({root[i] for i in range(121)}) == len({root[i] for i in range(121, len(texts))}) == 1
        assert root[0] != root[121]


def table(a, b, band):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + 1 if x == y and abs(i - j) <= band else 0))
        row = new
    return row[-1]


def test_alignment_against_table(monkeypatch):
    rnd = random.Random(5)
    for cell in (2048, 4):
        monkeypatch.setattr(neardup, "CELL", cell)
        for _ in range(300):
            a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(1, 24))] for _ in "ab")
            for band in (0, 1, 3, 99):
                assert neardup.banded(a, b, band) == table(a, b, band)
            monkeypatch.setattr(neardup, "BAND", rnd.choice([1, 2, 64]))
            x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
            want = table(a, b, 99)
            assert neardup.aligned(x, y, 99) == want
            assert (neardup.aligned(x, y, 99, 5) >= 5) == (want >= 5)
            assert (neardup.similarity(x, y, 0.5) >= 0.5) == (want / (len(a) + len(b) - want) >= 0.5)


def test_long_texts_align_in_time():
    rnd = random.Random(3)
    words = [f"w{i % 997 % 100}" for i in range(200_000)]  # repetitive: no k-mer is unique
    edited = list(words)
    for i in rnd.sample(range(200_000), 4_000):
        edited[i] = f"x{i}"
    del edited[1000:1010]
    a, b = (neardup.kmers(h) for h in neardup.word_hashes([" ".join(words), " ".join(edited)]))
    began = time.time()
    assert neardup.similarity(a, b) >= 0.8
    assert time.time() - began < 6


def test_short_texts_meet():
    """Two texts of few k-mers at the threshold share two sketches and more."""
    rnd = random.Random(6)
    for n in (8, 9, 20, 36, 40, 44):
        for _ in range(40):
            base = [rnd.randint(0, 10**9) for _ in range(n)]
            a, b = (neardup.sketch(np.array(x, dtype=np.uint64)) for x in (base, base + [rnd.randint(0, 10**9) for _ in range(n // 4)]))
            assert ((a == b) & (a != 0)).sum() >= neardup.SHARED


def test_hot_keys_are_joined_apart(spark):
    texts = ["same words in all of them " * 3] * 20 + [f"other {i} " * 12 for i in range(5)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {tuple(r) for r in neardup.labelled(df).select("doc_id", "class_id", "class_size").collect()}
    assert whole == {tuple(r) for r in neardup.labelled(df, hot=3).select("doc_id", "class_id", "class_size").collect()}
    assert {(i, 0, 20) for i in range(20)} < whole and (25, 25, 1) in whole
