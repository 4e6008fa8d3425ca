"""Near copies lose no similar pair: short texts, lossless sketches, lists dealt into blocks; snapshots with a commit in between."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, near_copies, rollups, simhash


def sets(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_keep(pairs, firsts):
    """The least doc_id of each group that similar sets join, of the rows that fingerprints leave."""
    left = sorted((i, sets(t)) for i, t in pairs if i in firsts)
    root = {i: i for i, _ in left}
    for n, (i, a) in enumerate(left):
        for j, b in left[:n]:
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return sorted({*root.values()})


def kept(spark, pairs):
    table = common.materialize(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5), "docs")
    firsts = {r.doc_id for r in simhash.near_duplicates(table).where("doc_id = component_id").select("doc_id").collect()}
    return sorted(r.doc_id for r in near_copies.keep_one(table).collect()), brute_keep(pairs, firsts)


def test_all_pairs_of_short_texts(spark):
    r = random.Random(12)
    texts = ["w2262 w3782 w3359 w438 w1186 w2068 w3577 w3474 w3378", "w2262 w3782 w3359 w438 w1186 w2068 w3577 w3474", "q1 q2 q3 q4 q5 q6 q7 q8 q9", "q1 q2 q3 q4 q5 q6 q7 q8"]
    for _ in range(400):  # texts of 5 to 15 words, each with some that lack or change a word at an end or within
        w = [f"v{r.randrange(3000)}" for _ in range(r.randint(5, 15))]
        texts.append(" ".join(w))
        texts += [" ".join(x) for x in ([*w[:-1]], w[1:], [*w, "more"], [*w[:-2], "x", w[-1]]) if r.random() < 0.4]
    got, want = kept(spark, list(enumerate(texts)))
    assert got == want and 1 not in got and 3 not in got


@pytest.mark.parametrize("block", [4096, 3])
def test_lists_in_blocks(spark, block, monkeypatch):
    """Texts with much in common that are not similar, so that a list has many components."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(13)
    page = [f"p{k}" for k in range(40)]
    texts = [" ".join(page + [f"u{r.randrange(10**6)}" for _ in range(r.randint(10, 30))]) for _ in range(60)]
    texts += [t + " tail" for t in texts[:25]]
    got, want = kept(spark, list(enumerate(texts)))
    assert got == want and len(got) == 60


def test_sketches_lose_no_pair():
    """The least distance of counts never passes the symmetric difference, at all sizes, folded or not."""
    r = np.random.default_rng(14)
    for n in (1, 4, 5, 60, 499, 501, 700, 3000, 9000):
        for _ in range(40):
            a = r.integers(0, 1 << 64, n, np.uint64)
            k = int(r.integers(0, max(1, n // 5) + 1))  # so many go, and as many come
            b = np.unique(np.concatenate([a[k:], r.integers(0, 1 << 64, int(r.integers(0, k + 1)), np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            m, s = sorted((len(a), len(b)))
            if near_copies.UNDER * both >= near_copies.OVER * (m + s - both):
                x, y = (np.array(near_copies.sketch_of(c)) for c in (a, b))
                assert near_copies.alike(x[:1], x[1:], y[:1], y[1:], np.array([m]), np.array([s])).all()
                assert near_copies.may_be_alike(near_copies.large_sketch(a), near_copies.large_sketch(b), m, s)
        other = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        assert n < 4 or near_copies.may_be_alike(near_copies.large_sketch(a), near_copies.large_sketch(other), n, n) == (n <= near_copies.LARGE)


def test_large_texts(spark):
    r = random.Random(15)
    texts = []
    for k in range(12):
        w = [f"z{r.randrange(10**6)}" for _ in range(r.randint(1500, 2500))]
        texts.append(" ".join(w))
        for change in (0.01, 0.03, 0.1):
            texts.append(" ".join(f"y{r.randrange(10**6)}" if r.random() < change else x for x in w))
    got, want = kept(spark, list(enumerate(texts)))
    assert got == want and 12 < len(got) < 48


def test_snapshot_with_a_commit_in_between(spark, tmp_path, monkeypatch):
    batch = lambda n, tokens: spark.createDataFrame([(tokens,)] * n, "n long").select(F.lit("s").alias("source"), F.lit("en").alias("lang"), "n").select(F.lit(None).alias("before"), rollups.counted("t", F.col("n")).alias("after"))
    store = rollups.RollupStore(spark, f"file://{tmp_path}/r")
    assert store.commit("one", batch(1, 10))
    sums = store._sums

    def slow(batches, last):
        other.commit("two", batch(1, 7))  # another writer, between the list and the sums
        return sums(batches, last)

    other = rollups.RollupStore(spark, f"file://{tmp_path}/r")
    monkeypatch.setattr(store, "_sums", slow)
    assert store.snapshot() == 1
    monkeypatch.undo()
    total = lambda: [(r.n_docs, r.n_tokens) for r in store.totals().collect()]
    assert total() == [(2, 17)]
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda kind, *rest: other.snapshot() and publish(kind, *rest))  # another's snapshot comes first
    assert store.snapshot() == 0 and total() == [(2, 17)]
