"""The SimHash index of the near-duplicate stage against plain comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from millrace.llm import similar

from .test_minhash import stay


def _flipped(rnd, words, n):
    out = words.copy()
    for b in rnd.sample(range(similar.BITS), n):
        out[b // 64] ^= np.uint64(1 << b % 64)
    return out


def _fingerprints(most):
    """Unrelated ones, and families of which some are chains."""
    rnd = random.Random(7)
    own = lambda: np.array([rnd.getrandbits(64) for _ in range(similar.BITS // 64)], np.uint64)
    fps = [own() for _ in range(60)]
    for size in (2, 3, 25):
        centre = own()
        fps += [_flipped(rnd, centre, rnd.randint(1, most)) for _ in range(size)]
    return fps


def _meet(x, y):
    """A segment is the same but for one bit, and so are the verified words but for MAX_DISTANCE."""
    segments = np.bitwise_count((x ^ y).view(np.uint16)) <= 1
    return segments.any() and np.bitwise_count(x ^ y)[: similar.VERIFIED].sum() <= similar.MAX_DISTANCE


@pytest.mark.parametrize("most", [20, 90, 130])
def test_what_meets_is_compared(spark, most):
    """Without links of texts before, all that meets is a candidate."""
    fps = _fingerprints(most)
    df = spark.createDataFrame([(k, k, x.view(np.int64).tolist(), []) for k, x in enumerate(fps)], "fp long, comp long, bits array<long>, less array<long>")
    together = {(min(r), max(r)) for r in similar.indexed(df).collect()}
    want = {(a, b) for b, y in enumerate(fps) for a, x in enumerate(fps[:b]) if _meet(x, y)}
    assert want and want <= together
    assert all(a >= 60 for a, _ in together)  # unrelated ones stay alone


def test_groups_are_compared_by_the_nearest_text():
    fp, comp = np.arange(5), np.array([7, 8, 7, 9, 7])
    words = np.array([0, 0b111, 0b11, 0b1100, 0b1000], np.uint64)[:, None]
    a, b = similar._nearest(fp, comp, words, 3)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (4, 3), (1, 3)]


def test_clusters_are_the_same_by_both_ways():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 2**64, (12, similar.VERIFIED), dtype=np.uint64)
    at = np.sort(rnd.integers(0, 1 << 9, 700))  # two groups
    words = centres[rnd.integers(0, 12, 700)] ^ np.uint64(1) << rnd.integers(0, 64, (700, similar.VERIFIED), dtype=np.uint64)
    plain = np.arange(700)
    for i in range(700):
        for j in range(i):
            if at[i] >> 8 == at[j] >> 8 and int(at[i] ^ at[j]).bit_count() <= 1 and np.bitwise_count(words[i] ^ words[j]).sum() <= similar.MAX_DISTANCE:
                plain[plain == max(plain[i], plain[j])] = min(plain[i], plain[j])
    assert (similar.clusters(at, words) == plain).all()
    for group in (0, 1):
        rows = np.flatnonzero(at >> 8 == group)
        assert (rows[0] + similar._dense(at[rows], words[rows]) == plain[rows]).all()


def test_a_group_of_copies_is_searched(monkeypatch):
    at, words = np.zeros(3000, np.int64), np.zeros((3000, similar.VERIFIED), np.uint64)
    called = []
    dense = similar._dense
    monkeypatch.setattr(similar, "_dense", lambda *a: called.append(a) or dense(*a))
    assert (similar.clusters(at, words) == 0).all() and len(called) == 1


def test_groups_across_batches():
    fps = [0, 0, 0, 2**40 - 1, 1, 1]
    rows = [(at, k, k // 5, *[fps[k]] * similar.VERIFIED) for k, at in enumerate((256, 256, 257, 258, 512, 513))]  # all of the first bucket are of one group
    names = ["at", "fp", "comp", *"abcd"]
    for cuts in ((0, 6), (0, 1, 2, 3, 4, 5, 6), (0, 4, 4, 6), (0, 5, 6)):
        parts = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[s:e]], pa.int64()) for c in range(len(names))], names=names) for s, e in zip(cuts, cuts[1:], strict=False)]
        got = []
        for b in similar._buckets(iter(parts), every=True):
            for r in b.to_pylist():
                got.append({r["a"], r["b"]})
        assert got == [{4, 5}]


def test_fingerprint_counts_all_shingles():
    hashes = np.random.default_rng(1).integers(0, 2**64, 700, dtype=np.uint64)
    ones = np.zeros(similar.BITS, int)
    for h in hashes:
        one = similar.fingerprint(np.array([h]))
        ones += np.unpackbits(one.view(np.uint8), bitorder="little")
    assert (np.unpackbits(similar.fingerprint(hashes).view(np.uint8), bitorder="little") == (2 * ones > 700)).all()
    assert not similar.fingerprint(hashes[:0]).any()


def test_small_sets_that_differ_by_a_shingle(spark):
    """Majorities of four or five are close, so fingerprints alone miss some of these."""
    rows = [(10 * k + n, " ".join(f"w{k}x{i}" for i in range(n))) for k in range(500) for n in (8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in pipeline.distinct(spark, docs, "").collect()) == [10 * k + 8 for k in range(500)]


def test_the_stage_links_by_the_index(spark, monkeypatch):
    """Near duplicates come by the deletion-variant index of SimHash, and only by it."""
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(900)}" for _ in range(120)]
    rows = [(k, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(0, 100, 9)] + [(500, "quite another text of a few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.distinct(spark, docs, "").collect()) == [0, 500]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(similar, "indexed", lambda *a, **k: none)
    assert pipeline.distinct(spark, docs, "").count() == len(rows)


def _variants(seed, n, length, changes):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rnd.sample(range(length), rnd.choice(changes)):
            own[at] = f"n{k}x{at}"
        rows.append((k, " ".join(own), ""))
    return rows


@pytest.mark.parametrize("changes", [[4], [0, 1, 2, 3, 4]])
def test_candidates_grow_with_the_texts_of_a_group(spark, monkeypatch, changes):
    """Two texts of four changed words each are near by their bits, but seldom alike by 0.8."""
    rows = _variants(4, 300, 200, changes)
    counts = []
    indexed = similar.indexed

    def counted(*a, **k):
        out = indexed(*a, **k)
        counts.append(out.count())
        return out

    monkeypatch.setattr(similar, "indexed", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3)
    got = {r.doc_id for r in pipeline.distinct(spark, docs, "").collect()}
    assert got == stay(rows)
    assert sum(counts) <= 2 * similar.FIRST * 2 * len(rows)  # not 300 * 299 / 2


def test_large_classes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 20_000)
    rows = _variants(9, 120, 100, [1, 2, 3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3)
    got = {r.doc_id for r in pipeline.distinct(spark, docs, "").collect()}
    assert got == stay(rows) and 1 < len(got) < len(rows)


def test_forest_joins_all_that_is_linked():
    rng = np.random.default_rng(6)
    for n in (2, 3, 40, 200):
        base = rng.integers(0, 2**64, (4, 40), dtype=np.uint64)
        sets = [np.unique(np.r_[rng.permutation(base[rng.integers(4)])[: rng.integers(32, 41)], rng.integers(0, 2**64, rng.integers(0, 5), dtype=np.uint64)]) for _ in range(n)]
        sets[0] = sets[0][:0]
        root = np.arange(n)
        for x in range(n):
            for y in range(x):
                if similar.jaccard(sets[x], sets[y]) >= similar.SIMILARITY:
                    root[root == max(root[x], root[y])] = min(root[x], root[y])
        links = similar.forest(sets)
        joined = similar._merged(np.arange(n), np.array([x for x, _ in links], int), np.array([y for _, y in links], int))
        assert (joined == root).all() and len(links) == n - np.unique(root).size
