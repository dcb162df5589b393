"""The near-duplicate stage against brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline


def _set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def stay(rows):
    sets = [_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (not x and not y) or (x and y and len(x & y) / len(x | y) >= 0.8):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[k][0] for k in range(len(rows)) if top(k) == k}


def test_copies_at_the_threshold(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for n, changes in ((60, 1), (60, 2), (200, 4), (200, 6), (600, 12)):
        for _ in range(16):
            own = rnd.choices(words, k=n)
            texts.append(" ".join(own))
            near = list(own)
            for at in rnd.sample(range(n), changes):
                near[at] = "changed"
            texts.append(" ".join(near))
    long = rnd.choices(words, k=100)
    texts += [" ".join([*long[:k], "other", *long[k + 1 :]]) for k in range(0, 100, 3)]  # a group of near copies
    shared = rnd.choices(words, k=70)
    texts += [" ".join(shared + rnd.choices(words, k=30)) for _ in range(40)]  # alike, but not enough
    texts += ["", None, " \n", "a b", "A  b", "a b c", *[texts[0]] * 30]
    rnd.shuffle(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string").repartition(3)
    assert sorted(r.doc_id for r in pipeline.distinct(spark, docs, "").collect()) == sorted(stay(rows))
