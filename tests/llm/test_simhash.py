"""Near duplicates against brute force, also through the finer index levels."""

from __future__ import annotations

import random
from functools import partial

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.queries import op10_simhash
from millrace.llm.simhash import GROUP_CAP, _finer, _link_groups, _variants, connected, deduplicate, fingerprint, links, spanning_links


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    rows = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in rows]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def components(fps):
    """Smallest index of each one's component."""
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one TWO", "a b c", "The cat sat on the mat. The cat sat.", "É é\x1cx a b c d"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(str(i * 7 % 101) for i in range(500))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert fingerprint(text) == plain_fingerprint(text)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _near(rnd, centre, n, most):
    """Distinct fingerprints around a centre."""
    out = set()
    while len(out) < n:
        x = centre
        for b in rnd.sample(range(64), rnd.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("cap", [GROUP_CAP, 20, 4])
def test_links_join_all_that_is_near(spark, cap):
    """A small cap sends dense groups through both finer levels."""
    rnd = random.Random(5)
    fps = sorted({*_near(rnd, rnd.getrandbits(64), 150, 5), *_near(rnd, rnd.getrandbits(64), 40, 3), *[rnd.getrandbits(64) for _ in range(100)], 0, (1 << 64) - 1})
    df = spark.createDataFrame([(_signed(x),) for x in fps], "fp long")
    found = connected(links(df, cap=cap))
    roots = {r.node: r.root for r in found.collect()}
    got = [roots.get(_signed(x), _signed(x)) for x in fps]
    want = components(fps)
    groups = {}
    for g, w in zip(got, want, strict=True):
        assert groups.setdefault(w, g) == g
    assert len(set(got)) == len(set(want))


def test_finer_levels_keep_every_near_pair_together(spark):
    rnd = random.Random(9)
    pairs = []
    for _ in range(60):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((_signed(a), _signed(b)))
    rows = _variants(spark.createDataFrame([(x,) for p in pairs for x in p], "fp long"))
    for level in (1, 2, 3):
        keyed = {}
        for r in rows.collect():
            keyed.setdefault(r.fp, set()).add((r.key, r.sub))
        assert all(keyed[a] & keyed[b] for a, b in pairs), level
        if level < 3:
            shared = [(a, k) for a, b in pairs for k in sorted(keyed[a] & keyed[b])]
            both = [(*k, x) for (a, k), b in [((a, k), b) for a, b in pairs for k in sorted(keyed[a] & keyed[b])] for x in (a, b)]
            assert shared
            rows = _finer(spark.createDataFrame(sorted(set(both)), "key long, sub long, fp long"), level + 1)


def test_spanning_links_are_a_forest():
    rnd = random.Random(3)
    fps = _near(rnd, rnd.getrandbits(64), 200, 4)
    got = spanning_links(np.array(fps, dtype=np.uint64).view(np.int64))
    assert len(got) == len(fps) - len(set(components(fps)))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in got)


def test_groups_across_batches():
    import pyarrow as pa

    rows = [(1, 0, 5), (1, 0, 7), (2, 0, 9), *[(3, 0, 1 << k) for k in range(6)], (4, 0, 1), (4, 0, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(3)], names=["key", "sub", "fp"]) for part in (rows[:1], rows[1:5], rows[5:8], rows[8:])]
    out = [r for b in _link_groups(iter(batches), cap=4) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in out if r["key"] is None} == {(5, 7), (1, 3)}
    assert sorted(r["a"] for r in out if r["key"] == 3) == [1 << k for k in range(6)]


def test_connected_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(30)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def _docs():
    rnd = random.Random(11)
    base = " ".join("w%d" % rnd.randrange(400) for _ in range(300))
    texts = [base] * 5 + [base.replace("w1 ", f"v{k} ", 1) for k in range(6)] + [f"other text number {k} " * 3 for k in range(10)] + [None, "", " ", "One word", "one WORD"]
    return [(1000 - k, t, "x") for k, t in enumerate(texts)] + [(1000, base, "x"), (None, base, "x"), (None, "alone here now", "x")]


def test_query_against_brute_force(spark, tmp_path):
    rows = _docs()
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op10_simhash(spark, str(tmp_path)).collect()), key=repr)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want_root = components(fps)
    least = {}
    for (doc, _, _), r in zip(rows, want_root, strict=True):
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    assert got == sorted(((d, f"{f:016x}", least[r]) for (d, _, _), f, r in zip(rows, fps, want_root, strict=True)), key=repr)


def test_deduplicate_keeps_one_of_each(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    kept = deduplicate(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    roots = components([plain_fingerprint(t) for _, t, _ in rows])
    assert kept.count() == len(set(roots))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op10_simhash(spark, str(tmp_path)).count() == 0
    assert partial(deduplicate)(spark.createDataFrame([], "doc_id long, text string")).count() == 0
