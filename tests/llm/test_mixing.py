"""Targets against plain sharing, samples against what they must satisfy."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import mixing
from millrace.llm.queries import op6_mixing


def _docs(n=900, seed=1):
    rnd = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "a2", "zz"]
    return [(i, " ".join(["w"] * rnd.choice([0, 3, 20, 50, 50, 80, 300])), sources[min(int(rnd.expovariate(0.6)), 6)], "x") for i in range(n)]


def _plain_targets(rows):
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return dict(sizes), mixing.share_out(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))


def test_sharing():
    assert mixing.share_out({"a": 100, "b": 100}, {"a": 3, "b": 1}, 300) == {"a": 200.0, "b": 100.0}
    assert mixing.share_out({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 315) == pytest.approx({"a": 20, "b": 295 / 3, "c": 590 / 3})
    assert mixing.share_out({"a": 0, "b": 8}, {"a": 3, "b": 1}, 12) == {"a": 0.0, "b": 12.0}
    assert mixing.share_out({}, {}, 0) == {}


def test_query(spark, tmp_path):
    rows = _docs()
    spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_mixing(spark, str(tmp_path)).collect()
    sizes, targets = _plain_targets(rows)
    source = {i: s for i, _, s, _ in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, r.target) == (sizes[s], pytest.approx(targets[s]))
        whole = int(targets[s] / sizes[s])
        assert r.taken in (whole * r.size, (whole + 1) * r.size) and r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert len(got) == len(rows)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    again = op6_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_the_sample_is_the_lowest_pareto_ranks(spark):
    """Every document left out has a rank above every one taken."""
    rows = [(i, " ".join(["w"] * (1 + i % 60)), "s" if i % 4 else "t", "x") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    from pyspark.sql import functions as F

    got = mixing.mix(df).withColumn("u", mixing._uniform()).collect()
    for s in ("s", "t"):
        mine = [r for r in got if r.source == s]
        copies = mine[0].target / mine[0].source_size
        part, whole = copies - int(copies), int(copies)
        if part == 0:
            assert all(r.times == whole for r in mine)
            continue
        weight = {r.doc_id: r.size**mixing.POWER for r in mine}
        f = next(x.f for x in mixing._factor(df.select(F.col("source").alias("s"), F.size(F.split("text", " ")).cast("long").alias("size"), F.lit(part).alias("part"), F.lit(mine[0].source_size).alias("source_size")).where(F.col("s") == s), mixing.POWER).collect())
        p = {i: min(max(f * w, 1e-9), 1 - 1e-9) for i, w in weight.items()}
        rank = {r.doc_id: r.u / (1 - r.u) / (p[r.doc_id] / (1 - p[r.doc_id])) for r in mine}
        extra = {r.doc_id for r in mine if r.times > whole}
        assert extra and max(rank[i] for i in extra) <= min(rank[i] for i in rank if i not in extra)


def test_inclusion_grows_with_size(spark):
    rows = [(i, " ".join(["w"] * (5 if i % 2 else 80)), "a" if i % 3 else "b", "") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, x string"))
    share = {(r.source, r.size): r["avg"] for r in got.selectExpr("source", "size", "times - floor(target / source_size) as extra").groupBy("source", "size").avg("extra").withColumnRenamed("avg(extra)", "avg").collect()}
    for s in {k[0] for k in share}:
        assert share[s, 80] >= share[s, 5]


@pytest.mark.parametrize("part", [1.0, 1 / 3])
def test_repeated_rows_are_taken_as_far_as_needed(spark, tmp_path, part):
    """A source of one row repeated, or with a third of such rows: the target is met all the same."""
    n = 900
    rows = [(1 if i < n * part else i, " ".join(["w"] * (20 if i < n * part else 5 + i % 40)), "b", i) for i in range(n)]
    rows += [(10_000 + i, " ".join(["w"] * 30), "a", i) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, rid int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_mixing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t.split())) for i, t, _, _ in rows)
    for source in (0, 1):
        mine = [r for r in got if (r.doc_id >= 10_000) == bool(source)]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1
    again = op6_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_very_long_text_and_clashing_columns(spark):
    rows = [(i, " ".join(["w"] * (50_000 if i == 3 else 40)), "a" if i % 2 else None, "r", 7, 8) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, cut int, part int")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert got[3].size == 50_000 and mixing.mixed(df).columns == df.columns


def test_mixed_rows(spark):
    rows = _docs(200, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times string")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = {r.doc_id: r.times for r in mixing.mix(df).collect() if r.times}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want


def test_edges(spark, tmp_path):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (2, "", "s"), (None, "x y z", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = op6_mixing(spark, str(tmp_path / "a")).collect()
    assert len(got) == 5
    assert all(r.taken == 0 for r in got if r.size == 0)
    for n, frame in (("b", []), ("c", [(1, None, "s")])):
        spark.createDataFrame(frame, "doc_id long, text string, source string").write.parquet(str(tmp_path / n / "documents.parquet"))
        assert [r.taken for r in op6_mixing(spark, str(tmp_path / n)).collect()] == [0] * len(frame)
