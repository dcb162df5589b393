"""Nulls, empty inputs, partition counts and the fluent frame, on small frames."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import Agg, Cast, Condition, Ops, Reduce, Transform
from millrace.operators import Merge, MergePattern, concatenate, hash_partition, key_partition, order_by, range_bounds, range_partition, remap_partition
from millrace.plans import Frame, MergeSource
from millrace.sources import generate, read_csv, read_records, read_tokens
from millrace.streaming import run_available

SCHEMA = "k int, v string, x double"
ROWS = [(1, None, None), (1, "a", 1.0), (2, None, None), (None, "z", 2.0)]


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_groupby_is_global_and_counts_null(nulls, parts):
    got = Frame.of(nulls.repartition(parts)).groupby("k", [Agg.n_unique("v", "u"), Agg.sum("x", "s")]).df
    assert _rows(got) == sorted([(1, 2, 1.0), (2, 1, 0.0), (None, 1, 2.0)], key=repr)


def test_reduce_of_nothing(spark):
    got = Frame.of(spark.createDataFrame([], SCHEMA)).reduce([Reduce.n_unique("v", "u"), Reduce.sum("x", "s")]).df
    assert _rows(got) == [(0, 0.0)]


@pytest.mark.parametrize("parts", [1, 3])
def test_whole_partition_transforms(nulls, parts):
    df = nulls.repartition(parts)
    assert _rows(Transform.max("x", "k", "m")(df).select("k", "m")) == sorted([(1, 1.0), (1, 1.0), (2, None), (None, 2.0)], key=repr)
    assert _rows(Transform.n_unique("v", "k", "u")(df).select("k", "u")) == sorted([(1, 2), (1, 2), (2, 1), (None, 1)], key=repr)


def test_first_keeps_null_and_follows_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (2, 5, "c")], "k int, o int, v string")
    assert _rows(Frame.of(df).groupby("k", Agg.first("v", "f", "o")).df) == [(1, None), (2, "c")]
    assert Frame.of(df).groupby("k", Agg.first("v", "f")).df.count() == 2


def test_null_keys_never_match(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "k2 int, v string")
    for pattern in MergePattern:
        source = {0: MergeSource(b, "k2", pattern)}
        assert _rows(Frame.of(a).merge(source, Merge.join(0, "k", "k2")).df) == [(1, "x", "p"), (1, "x", "q")]
        assert _rows(Frame.of(a).merge(source, Merge.isin(0, "k", "k2")).df) == [(1, "x")]
    assert Frame.of(a).merge({0: MergeSource(b, "k2")}, Merge.join(0, "k", "k2")).df.columns == ["k", "v", "v_right"]


def test_concatenate_keeps_repeats_and_refuses_other_columns(spark):
    a = spark.createDataFrame([(1,)], "k int")
    assert _rows(concatenate(a, a)) == [(1,), (1,)]
    with pytest.raises(ValueError):
        concatenate(a, a.withColumnRenamed("k", "j"))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sort_puts_nulls_last_or_first(spark, parts):
    df = spark.createDataFrame([(2,), (None,), (1,), (1,)], "k int").repartition(parts)
    assert [r[0] for r in order_by(df, "k").collect()] == [1, 1, 2, None]
    assert [r[0] for r in Frame.of(df).sort("k", descending=True).df.collect()] == [None, 2, 1, 1]


def test_partitioning(spark):
    df = spark.range(1000)
    ids = hash_partition(df, "id", 4).select("id", F.spark_partition_id().alias("p"))
    assert ids.groupBy("id").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    ranges = range_partition(df, "id", 4).select(F.spark_partition_id().alias("p"), "id").groupBy("p").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    bounds = sorted((r.a, r.b) for r in ranges.collect())
    assert all(x[1] < y[0] for x, y in zip(bounds, bounds[1:], strict=False))
    assert [r.bound for r in range_bounds(df, "id", 4).orderBy("k").collect()] == pytest.approx([250, 500, 750], abs=5)
    keys = spark.createDataFrame([(" " * 10,), ("~" * 10,), ("P" * 10,)], "k string")
    assert [r[0] for r in keys.select(key_partition(F.col("k"), 10)).collect()] == [0, 9, 5]
    assert [r[0] for r in spark.range(8).select(remap_partition(F.col("id"), 8, 3)).collect()] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_csv_with_trailing_separator_and_header(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1|x|2.5|\n2|y||\n")
    at = dict(schema="a int, b string, c double", has_header=False, separator="|")
    assert _rows(read_csv(spark, str(tmp_path / "a.dat"), trailing_separator=True, **at)) == [(1, "x", 2.5), (2, "y", None)]
    (tmp_path / "bad.dat").write_text("1|x|2.5\n2|y|nonsense\n")
    with pytest.raises(Exception):  # noqa: B017
        read_csv(spark, str(tmp_path / "bad.dat"), **at).collect()
    assert _rows(read_csv(spark, str(tmp_path / "bad.dat"), mode="PERMISSIVE", **at)) == [(1, "x", 2.5), (2, "y", None)]
    (tmp_path / "b.csv").write_text("p,q\n1,2\n")
    assert read_csv(spark, str(tmp_path / "b.csv")).collect()[0].asDict() == {"p": "1", "q": "2"}
    assert read_csv(spark, str(tmp_path / "b.csv"), new_columns=["r", "s"]).columns == ["r", "s"]


def test_tokens(spark, tmp_path):
    (tmp_path / "t").write_text("a bb  ccc a\nd a ")
    assert [r[0] for r in read_tokens(spark, str(tmp_path / "t")).collect()] == ["a", "bb", "ccc", "a\nd", "a"]


def test_records_as_lines_and_as_bytes(spark, tmp_path):
    text = "".join(f"{k:010d}" + "  " + ("v%d" % k).ljust(86) + "\r\n" for k in (3, 1, 2))
    (tmp_path / "r").write_bytes(text.encode())
    for binary in (False, True):
        got = read_records(spark, str(tmp_path / "r"), binary=binary).collect()
        assert sorted((r[0], r[1].rstrip(), len(r[1])) for r in got) == [(f"{k:010d}", f"v{k}", 86) for k in (1, 2, 3)]


def test_binary_records_hold_any_bytes_and_need_no_python(spark, tmp_path):
    record = bytes(range(246, 256)) + b"\x00\x01" + bytes(k % 256 for k in range(86)) + b"\n\n"
    (tmp_path / "r").write_bytes(record * 3)
    got = read_records(spark, str(tmp_path / "r"), binary=True)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r[0].encode("latin-1"), r[1].encode("latin-1")) for r in got.collect()] == [(record[:10], record[12:98])] * 3


def test_merge_patterns_choose_the_exchange(spark):
    a, b = spark.range(100).toDF("k"), spark.range(50).toDF("k2")
    plan = lambda pattern: Frame.of(a).merge({0: MergeSource(b, "k2", pattern)}, Merge.join(0, "k", "k2")).to_physical()
    assert "SortMergeJoin" in plan(MergePattern.PARTIAL) and "Broadcast" not in plan(MergePattern.PARTIAL)
    assert "BroadcastHashJoin" in plan(MergePattern.ALL) and "BroadcastHashJoin" in plan(MergePattern.AUTO)


def test_fanout_is_the_width_of_the_operators_own_exchange(spark):
    df = spark.range(1000).selectExpr("id % 50 as k", "id as v")
    f = Frame.of(df)
    for got in (f.groupby("k", Agg.sum("v", "s"), fanout=3), f.unique(fanout=3), f.sort("v", fanout=3), f.merge({0: MergeSource(df.toDF("k2", "w"), "k2")}, Merge.join(0, "k", "k2"), fanout=3)):
        plan = got.to_physical()
        assert "RoundRobin" not in plan and "Broadcast" not in plan and got.df.rdd.getNumPartitions() <= 3
    assert f.groupby("k", Agg.sum("v", "s"), fanout=3).to_physical().count("Exchange") == 1
    assert [r.v for r in f.sort("v", descending=True, fanout=4).df.collect()] == list(range(999, -1, -1))
    assert f.select("v", fanout=5).df.rdd.getNumPartitions() == 5


def test_second_phase_of_groupby(nulls):
    got = Frame.of(nulls).groupby("k", Agg.sum("x", "s"), Ops.flag(lambda s: s > 0, "s", "f"), Agg.sum("f", "n")).df
    assert _rows(got) == sorted([(1, 1), (2, 0), (None, 1)], key=repr)


def test_reducers(spark):
    def wide(data, frame):
        data["wide"] = F.max("id") - F.min("id")
        data["n"] = frame.agg(F.count(F.lit(1)))

    total = Reduce.udf(lambda p: pd.DataFrame({"s": [int((p.id**2).sum())]}), "s long", F.sum("s"), "squares")
    got = Frame.of(spark.range(100).repartition(5)).reduce([F.max("id").alias("top"), wide, total]).df.first().asDict()
    assert got == {"top": 99, "wide": 99, "n": 100, "squares": sum(k * k for k in range(100))}


def test_auxiliary_data_and_slots(spark, monkeypatch):
    from millrace.operators import merge

    a, b = spark.range(5).toDF("k"), spark.createDataFrame([(1, "x"), (3, "y")], "j long, name string")
    named = Frame.of(a).map(lambda p, aux: p.assign(name=p.k.map(dict(zip(aux.j, aux.name, strict=True))))[["k", "name"]].dropna(), "k long, name string", aux_data=Frame.of(b))
    assert _rows(named.df) == [(1, "x"), (3, "y")]
    assert _rows(Frame.of(a).map(lambda p, aux: p[p.k > aux], "k long", aux_data=3).df) == [(4,)]
    assert Frame.of(a).map(lambda df, aux: df.crossJoin(aux.df if hasattr(aux, "df") else aux), aux_data=b).df.count() == 10
    monkeypatch.setattr(merge, "BROADCAST_BYTES", 1)
    with pytest.raises(ValueError, match="too large"):
        Frame.of(a).map(lambda p, aux: p, "k long", aux_data=b)
    f = Frame.of(a).merge({0: MergeSource(b, "j")})
    g = f.select("name", data_id=0).filter(F.col("name") == "x", data_id=0)
    assert _rows(g.slots[0]) == [("x",)] and g.df.columns == ["k"]
    with pytest.raises(ValueError, match="no data"):
        f.select("name", data_id=7)


def test_sample_and_stages(spark):
    f = Frame.of(spark.range(1000))
    up, down = (f.sample("id", 4, descending=d).df.orderBy("k").collect() for d in (False, True))
    assert [r.bound for r in up] == pytest.approx([250, 500, 750], abs=5) and [r.bound for r in down] == [r.bound for r in up][::-1]
    stages = Frame.of(spark.range(100).selectExpr("id % 7 as k", "id")).groupby("k", Agg.sum("id", "s")).to_physical().stages
    assert stages[0]["reads"] == [1] and stages[1]["reads"] == [] and any("Aggregate" in x for x in stages[1]["operators"])


def test_generator_runs_once_in_each_task(spark):
    assert generate(spark, lambda: pd.DataFrame({"a": [1, 2]}), "a long", fanout=3).count() == 6
    made = Frame.void(spark).map(lambda t: pd.DataFrame({"a": [t]}), "a long", fanout=3)
    assert _rows(made.df) == [(0,), (1,), (2,)]


def test_frames_are_immutable(nulls):
    f = Frame.of(nulls)
    assert f.select("k").df.columns == ["k"] and f.df.columns == ["k", "v", "x"]
    with pytest.raises(ValueError):
        f.drop("nothing")
    with pytest.raises(ValueError):
        f.select("k").map(lambda p: p).purge([-1]).df  # noqa: B018


def test_slots(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    f = Frame.of(a).merge({0: MergeSource(b, "k")})
    assert _rows(f.switch(0).df) == [(2,)]
    assert set(f.purgue([0]).slots) == {-1}


def test_map_sees_whole_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = Frame.of(spark.range(10).repartition(1)).map(lambda p: pd.DataFrame({"n": [len(p)]}), "n long").df
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert _rows(got) == [(10,)]


def test_flags_conditions_casts(nulls, spark):
    flagged = Ops.flag(lambda x: x > 1, "x", "f")(nulls)
    assert dict(flagged.dtypes)["f"] == "tinyint"
    assert dict(Ops.flag(lambda x: x > 1, "x", "f", bool_type=True)(nulls).dtypes)["f"] == "boolean"
    assert _rows(Condition.condition(["k", "x"], lambda k, x: (k == 1) & (x == 1))(nulls)) == [(1, "a", 1.0)]
    one = spark.range(1).select(Cast.to_date(2001, 2, 3).alias("a"), Cast.to_datetime(F.lit("2001-02-03")).alias("b")).first()
    assert one.a == one.b
    with pytest.raises(Exception):  # noqa: B017
        spark.range(1).select(Cast.to_date(F.lit("nonsense"))).collect()


def test_sinks(nulls, tmp_path):
    f = Frame.of(nulls)
    f.write(str(tmp_path / "out"))
    assert len(Frame.from_parquet(f.df.sparkSession, str(tmp_path / "out")).collect()) == 4
    f.compute()
    assert "Scan" in f.to_physical() and f.gather().df.rdd.getNumPartitions() == 1
    assert f.count() == 4 and len(f.head(2)) == 2


def test_written_order_is_global(spark, tmp_path):
    Frame.of(spark.range(100).repartition(7)).sort("id").write(str(tmp_path / "o"))
    files = sorted((tmp_path / "o").glob("part-*"))
    assert [i for p in files for i in pd.read_parquet(p).id] == list(range(100))


def test_incremental_files(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(src)
        run_available(spark, src, spark.range(1).schema, lambda df: df.where("id % 2 = 0"), out, ck)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(0, 20, 2))


def test_settled_tables_go_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    import gc
    import time
    from pathlib import Path

    from millrace import storage

    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path / "shared"))
    kept, gone = storage.settle(spark.range(5)), storage.settle(spark.range(7))
    derived = kept.where("id > 1").join(kept.select("id"), "id")
    assert gone.count() == 7 and len(list(Path(tmp_path / "shared").iterdir())) == 2
    del kept, gone
    for _ in range(20):  # Spark's listeners let go of the last job a little later
        gc.collect()
        spark.range(3).count()
        spark.sparkContext._jvm.System.gc()
        storage.sweep()
        if len(list(Path(tmp_path / "shared").iterdir())) == 1:
            break
        time.sleep(0.2)
    assert len(list(Path(tmp_path / "shared").iterdir())) == 1 and derived.count() == 3


def test_a_shared_folder_where_none_is_set(spark, monkeypatch):
    from millrace import storage

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    assert storage.shared_dir(spark) == storage.shared_dir(spark)

    class OnCluster:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(OnCluster)


def test_llm_is_optional(tmp_path):
    """Without the subpackage and the pipeline the entry module still has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"]
    run = lambda: subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    said = run()
    assert "flagship" in said and "op1_" not in said and "pipeline" not in said
    if (repo / "corpus_pipeline.py").exists():
        shutil.copy(repo / "corpus_pipeline.py", tmp_path)
        assert run() == said
        # with the subpackage, but without a package that it needs
        shutil.copytree(repo / "millrace" / "llm", tmp_path / "millrace" / "llm")
        (tmp_path / "regex.py").write_text("raise ModuleNotFoundError(\"No module named 'regex'\", name='regex')")
        assert run() == said
