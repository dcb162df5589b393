"""Whole workloads, and one query per operator with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import Agg, Cast, Condition, Ops, Reduce, Transform
from ..operators import Merge, MergePattern, hash_partition, key_partition, range_partition, remap_partition
from ..sources import generate
from ..storage import scratch
from .frame import Frame, MergeSource, purge, switch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = " ".join(sql.split())
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame.from_parquet(spark, f"{sf_dir}/{name}.parquet")


# the flagship: orders that came from several suppliers and were returned, by period, segment and region


@_query(
    "flagship",
    """select count(distinct l_orderkey) as order_count,
              round(coalesce(sum(l_extendedprice), 0), 2) as price_sum,
              round(coalesce(sum(l_extendedprice * l_discount), 0), 2) as disc_sum
       from lineitem join orders on l_orderkey = o_orderkey
       where l_orderkey in (select l_orderkey from lineitem group by 1 having count(distinct l_suppkey) > 1)
         and l_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')
         and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01'
         and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')
         and l_suppkey in (select s_suppkey from supplier join nation on s_nationkey = n_nationkey
                           where n_regionkey in (1, 2, 3))""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    several = (
        items.select(["l_orderkey", "l_suppkey"])
        .groupby("l_orderkey", Agg.n_unique("l_suppkey", "n_suppliers"), Ops.flag(lambda n: n > 1, "n_suppliers", "several"))
        .filter(F.col("several") == 1)
        .select("l_orderkey")
    )
    returned = items.filter(Condition.condition("l_returnflag", lambda x: x == "R")).select("l_orderkey")
    customers = _table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    nations = _table(spark, sf_dir, "nation").filter(F.col("n_regionkey").isin(1, 2, 3)).select("n_nationkey")
    suppliers = _table(spark, sf_dir, "supplier").merge({0: MergeSource(nations, "n_nationkey", MergePattern.ALL)}, Merge.isin(0, "s_nationkey", "n_nationkey"))
    since, until = Cast.to_date(1995, 1, 1), Cast.to_date(1997, 1, 1)
    orders = (
        _table(spark, sf_dir, "orders")
        .filter((F.col("o_orderdate") >= since) & (F.col("o_orderdate") < until))
        .merge({0: MergeSource(customers, "c_custkey")}, [Merge.isin(0, "o_custkey", "c_custkey"), purge([0])])
        .select(["o_orderkey"])
    )
    found = (
        orders.merge(
            {
                0: MergeSource(items.select(["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"]), "l_orderkey"),
                1: MergeSource(several, "l_orderkey"),
                2: MergeSource(returned, "l_orderkey"),
                3: MergeSource(suppliers.select("s_suppkey"), "s_suppkey"),
            },
            [
                switch(0),
                Merge.isin(1, "l_orderkey", "l_orderkey"),
                Merge.isin(2, "l_orderkey", "l_orderkey"),
                Merge.isin(3, "l_suppkey", "s_suppkey"),
                Merge.join(0, "l_orderkey", "o_orderkey"),
                purge([0, 1, 2, 3]),
            ],
        )
        .alias(discounted=F.col("l_extendedprice") * F.col("l_discount"))
        .reduce([Reduce.n_unique("l_orderkey", "order_count"), Reduce.sum("l_extendedprice", "price_sum"), Reduce.sum("discounted", "disc_sum")])
    )
    return found.df.select("order_count", F.round("price_sum", 2).alias("price_sum"), F.round("disc_sum", 2).alias("disc_sum"))


@_query("csv_sort", "select l_extendedprice, row_number() over (order by l_extendedprice asc nulls last, l_orderkey, l_linenumber) as pos, l_orderkey, l_linenumber from lineitem")
def csv_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table as delimited text, sorted globally and written; positions come from the written order."""
    path, target = scratch(spark, "csv"), scratch(spark, "sorted")
    items = _table(spark, sf_dir, "lineitem").select(["l_orderkey", "l_linenumber", "l_extendedprice"])
    items.df.withColumn("end", F.lit(None).cast("string")).write.option("sep", "|").csv(path)
    rows = Frame.from_csv(spark, path, "l_orderkey long, l_linenumber int, l_extendedprice double", has_header=False, separator="|", trailing_separator=True)
    rows.sort(["l_extendedprice", "l_orderkey", "l_linenumber"]).write(target)
    return _numbered(spark, target)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``pos``: their place in a table written in order, counted by file.

    There is a row for each file, not for each row, in the one window that isn't split.
    """
    rows = spark.read.parquet(path).select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("rid"))
    counts = rows.groupBy("file").count()
    before = counts.select("file", F.coalesce(F.sum("count").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file").orderBy("rid"))
    return rows.withColumn("own", own).join(before, "file").withColumn("pos", (F.col("before") + F.col("own")).cast("bigint")).drop("file", "rid", "own", "before")


@_query("generate_join_group", "select k, count(distinct v) as u, sum(w)::bigint as s from (select i % 7 k, i v from range(40) t(i)) a join (select j % 7 k2, j w from range(60) t(j)) b on k = k2 group by 1")
def generate_join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generated sides, joined and grouped."""
    left = Frame.void(spark).map(lambda t: pd.DataFrame({"k": [(10 * t + i) % 7 for i in range(10)], "v": range(10 * t, 10 * t + 10)}), "k long, v long", fanout=4)
    right = Frame.void(spark).map(lambda t: pd.DataFrame({"k2": [(10 * t + i) % 7 for i in range(10)], "w": range(10 * t, 10 * t + 10)}), "k2 long, w long", fanout=6)
    both = left.merge({0: MergeSource(right, "k2")}, [Merge.join(0, "k", "k2")])
    return both.groupby("k", [Agg.n_unique("v", "u"), Agg.sum("w", "s")]).df


# sources


@_query("text_scan_wordcount", "select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by 1")
def text_scan_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a column, as the token scan makes them of a file."""
    docs = _table(spark, sf_dir, "documents").df
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).where(F.length("word") > 0)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@_query("text_scan_file", "select word, count(*) as n from (select unnest(string_split(o_orderpriority || ' ' || o_orderstatus, ' ')) as word from orders) where word <> '' group by 1")
def text_scan_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "text")
    _table(spark, sf_dir, "orders").df.select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).write.option("lineSep", " ").text(path)
    return Frame.from_text(spark, path).df.groupBy(F.col("0").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@_query("scan_csv", "select o_orderkey, o_orderpriority, o_totalprice from orders")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    rows = _table(spark, sf_dir, "orders").df.select("o_orderkey", "o_orderpriority", "o_totalprice", F.lit(None).cast("string").alias("end"))
    rows.write.option("sep", "|").csv(path)
    return Frame.from_csv(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double", has_header=False, separator="|", trailing_separator=True).df


def _write_records(spark: SparkSession, sf_dir: str) -> str:
    """Fixed-width records of the orders: ten bytes of key, two of filling, 86 of value, a two-byte line end."""
    path = scratch(spark, "records")
    key, value = F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.rpad("o_orderpriority", 86, " ")
    _table(spark, sf_dir, "orders").df.select(F.concat(key, F.lit("  "), value)).write.option("lineSep", "\r\n").text(path)
    return path


@_query("teragen_scan", """select lpad(o_orderkey::varchar, 10, '0') as "0", o_orderpriority as "1" from orders""")
def teragen_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frame.from_teragen(spark, _write_records(spark, sf_dir)).df.select("0", F.rtrim("1").alias("1"))


@_query("terasort", """select k as "0", row_number() over (order by k) as pos from (select lpad(o_orderkey::varchar, 10, '0') k from orders)""")
def terasort(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "sorted")
    Frame.from_teragen(spark, _write_records(spark, sf_dir)).sort("0").write(target)
    return _numbered(spark, target).select("0", "pos")


@_query("generator_source", "select k, sum(v)::bigint as sv from (select i % 101 k, i * 2 v from range(1000) t(i)) group by 1")
def generator_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generate(spark, lambda t: pd.DataFrame({"i": range(100 * t, 100 * t + 100)}), "i long", fanout=10)
    return made.groupBy((F.col("i") % 101).alias("k")).agg(F.sum(F.col("i") * 2).alias("sv"))


# projections, filters and maps


@_query("select", "select o_orderkey, o_custkey from orders")
def select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(["o_orderkey", "o_custkey"]).df


@_query("drop", "select n_nationkey, n_name from nation")
def drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").drop("n_regionkey").df


@_query("filter_one_col", "select n_name from nation where n_regionkey = 1")
def filter_one_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").filter(Condition.condition("n_regionkey", lambda x: x == 1)).select("n_name").df


@_query("filter_two_cols", "select l_orderkey, l_linenumber from lineitem where l_quantity = 1 or (l_quantity = 2 and l_linenumber = 1)")
def filter_two_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Condition.condition(["l_quantity", "l_linenumber"], lambda q, n: (q == 1) | ((q == 2) & (n == 1)))
    return _table(spark, sf_dir, "lineitem").filter(keep).select(["l_orderkey", "l_linenumber"]).df


@_query("filter_date_range", "select o_orderkey from orders where o_orderdate::date between date '1999-04-01' and date '1999-06-01'")
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return _table(spark, sf_dir, "orders").filter(day.between(Cast.to_date(1999, 4, 1), Cast.to_date(1999, 6, 1))).select("o_orderkey").df


@_query("flag_int8", "select l_orderkey, l_linenumber, cast(l_linenumber > 1 as tinyint) as flag from lineitem")
def flag_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(["l_orderkey", "l_linenumber"]).map(Ops.flag(lambda x: x > 1, "l_linenumber", "flag")).df


@_query("flag_bool", "select s_suppkey, s_acctbal > 1000 as f from supplier")
def flag_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").map(Ops.flag(lambda x: x > 1000, "s_acctbal", "f", bool_type=True)).select(["s_suppkey", "f"]).df


@_query("map_expr", "select p_partkey, upper(p_brand) as brand from part where p_size > 25")
def map_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").map(lambda df: df.where("p_size > 25").select("p_partkey", F.upper("p_brand").alias("brand"))).df


@_query("map_pandas", "select n_nationkey, n_name from nation where n_regionkey = 1")
def map_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").map(lambda p: p[p.n_regionkey == 1][["n_nationkey", "n_name"]], "n_nationkey int, n_name string").df


@_query("map_batches", "select l_returnflag, count(*) as n from lineitem where l_discount > 0.05 group by 1")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque Python over batches, for functions that need no whole partition."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b.l_discount > 0.05][["l_returnflag"]]

    items = _table(spark, sf_dir, "lineitem").select(["l_returnflag", "l_discount"])
    return items.df.mapInPandas(keep, "l_returnflag string").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@_query("to_date_parse", "select o_orderkey, o_orderdate::date as d from orders")
def to_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd").alias("t")
    return _table(spark, sf_dir, "orders").select(["o_orderkey", text]).select(["o_orderkey", Cast.to_date("t").alias("d")]).df


# joins and concatenation


@_query("join_inner", "select o_orderkey, o_custkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select(["c_custkey", "c_name"])
    return _table(spark, sf_dir, "orders").select(["o_orderkey", "o_custkey"]).merge({0: MergeSource(customers, "c_custkey")}, Merge.join(0, "o_custkey", "c_custkey")).df


@_query("isin", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = _table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select("l_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey").merge({0: MergeSource(returned, "l_orderkey")}, Merge.isin(0, "o_orderkey", "l_orderkey")).df


@_query("concatenate", "select c_nationkey as k from customer union all select s_nationkey from supplier")
def concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    two = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return one.merge({0: MergeSource(two, "k")}, Merge.concatenate()).df


def _names(spark: SparkSession, sf_dir: str, pattern: MergePattern) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").select(["c_custkey", "c_name"])
    orders = _table(spark, sf_dir, "orders").select(["o_orderkey", "o_custkey"])
    return orders.merge({0: MergeSource(customers, "c_custkey", pattern)}, Merge.join(0, "o_custkey", "c_custkey")).select(["o_orderkey", "c_name"]).df


@_query("broadcast_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, MergePattern.ALL)


@_query("shuffle_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def shuffle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, MergePattern.PARTIAL)


@_query("merge_slots", "select n_nationkey, n_name from nation where n_regionkey in (select r_regionkey from region where r_name in ('ASIA', 'EUROPE'))")
def merge_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots are swapped, dropped from and forgotten."""
    regions = _table(spark, sf_dir, "region").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = _table(spark, sf_dir, "nation")
    both = regions.merge({0: MergeSource(nations, "n_regionkey")}).drop("r_name", data_id=-1).switch(0)
    return both.merge(merge_ops=[Merge.isin(0, "n_regionkey", "r_regionkey")]).purge([0]).drop("n_regionkey").df


# aggregation


@_query(
    "group_n_unique_sum",
    """select l_orderkey, count(distinct l_suppkey) + coalesce(max(case when l_suppkey is null then 1 else 0 end), 0) as u,
              coalesce(sum(l_quantity), 0.0) as s from lineitem group by 1""",
)
def group_n_unique_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupby("l_orderkey", [Agg.n_unique("l_suppkey", "u"), Agg.sum("l_quantity", "s")]).df


@_query("group_first_ordered", "select l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) as f from lineitem group by 1")
def group_first_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupby("l_orderkey", Agg.first("l_suppkey", "f", ["l_linenumber", "l_suppkey"])).df


@_query(
    "group_flag_max",
    """select l_orderkey, u, flag, max(flag) over (partition by l_orderkey) as max_flag
       from (select l_orderkey, count(distinct l_suppkey) as u, (count(distinct l_suppkey) > 1)::tinyint as flag from lineitem group by 1)""",
)
def group_flag_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [Ops.flag(lambda x: x > 1, "u", "flag"), Transform.max("flag", "l_orderkey", "max_flag")]
    return _table(spark, sf_dir, "lineitem").groupby("l_orderkey", Agg.n_unique("l_suppkey", "u"), steps).df


@_query("two_phase_agg", "select l_orderkey, coalesce(sum(l_quantity), 0) as q, (count(distinct l_suppkey) > 1)::bigint as several from lineitem group by 1")
def two_phase_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by order, whose flags are then summed again by a second phase."""
    first = [Agg.sum("l_quantity", "part"), Agg.n_unique("l_suppkey", "suppliers")]
    flagged = Ops.flag(lambda n: n > 1, "suppliers", "several")
    return _table(spark, sf_dir, "lineitem").groupby("l_orderkey", first, flagged, [Agg.sum("part", "q"), Agg.sum("several", "several")], fanout=8).df


@_query("gather", "select * from nation")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").gather().df


@_query(
    "reduce",
    """select count(distinct l_orderkey) + coalesce(max(case when l_orderkey is null then 1 else 0 end), 0) as u,
              round(coalesce(sum(l_extendedprice), 0.0), 2) as s from lineitem""",
)
def reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "lineitem").reduce([Reduce.n_unique("l_orderkey", "u"), Reduce.sum("l_extendedprice", "s")])
    return found.select(["u", F.round("s", 2).alias("s")]).df


@_query("reduce_udf", "select max(l_extendedprice) as top, count(*) as n, min(l_discount) as least from lineitem")
def reduce_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar of opaque Python, one set by a function, and an aggregate."""

    def least(data: dict, frame: DataFrame) -> None:
        data["least"] = F.min("l_discount")

    top = Reduce.udf(lambda p: pd.DataFrame({"v": [p.l_extendedprice.max()]}), "v double", F.max("v"), "top")
    items = _table(spark, sf_dir, "lineitem").select(["l_extendedprice", "l_discount"])
    return items.reduce([top, F.count(F.lit(1)).alias("n"), least]).select(["top", "n", "least"]).df


@_query("map_aux", "select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey")
def map_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque Python with auxiliary data that every task gets."""
    regions = _table(spark, sf_dir, "region").select(["r_regionkey", "r_name"])

    def named(rows: pd.DataFrame, aux: pd.DataFrame) -> pd.DataFrame:
        return rows.merge(aux, left_on="n_regionkey", right_on="r_regionkey")[["n_nationkey", "r_name"]]

    return _table(spark, sf_dir, "nation").map(named, "n_nationkey int, r_name string", aux_data=regions).df


@_query("fanout_merge", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def fanout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join whose exchange has a width of its own."""
    customers = _table(spark, sf_dir, "customer").select(["c_custkey", "c_name"])
    orders = _table(spark, sf_dir, "orders").select(["o_orderkey", "o_custkey"])
    return orders.merge({0: MergeSource(customers, "c_custkey")}, Merge.join(0, "o_custkey", "c_custkey"), fanout=6).select(["o_orderkey", "c_name"]).df


@_query("unique", "select distinct event_type, user_id from events")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(["event_type", "user_id"]).unique().df


@_query("max_over", "select l_orderkey, l_linenumber, max(l_quantity) over (partition by l_orderkey) as m from lineitem")
def max_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").map(Transform.max("l_quantity", "l_orderkey", "m")).select(["l_orderkey", "l_linenumber", "m"]).df


@_query(
    "n_unique_over",
    """select event_id, u from events join (select user_id, count(distinct event_type) + max(case when event_type is null then 1 else 0 end) as u
       from events group by 1) x on events.user_id is not distinct from x.user_id""",
)
def n_unique_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(["event_id", "event_type", "user_id"]).map(Transform.n_unique("event_type", "user_id", "u")).select(["event_id", "u"]).df


# order and partitions


def _positions(spark: SparkSession, sf_dir: str, keys: list[str], descending: bool) -> DataFrame:
    target = scratch(spark, "sorted")
    orders = _table(spark, sf_dir, "orders").select(["o_orderkey", "o_totalprice"])
    # the second key ascends in both; a descending sort is of one key and its mirror
    orders.alias(back=-F.col("o_orderkey")).sort(keys, descending).write(target)
    return _numbered(spark, target).select("o_orderkey", "pos")


@_query("sort_position", "select o_orderkey, row_number() over (order by o_totalprice asc nulls last, o_orderkey) as pos from orders")
def sort_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir, ["o_totalprice", "o_orderkey"], False)


@_query("sort_desc_position", "select o_orderkey, row_number() over (order by o_totalprice desc nulls first, o_orderkey) as pos from orders")
def sort_desc_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir, ["o_totalprice", "back"], True)


@_query("key_partition", "select p_partkey, least(floor((" + " + ".join(f"(ascii(substr(p_name, {i}, 1)) - 32)::bigint * {95 ** (8 - i)}" for i in range(1, 9)) + f")::double / {95**8 - 1} * 10), 9)::int as p from part")
def key_partition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(["p_partkey", key_partition(F.col("p_name"), 10).alias("p")]).df


@_query("remap_partition", "select l_orderkey, l_linenumber, ((l_orderkey % 10000) * 7) // 10000 as p from lineitem")
def remap_partition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(["l_orderkey", "l_linenumber", remap_partition(F.col("l_orderkey") % 10000, 10000, 7).alias("p")]).df


@_query("hash_partition", "select count(*) as n, 0::bigint as split_keys, true as within from orders")
def hash_partition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are kept, no key is in two partitions, and partitions are 0 to 7; which key goes where is the engine's own."""
    parts = hash_partition(_table(spark, sf_dir, "orders").df, "o_custkey", 8).groupBy("o_custkey", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"), F.min("p").alias("low"), F.max("p").alias("high"))
    split = F.sum((F.col("places") > 1).cast("bigint"))
    return keys.agg(F.sum("n").alias("n"), split.alias("split_keys"), ((F.min("low") >= 0) & (F.max("high") < 8)).alias("within"))


#: Ranges of sampled bounds are even within this part of a range.
_EVEN = 0.5


@_query("range_partition", "select count(*) as n, 8::bigint as ranges, true as apart, true as even from orders")
def range_partition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are kept, the eight ranges don't overlap, and hold about equally many rows."""
    parts = range_partition(_table(spark, sf_dir, "orders").df, "o_totalprice", 8).groupBy(F.spark_partition_id().alias("p"))
    ranges = parts.agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    at = ranges.withColumn("before", F.lag("high").over(Window.orderBy("p")))  # eight rows
    at = at.withColumn("all", F.sum("n").over(Window.partitionBy()))
    even = F.bool_and(F.abs(F.col("n") * 8 - F.col("all")) <= F.col("all") * _EVEN)
    return at.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ranges"), F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("low"))).alias("apart"), even.alias("even"))


@_query("range_bounds", "select k::int as k, true as near from range(7) t(k)")
def range_bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bound has its part of the rows below it, within a hundredth of all rows."""
    prices = _table(spark, sf_dir, "orders")
    bounds = prices.sample("o_totalprice", 8).df
    counts = prices.df.join(F.broadcast(bounds), F.col("o_totalprice") <= F.col("bound"), "right").groupBy("k").agg(F.count("o_totalprice").alias("below"))  # seven bounds
    total = prices.df.agg(F.count("o_totalprice").alias("all"))
    part = F.col("below") / F.col("all")
    return counts.join(F.broadcast(total)).select("k", (F.abs(part - (F.col("k") + 1) / 8) <= 0.01).alias("near"))


# sinks


@_query("write_roundtrip", "select * from orders")
def write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "written")
    _table(spark, sf_dir, "orders").write(path)
    return Frame.from_parquet(spark, path).df
