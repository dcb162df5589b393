"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: a budget (a part of all words) is shared by
weight, no source above ``MAX_REPEAT`` times its own size, the excess shared
again by weight.  A document's expected number of copies is its source's
target divided by its source's size.  The whole part of it is taken for
certain.  The rest is a sample without replacement with unequal inclusion
probabilities, drawn by Pareto order sampling: every document has a fixed
uniform number ``u`` derived from its id, its rank is the odds ``u / (1 - u)``
divided by the odds ``p / (1 - p)`` of its inclusion probability ``p``, and the
lowest ranks are taken.  The sample's size is fixed in words, which is what a
mix is measured in: ranks are taken as long as the words they add bring the
source nearer to its target.

Inclusion probabilities differ within a source: they are proportional to
``sqrt(size)`` up to a factor that makes the expected words right, so that the
many words of long documents are not left to a few draws; ``power=0`` makes
them equal.

Scale: one pass over the texts counts words and keeps a narrow table.  The cut
in each source's order is found by summing words into bins of the rank, digit
by digit, so no source is sorted and one that holds a third of all rows is
summed before it is shuffled.  What is known of a source is one row of one
table.  All choices depend on a document's own id, size and source, and on sums
of integers, so reruns agree.

Defined cases: a null text counts as empty, its size is zero and nothing is
taken of it; a null source is a source of its own, last in order; a null id is
an id like any other; rows that repeat an id with the same size and source have
one rank, and at the cut as many of them are taken as come nearest to the
target (which of them is left open, as nothing tells them apart); a very long
text is counted as a whole and is one document like any other, so a target may
be missed by half of it; an empty table gives an empty result; further columns
of the input, whatever their names, are kept apart and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lookup, settle

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEAT = 2
#: Inclusion probabilities grow as the size to this power.
POWER = 0.5
SEED = 20_011
#: Sums of sizes times their power are in units of 1 / PULL.
PULL = 1024
#: Ranks are integers of this many bits, looked at DIGIT bits at a time.
RANK_BITS, DIGIT = 48, 12


def share_out(sizes: dict[object, int], weights: dict[object, float], budget: float, most: float = MAX_REPEAT) -> dict[object, float]:
    """Targets by weight; none above ``most`` times its size, the excess shared again by weight."""
    target: dict[object, float] = {}
    open_ = {k for k in sizes if weights[k] > 0}
    left = float(budget)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total >= most * sizes[k]}
        if not full:
            return {k: 0.0 for k in sizes} | target | {k: left * weights[k] / total for k in open_}
        for k in full:
            target[k] = float(most * sizes[k])
        left -= sum(target[k] for k in full)
        open_ -= full
    return {k: 0.0 for k in sizes} | target


def _targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target); the rounds of sharing run over the table of sources."""
    sources = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size")), files=4)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # one row per source
    at = sources.withColumn("k", F.row_number().over(order) - 1)
    at = at.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("k", F.lit(len(WEIGHTS))) + 1))
    rows = at.select("k", "weight", "source_size")
    # A source is full from the lowest water level on; sorted by level, the sharing is a running sum.
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")), "k")
    run = rows.select(
        "*",
        F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        F.sum("source_size").over(Window.partitionBy()).alias("all"),
    )
    level = (BUDGET * F.col("all") - MAX_REPEAT * F.col("before")) / F.col("open")
    run = run.select("k", "weight", "source_size", level.alias("level"), F.struct(F.col("source_size") / F.col("weight"), "k").alias("o"))
    open_ = F.col("level") * F.col("weight") < MAX_REPEAT * F.col("source_size")
    first = run.where(open_).agg(F.min(F.struct("o", "level")).alias("first"))
    full = F.col("first").isNull() | (F.col("o") < F.col("first.o"))
    done = run.join(F.broadcast(first), how="left").select(  # one row
        F.col("k").alias("k_"), F.when(full, F.col("source_size") * float(MAX_REPEAT)).otherwise(F.col("first.level") * F.col("weight")).alias("target")
    )
    return settle(at.join(done, F.col("k") == F.col("k_")).select(F.col("source").alias("s"), "source_size", "target"), files=4)


def _uniform() -> Column:
    """Fixed by the id, size and source of a document; strictly between 0 and 1."""
    of = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "size", "source")]
    digest = F.md5(F.concat_ws("|", F.lit(str(SEED)), *of))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _factor(rows: DataFrame, power: float) -> DataFrame:
    """(s, f): min(1, f * size ** power) makes the expected words of a source's sample right."""
    doubling = F.length(F.bin("size")).alias("b")
    # in integers, so that reruns agree to the last bit
    pull = F.floor(F.pow("size", F.lit(power)) * PULL).cast("decimal(20,0)") * F.col("size")
    bins = rows.where("size > 0").groupBy("s", doubling).agg(F.sum("size").alias("words"), F.sum(pull).cast("double").alias("pull"))
    rest = rows.groupBy("s").agg(F.max(F.col("part") * F.col("source_size")).alias("need"))
    # Documents of the upper bins have probability one; below them the factor is what is still needed over the pull.
    up = Window.partitionBy("s").orderBy(F.col("b").desc())
    down = Window.partitionBy("s").orderBy("b")
    at = bins.join(rest.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_"))).select(
        "s", "b", "need",
        F.coalesce(F.sum("words").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("certain"),
        (F.sum("pull").over(down.rowsBetween(Window.unboundedPreceding, 0)) / PULL).alias("pull"),
        F.pow(F.lit(2.0), "b").alias("top"),
    )
    f = (F.col("need") - F.col("certain")) / F.col("pull")
    fits = f * F.pow("top", F.lit(power)) <= 1
    return settle(at.groupBy("s").agg(F.coalesce(F.max(F.when(fits & (f >= 0), f)), F.max(F.when(f >= 0, f)), F.lit(0.0)).alias("f")), files=4)


def _cuts(rows: DataFrame) -> DataFrame:
    """(t, cut, some, all): ranks below the cut are taken, and ``some`` of the ``all`` rows at it; then the words taken are nearest to the words needed."""
    state = settle(rows.groupBy("s").agg(F.max("need").alias("need")).select(F.col("s").alias("t"), "need", F.lit(0).cast("long").alias("low")), files=4)
    for shift in range(RANK_BITS - DIGIT, -1, -DIGIT):
        inside = lookup(rows.drop("need"), state, F.col("s").eqNullSafe(F.col("t")))
        span = 1 << (shift + DIGIT)
        inside = inside.where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + span))
        bins = inside.groupBy("t", "low", "need", F.expr(f"shiftright(rank - low, {shift})").alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("all"))
        order = Window.partitionBy("t").orderBy("b")
        before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = bins.withColumn("before", before).withColumn("after", F.col("before") + F.col("words"))
        # the first bin that reaches the need; beyond the last, everything is taken
        hit = F.min(F.when(F.col("after") >= F.col("need"), F.struct("b", "low", "before", "need", "words", "all"))).alias("h")
        both = at.groupBy("t").agg(hit, F.max(F.struct("b", "low")).alias("m"))
        b, low = F.coalesce("h.b", "m.b"), F.coalesce("h.low", "m.low")
        left = F.coalesce(F.col("h.need") - F.col("h.before"), F.lit(float(1 << 60)))
        state = settle(both.select("t", left.alias("need"), (low + F.shiftleft(b.cast("long"), shift)).alias("low"), "h.words", "h.all"), files=4)
    # one rank is left, mostly of one document
    some = F.least(F.floor(F.col("need") * F.col("all") / F.col("words") + 0.5), F.col("all")).cast("long")
    whole = F.col("words").isNull()
    return state.select(
        "t", (F.col("low") + whole.cast("long")).alias("cut"), F.when(whole, 0).otherwise(some).alias("some"), F.when(whole, 0).otherwise(F.col("all")).alias("all")
    )


def _some_of_equal(rows: DataFrame) -> DataFrame:
    """rid of ``some`` rows of each source, of rows (s, rid, some): counted by input split, so no group is gathered."""
    at = settle(rows.withColumn("part", F.shiftrightunsigned("rid", 33)))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    offsets = at.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("s").alias("t"), F.col("part").alias("of"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("s", "part").orderBy("rid"))
    numbered = lookup(at.withColumn("own", own), settle(offsets), F.col("s").eqNullSafe(F.col("t")) & (F.col("part") == F.col("of")))
    return settle(numbered.where("before + own <= some").select(F.col("rid").alias("taken_rid")))


def mix(docs: DataFrame, power: float = POWER, keep_row: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target and taken of every row; ``row``, the whole input row, on request."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")
    own = [F.struct(*docs.columns).alias("row")] if keep_row else []
    sized = settle(docs.select("doc_id", "source", size, F.monotonically_increasing_id().alias("rid"), *own))
    copies = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    whole = F.floor(copies)
    targets = settle(_targets(sized).select("*", whole.alias("whole"), (copies - whole).alias("part")), files=4)
    p = F.least(F.greatest(F.col("f") * F.pow("size", F.lit(power)), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = _uniform()
    odds = (u / (1 - u)) / (p / (1 - p))
    # odds to (0, 1), in the same order, then to an integer
    rank = F.floor(odds / (1 + odds) * float((1 << RANK_BITS) - 1)).cast("long").alias("rank")
    narrow = sized.select("doc_id", "source", "size", "rid").where("size > 0")
    drawn = lookup(narrow, targets, F.col("source").eqNullSafe(F.col("s")), "inner").where("part > 0").select("s", "doc_id", "source", "size", "rid", "part", "source_size")
    factor = _factor(drawn, power).select(F.col("s").alias("s2"), "f")
    need = (F.col("part") * F.col("source_size")).alias("need")
    ranked = settle(lookup(drawn, factor, F.col("s").eqNullSafe(F.col("s2"))).select("s", "size", "rid", rank, need))
    cuts = _cuts(ranked)
    known = targets.join(factor.hint("merge"), F.col("s").eqNullSafe(F.col("s2")), "left").join(cuts.hint("merge"), F.col("s").eqNullSafe(F.col("t")), "left")
    known = settle(known.drop("s2", "t"), files=4)
    edge = lookup(ranked, known.select(F.col("s").alias("t"), "cut", "some", "all"), F.col("s").eqNullSafe(F.col("t")), "inner")
    chosen = _some_of_equal(edge.where("rank = cut and some > 0 and some < all").select("s", "rid", "some"))
    out = lookup(sized, known, F.col("source").eqNullSafe(F.col("s")))
    taken = (F.col("part") > 0) & ((rank < F.col("cut")) | ((rank == F.col("cut")) & (F.col("some") == F.col("all"))))
    if not chosen.isEmpty():
        out = lookup(out, chosen, F.col("rid") == F.col("taken_rid"))
        taken = taken | F.col("taken_rid").isNotNull()
    times = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")).otherwise(F.lit(0))
    return out.select(
        "doc_id", "size", "source", "source_size", "target", (times * F.col("size")).alias("taken"), times.cast("int").alias("times"), *(["row"] if keep_row else [])
    )


def mixed(docs: DataFrame, power: float = POWER) -> DataFrame:
    """The mix: every row of ``docs`` as often as it is taken."""
    rows = mix(docs, power, keep_row=True).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
