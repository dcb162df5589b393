"""Sharding by a k-d tree over document metadata.

The space has three dimensions: size, language and source.  A node that is to
hold ``k`` shards is split along the dimension in which its documents spread
widest, at the weighted median (for odd ``k`` at the matching quantile) of
their bytes, until every leaf holds one shard's bytes.  So that widths compare,
a place in a dimension counts as the part of all bytes that lies below it; the
width is the standard deviation of that by bytes.  Languages and sources are
ordered by a hash.  Equal texts are one point, so a group of copies stays in one
shard; only a group larger than ``PIECE`` of a shard is cut into pieces of about
that size, so that one group, even with a third of all rows, can't unbalance the
shards.

Scale: the texts are read once and a narrow table is kept.  Medians are found
by summing bytes into bins of a 63-bit key (the dimension, then a hash to break
ties) digit by digit, for all nodes of a level at once; the first digit is
summed for all dimensions in one pass, which also gives the widths.  At most
``2 ** FIRST`` totals for each node and dimension reach the driver.  The
finished tree is an expression of 15 comparisons.  Groups with many rows are few
and joined by broadcast.  Slots are counted by input split and shard, so no
shard is sorted or gathered as a whole.

Defined cases: a null text counts as empty; a null language or source has its
own place in its dimension; rows that repeat an id are all placed; a very long
text is one point that can't be cut, so shards differ by its size at most; an
empty table gives an empty result; further columns of the input, whatever their
names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, settle

SHARDS = 16
#: A group of equal texts above this part of a shard is cut into pieces.
PIECE = 1 / 64
#: A group of equal texts with more than this part of all rows is joined by broadcast; there are as many at most.
HOT_ROWS = 1 / 1024
#: Keys have 63 bits, of which FIRST and then DIGIT bits are looked at a time; a cut is good when it misses the median by this part of a shard at most.
KEY_BITS, FIRST, DIGIT, MISS = 63, 10, 13, 1e-3

_DIMENSIONS = ("by_size", "by_lang", "by_source")


def _key(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), 32) + F.col("tie")


def _placed(tree: dict[int, tuple[str, int]], node: int = 1) -> Column:
    """The node below ``node`` that a point falls in, as far as the tree has grown."""
    if node not in tree:
        return F.lit(node)
    dimension, cut = tree[node]
    return F.when(_key(dimension) < cut, _placed(tree, 2 * node)).otherwise(_placed(tree, 2 * node + 1))


def _coordinates(points: DataFrame) -> DataFrame:
    """Dimensions as 31-bit integers, and the hash that breaks ties."""
    scale = float(1 << 31)
    code = lambda c: F.coalesce(F.pmod(F.xxhash64(F.col(c)), F.lit((1 << 31) - 1)) + 1, F.lit(0))
    coded = lambda c: F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(code(c))
    return points.select(
        "*",
        F.least(F.floor(F.log2("size") / 32 * scale), F.lit((1 << 31) - 1)).cast("long").alias("by_size"),
        coded("lang").alias("by_lang"),
        coded("source").alias("by_source"),
        F.pmod(F.xxhash64("hash", "piece"), F.lit(1 << 32)).alias("tie"),
    )


def _cuts(at: DataFrame, state: dict[int, tuple[int, float]], shift: int, miss: float) -> dict[int, int]:
    """Cut keys of nodes: at (node, key, bytes); state gives each node's lowest key so far, of 2 ** shift, and the bytes to be left of the cut in them."""
    done: dict[int, int] = {}
    while state:
        span, shift = shift, max(0, shift - DIGIT)
        low = F.create_map(*[x for n, (lo, _) in state.items() for x in (F.lit(n), F.lit(lo))])
        need = F.create_map(*[x for n, (_, want) in state.items() for x in (F.lit(n), F.lit(float(want)))])
        inside = at.where(F.col("node").isin(*state)).withColumn("off", F.col("key") - low[F.col("node")])
        inside = inside.where((F.col("off") >= 0) & (F.shiftright("off", span) == 0))
        bins = inside.groupBy("node", F.shiftright("off", shift).alias("b")).agg(F.sum("bytes").alias("n"))
        order = Window.partitionBy("node").orderBy("b")  # at most 2 ** DIGIT rows each
        run = bins.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        hit = F.min(F.when(F.col("upto") >= need[F.col("node")], F.struct("b", "n", "upto")))
        rows = run.groupBy("node").agg(hit.alias("h"), F.max(F.struct("b", "n", "upto")).alias("last")).collect()  # one row a node
        found: dict[int, tuple[int, float]] = {}
        for r in rows:
            lo, want = state[r["node"]]
            b = r["h"] or r["last"]
            _settle_cut(r["node"], lo + (b["b"] << shift), shift, want, b["upto"] - b["n"], b["upto"], miss, done, found)
        state = found
    return done


def _settle_cut(node: int, start: int, shift: int, want: float, before: int, after: int, miss: float, done: dict[int, int], found: dict[int, tuple[int, float]]) -> None:
    """Cut before or after the bin of keys from ``start``, if that is near enough to ``want`` bytes; else look into it."""
    left, right = abs(want - before), abs(after - want)
    if min(left, right) <= miss or shift == 0:
        done[node] = start if left <= right else start + (1 << shift)
    else:
        found[node] = (start, want - before)


def _spread(bins: dict[int, int], place: dict[int, float]) -> float:
    """Standard deviation by bytes of the places of the bins."""
    total = sum(bins.values())
    mean = sum(n * place[b] for b, n in bins.items()) / total
    return max(0.0, sum(n * (place[b] - mean) ** 2 for b, n in bins.items()) / total) ** 0.5


def grow(points: DataFrame, shards: int, total: int) -> tuple[dict[int, tuple[str, int]], dict[int, int]]:
    """The tree (node -> dimension and cut) and the first shard of each leaf; points have bytes and coordinates."""
    tree: dict[int, tuple[str, int]] = {}
    span = {1: (0, shards)}  # node -> its first shard, how many
    miss = total / shards * MISS
    place: dict[str, dict[int, float]] = {}
    first_shift = KEY_BITS - FIRST
    while open_ := [n for n, (_, k) in span.items() if k > 1 and n not in tree]:
        at = points.withColumn("node", _placed(tree)).where(F.col("node").isin(*open_))
        first = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.shiftright(d, 31 - FIRST).alias("b")) for d in _DIMENSIONS])).alias("f")
        sums = at.select("node", "bytes", first).groupBy("node", "f.dim", "f.b").agg(F.sum("bytes").alias("n"))
        bins: dict[tuple[int, str], dict[int, int]] = {}
        for r in sums.collect():  # at most 2 ** FIRST rows a node and dimension
            bins.setdefault((r["node"], r["dim"]), {})[r["b"]] = r["n"]
        if not tree:
            for d in _DIMENSIONS:
                below = 0
                place[d] = {}
                for b, n in sorted(bins.get((1, d), {}).items()):
                    place[d][b] = (below + n / 2) / total
                    below += n
        done: dict[int, int] = {}
        found: dict[int, tuple[int, float]] = {}
        widest: dict[int, str] = {}
        for n in open_:
            if (n, _DIMENSIONS[0]) not in bins:  # no documents fall in it
                widest[n], done[n] = _DIMENSIONS[0], 0
                continue
            widest[n] = max(_DIMENSIONS, key=lambda d, n=n: (_spread(bins[n, d], place[d]), -_DIMENSIONS.index(d)))
            own = sorted(bins[n, widest[n]].items())
            want = sum(x for _, x in own) * (span[n][1] // 2) / span[n][1]
            before = 0
            for b, x in own:
                if before + x >= want:
                    break
                before += x
            _settle_cut(n, b << first_shift, first_shift, want, before, before + x, miss, done, found)
        key = F.coalesce(*[F.when(F.col("node") == n, _key(d)) for n, d in widest.items()])
        done |= _cuts(at.select("node", key.alias("key"), "bytes"), found, first_shift, miss)
        for n in open_:
            tree[n] = (widest[n], done.get(n, 0))
            lowest, k = span[n]
            span[2 * n], span[2 * n + 1] = (lowest, k // 2), (lowest + k // 2, k - k // 2)
    return tree, {n: lowest for n, (lowest, _) in span.items() if n not in tree}


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = settle(
        docs.select(
            "doc_id", "lang", "source",
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length(text)).cast("long").alias("octets"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
            F.monotonically_increasing_id().alias("rid"),
        ).withColumn("size", F.col("octets") + 1)
    )
    sums = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    total = sums["n"]
    same = ["hash", "text_crc32", "size"]
    groups = settle(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source")))
    piece = max(1.0, total / shards * PIECE)
    # at most shards / PIECE + 1 / HOT_ROWS groups, 2,048 here
    hot = (F.col("n") * F.col("size") > piece) | (F.col("n") > sums["rows"] * HOT_ROWS)
    large = settle(groups.where(hot).select(*same, "n", "lang", "source", F.ceil(F.col("n") * F.col("size") / piece).alias("pieces")))
    pieces = F.broadcast(large.drop("n"))
    cut = F.pmod(F.xxhash64("rid"), F.col("pieces")).alias("piece")
    narrow = rows.select("doc_id", *same, "rid")
    of_large = narrow.join(pieces, same).select("doc_id", *same, "rid", cut, "lang", "source")
    few = groups.where(~hot).drop("n").withColumn("piece", F.lit(0).cast("long"))
    of_few = narrow.join(pieces, same, "left_anti").join(few.hint("merge"), same).select("doc_id", *same, "rid", "piece", "lang", "source")
    split = of_large.groupBy(*same, "piece", "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    columns = [*same, "piece", "lang", "source", (F.col("n") * F.col("size")).alias("bytes")]
    single = groups.where(~hot).withColumn("piece", F.lit(0).cast("long"))
    points = settle(_coordinates(single.select(*columns).unionByName(split.select(*columns))))
    tree, first = grow(points, shards, total)
    leaf = F.create_map(*[x for n, k in first.items() for x in (F.lit(n), F.lit(k))])
    placed = _coordinates(of_few.unionByName(of_large)).withColumn("shard", leaf[_placed(tree)])
    out = settle(placed.select("doc_id", "size", "text_crc32", "shard", "rid", F.shiftrightunsigned("rid", 33).alias("part")))
    counts = out.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = settle(counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset")))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1
    numbered = lookup(out.withColumn("own", own), offsets, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("own")).cast("long").alias("slot"))
