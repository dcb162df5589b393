"""SimHash near-duplicate detection by deletion-variant signatures.

Every text gets a 64-bit SimHash of its word shingles.  Two fingerprints that
differ in at most three bits, cut into two segments of 32 bits, differ in at
most one bit in one of the segments.  Each fingerprint is therefore indexed
under its one-wildcard segment variants (2 segments x 32 wildcard positions);
an equality on a variant brings candidates together and the full distance is
verified.

Scale: equal fingerprints are merged before anything is indexed, so a group of
exact copies is one row.  Variants are dealt by key and read in key order, one
group at a time, and a group emits a spanning forest of its links, never its
pairs.  A group above ``GROUP_CAP`` distinct fingerprints is not held: its rows
go on to a finer index, where the bits not yet fixed are cut again by the same
rule (the other segment's halves, then the remaining half's quarters).  The
third level fixes 53 of 64 bits, so a group there has at most 2,048 distinct
fingerprints, and the recursion ends with every link found.

Links, components and fingerprints stay in distributed tables.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero, which is linked like any other; a text of fewer words than a
shingle is one shingle; a row whose ``doc_id`` is null takes part, and its
component is the smallest id reachable (null if there is none); repeated rows
are all returned; a very long text is read as a whole, its shingles counted in
parts; an empty table gives an empty result; further columns of the
input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, python_ready

BITS = 64
MAX_DISTANCE = 3
#: Distinct fingerprints of one index group that are compared in one task; larger groups go to a finer index.
GROUP_CAP = 4096
#: Edges of a graph that one file holds between rounds.
EDGES = 250_000
#: Shingle hashes whose bits are counted at once, for bounded memory on very long texts.
CHUNK = 8192


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    n = max(1, len(words) - shingle + 1)
    rows = [words] if len(words) < shingle else zip(*(words[k:] for k in range(shingle)), strict=False)
    hashes = np.fromiter(map(hashed, map(b" ".join, rows)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, CHUNK):
        part = hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array, shingle: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit integers."""
    n = shingle[0].as_py() if len(shingle) else 3
    return pa.array(np.array([fingerprint(t.as_py(), n) for t in text], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` of every row, with the whole row as the struct ``row``."""
    python_ready(docs.sparkSession)
    return docs.select("doc_id", F.struct(*docs.columns).alias("row"), _fingerprints("text", F.lit(shingle)).alias("fp"))


def _variants(fps: DataFrame) -> DataFrame:
    """First level: (key, sub, fp); key = segment, wildcard position, segment without that bit."""
    at = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    return at.select(
        F.expr(
            "shiftleft(cast(v as bigint), 32)"
            " | (shiftrightunsigned(fp, (v div 32) * 32) & 4294967295L & ~shiftleft(1L, v % 32))"
        ).alias("key"),
        F.lit(0).cast("long").alias("sub"),
        "fp",
    )


def _finer(rows: DataFrame, level: int) -> DataFrame:
    """Levels two and three: the bits not yet fixed are cut into two, each with one wildcard.

    ``key`` keeps the first level's variant.  ``sub`` gathers what the finer levels fix: at level two
    half (1 bit), position (4), half without that bit (16); at level three those, then quarter (1),
    position (3) and quarter without that bit (8).
    """
    width = 32 >> (level - 1)  # 16 bits at level two, 8 at level three
    at = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))))
    # where the segment not fixed by level one begins; then the half not fixed by level two
    free = "(32 - cast(shiftright(key, 37) as int) * 32)"
    if level == 3:
        free = f"({free} + (1 - cast(shiftright(sub, 20) as int)) * 16)"
    piece = f"shiftrightunsigned(fp, {free} + (v div {width}) * {width}) & {(1 << width) - 1}L"
    own = f"shiftleft(cast(v as bigint), {width}) | ({piece} & ~shiftleft(1L, v % {width}))"
    return at.select("key", F.expr(own if level == 2 else f"shiftleft(sub, 12) | ({own})").alias("sub"), "fp")


def distance(x: np.ndarray, y: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits (numpy counts those of a signed integer's absolute value, hence the view)."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most ``MAX_DISTANCE`` bits apart) among distinct fingerprints."""
    found: list[tuple[int, int]] = []
    rest = fps
    while rest.size > 1:
        front, rest = [rest[0]], rest[1:]
        while front and rest.size:
            x = front.pop()
            near = distance(rest, x) <= MAX_DISTANCE
            if near.any():
                reached = rest[near]
                found += [(int(x), int(y)) for y in reached]
                front += list(reached)
                rest = rest[~near]
    return found


def _link_groups(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, fp) in order of (key, sub): links as (a, b, null, null), too large groups as (fp, null, key, sub)."""
    names = ["a", "b", "key", "sub"]
    carry = np.zeros((3, 0), dtype=np.int64)
    large: tuple[int, int] | None = None

    def passed_on(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(rows.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows[2]), none, pa.array(rows[0]), pa.array(rows[1])], names=names)

    def links(rows: np.ndarray) -> pa.RecordBatch | None:
        """Of whole groups."""
        new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        starts, ends = np.r_[0, new], np.r_[new, rows.shape[1]]
        many = ends - starts > 1
        a: list[int] = []
        b: list[int] = []
        two = starts[many & (ends - starts == 2)]
        x, y = rows[2][two], rows[2][two + 1] if two.size else rows[2][two]
        near = distance(x, y) <= MAX_DISTANCE
        a += x[near].tolist()
        b += y[near].tolist()
        for s, e in zip(starts[many & (ends - starts > 2)], ends[many & (ends - starts > 2)], strict=True):
            for p, q in spanning_links(rows[2][s:e]):
                a.append(p)
                b.append(q)
        if not a:
            return None
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none], names=names)

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "sub", "fp")])
        if large is not None:
            same = (rows[0] == large[0]) & (rows[1] == large[1])
            if same.any():
                yield passed_on(rows[:, same])
                rows = rows[:, ~same]
        if not rows.shape[1]:
            continue
        large = None
        rows = np.concatenate([carry, rows], axis=1)
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut = int(last[-1]) + 1 if last.size else 0
        carry, whole = rows[:, cut:], rows[:, :cut]
        if whole.shape[1]:
            new = np.flatnonzero((np.diff(whole[0]) != 0) | (np.diff(whole[1]) != 0)) + 1
            sizes = np.diff(np.r_[0, new, whole.shape[1]])
            over = np.repeat(sizes > cap, sizes)
            if over.any():
                yield passed_on(whole[:, over])
                whole = whole[:, ~over]
            if whole.shape[1] and (out := links(whole)) is not None:
                yield out
        if carry.shape[1] > cap:
            large = (int(carry[0, 0]), int(carry[1, 0]))
            yield passed_on(carry)
            carry = np.zeros((3, 0), dtype=np.int64)
    if carry.shape[1] and (out := links(carry)) is not None:
        yield out


def links(fps: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that join all that are at most three bits apart."""
    found = None
    wide = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _variants(fps.repartition(wide, "fp"))  # 64 rows of each, so they are dealt out before
    for level in (1, 2, 3):
        keyed = rows.repartition("key", "sub").sortWithinPartitions("key", "sub")
        limit = cap if level < 3 else 1 << 30  # a group of the third level has 2,048 fingerprints at most
        out = settle(keyed.mapInArrow(partial(_link_groups, cap=limit), "a long, b long, key long, sub long"))
        here = out.where("key is null").select("a", "b")
        found = here if found is None else found.unionByName(here)
        over = out.where("key is not null")
        if level == 3 or over.isEmpty():
            break
        rows = _finer(over.select("key", "sub", F.col("a").alias("fp")), level + 1)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node of its component.

    In each round every group gets a number by a hash that is new in each round, and points to the group next to it
    with the smallest number, if that is smaller than its own; pointers are followed to their end, and edges are drawn
    between the merged groups.  A group with ``d`` neighbours stays with probability ``1 / (d + 1)`` at most, so half of
    the groups that still have an edge, or more, are expected to go in a round.  All tables stay distributed and are
    written between rounds, in a file for each ``EDGES`` edges.
    """
    ab = edges.select("a", "b").where("a <> b")
    e = settle(ab.union(ab.select("b", "a")).distinct())
    labels = None
    turn = 0
    while n := e.count():
        files = -(-n // EDGES)
        number = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("at"))
        best = e.groupBy("a").agg(F.min(number("b")).alias("m"))
        step = settle(best.select(F.col("a").alias("node"), F.least("m", number("a")).at.alias("root")), files)
        while True:
            on = step.alias("p").join(step.alias("q"), F.col("p.root") == F.col("q.node"))
            step = settle(on.select("p.node", F.col("q.root").alias("root"), (F.col("p.root") != F.col("q.root")).alias("moved")), files)
            if step.where("moved").isEmpty():
                break
        step = step.select("node", "root")
        if labels is None:
            labels, most = step, files
        else:
            after = step.select(F.col("node").alias("root"), F.col("root").alias("after"))
            labels = settle(labels.join(after, "root", "left").select("node", F.coalesce("after", "root").alias("root")), most)
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_")) for c in "ab")
        e = settle(e.join(a, "a").join(b, "b").where("a_ <> b_").select(F.col("a_").alias("a"), F.col("b_").alias("b")).distinct(), files)
        turn += 1
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return settle(labels.join(least, "root").select("node", F.col("least").alias("root")), most)


def classes(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of rows (doc_id, fp)."""
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(nodes.select("fp")))
    named = settle(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    best = settle(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return settle(named.select("fp", "root").join(best, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id."""
    rows = settle(with_fingerprint(docs, shingle).select("doc_id", "fp"))
    return rows.join(classes(rows), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component.

    The row with the component's smallest ``doc_id`` stays (null ids last; of equal ids the first row read).
    """
    rows = settle(with_fingerprint(docs, shingle).withColumn("rid", F.monotonically_increasing_id()))
    ids = rows.select("doc_id", "fp", "rid")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m")
    stay = settle(ids.join(classes(ids).select("fp", "root"), "fp").groupBy("root").agg(first).select("m.rid"))
    # by a shuffle at every size: which rows stay is as many as the documents
    return rows.join(stay.hint("merge"), "rid", "left_semi").select("row.*")
