"""Near duplicates by the Jaccard similarity of word shingles: SimHash, deletion-variant index, exact verification.

The method is that of ``simhash`` with fingerprints that reach the similarity asked for.  A text is the set of
its five-word shingles, and its SimHash has ``BITS`` bits instead of 64: two texts of similarity 0.8 differ in some
15 % of the bits, ten of 64, which three bits don't reach and segments of 64 bits can't index.  The fingerprint is
cut into 32 segments of 16 bits, and texts come together that agree in a segment but for one wildcard bit.  Then the
differing bits of three quarters of the fingerprint are counted, which must be ``MAX_DISTANCE`` at most.  Connected
components of what is near in that sense are classes.  The texts of a class are compared by their whole shingle sets
and linked from ``SIMILARITY`` on, so no link is wrong, and none within a class is missed.  Groups are the connected
components of the links.

By the formula a pair at 0.8 is missed with probability 4e-5: a bit differs with probability 0.1515, a segment agrees
but for one bit with 0.278, and 88 of 384 bits are exceeded with 1e-5.  In sets of few shingles majorities are often
close.  Two of at most ``SMALL`` shingles are alike only if one is the other without a shingle, so those also come
together by the sets without one shingle, which finds all.

Scale: equal shingle sets are merged before anything is indexed.  A wildcard is in one of a segment's two bytes, so
rows are dealt by the other byte, two for each segment, and the variants of the byte with the wildcard are made where
the rows are read.  What is near there, also over others, is a bucket; texts alone in theirs go no further.
The first ``FIRST`` segments of every text give most of the classes: of each bucket's texts one is a candidate with
all others.  Then, in the buckets of all segments, only what is still in different classes gives candidates, every text
with its nearest of each larger class, or where more than ``MEETING`` classes meet again one with all others; either
joins the bucket.  So a text gives a bounded number of candidates in a bucket, however many are alike.  Texts move once,
to the other texts of their class.  There they are searched from text to text by the shingles they share, and what is
reached is not compared again, which gives the links of a spanning forest and never the pairs.  A class of more than
``BLOCK`` bytes is cut into blocks and every two blocks meet, so its texts move once for each other block.

Defined cases: as in ``simhash``; texts without words have equal (empty) sets; a
very long text is read as a whole, its shingles counted in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import python_ready, settle
from .simhash import connected

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and of a segment; each segment has two bytes.
BITS, SEGMENT = 512, 16
#: Words of 64 bits whose differing bits are counted, and how many may differ.
VERIFIED, MAX_DISTANCE = 6, 88
#: Shingles of a set that is also indexed without each of them.
SMALL = 8
#: Segments that form the first groups.
FIRST = 3
#: Shingles whose bits are counted at once, in one byte for each bit.
CHUNK = 255
#: Pairs of fingerprints that are looked at at once.
PAIRS = 1 << 20
#: Classes of a bucket that give more candidates than join them.
MEETING = 32
#: Bytes of a class's texts, and what each text adds to its own, that are compared in one task (two blocks of them in a larger class).
BLOCK, TEXT = 16 << 20, 256

_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 2**64, (2, BITS // 64, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    rows = [words] if len(words) < SHINGLE else zip(*(words[k:] for k in range(SHINGLE)), strict=False)
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, rows)), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes; 1 if both are empty."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both) if a.size or b.size else 1.0


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes in words of 64 bits: each word has a hash of its own of every shingle."""
    ones = np.zeros((BITS // 64, 64), np.int64)
    for k in range(0, hashes.size, CHUNK):
        x = hashes[None, k : k + CHUNK] * _TIMES[0]
        x ^= x >> np.uint64(32)
        x *= _TIMES[1]
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8).reshape(*x.shape, 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.uint8)
    return np.packbits(2 * ones > hashes.size, axis=1, bitorder="little").view(np.uint64)[:, 0]


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("less", T.ArrayType(T.LongType()))]))
def _sketch(texts: pa.Array) -> pa.Array:
    import xxhash

    sets = [shingles(t.as_py()) for t in texts]
    named = lambda some: np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in some], np.uint64).view(np.int64)
    less = pa.array([named([s, *(np.delete(s, k) for k in range(s.size))]) if 0 < s.size <= SMALL else [] for s in sets], pa.list_(pa.int64()))
    bits = pa.array([fingerprint(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
    return pa.StructArray.from_arrays([pa.array(named(sets)), bits, less], names=["fp", "bits", "less"])


def _index(nodes: DataFrame, segments: int) -> DataFrame:
    """(at, fp, comp, w0, ...) for each byte of the first segments of every node (fp, comp, bits); at = segment, byte, its value, value of the other byte."""
    wide = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = [F.col("bits")[k].alias(f"w{k}") for k in range(VERIFIED)]
    rows = nodes.repartition(wide, "fp")  # many rows of each, so they are dealt out before
    rows = rows.select("fp", "comp", "bits", F.explode(F.sequence(F.lit(0), F.lit(2 * segments - 1))).alias("v"))
    piece = F.expr("shiftrightunsigned(bits[v div 8], (v div 2) % 4 * 16) & 65535L")
    at = F.expr("shiftleft(cast(v as bigint), 16) | if(v % 2 = 0, s, shiftleft(s & 255L, 8) | shiftright(s, 8))")
    return rows.withColumn("s", piece).select(at.alias("at"), "fp", "comp", *words)


def _near(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= MAX_DISTANCE


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest row of each row's cluster) after the rows a and b have been linked."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _sparse(at: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest row of each row's cluster; a row is compared with the rows low[i] to high[i] of every column."""
    label = np.arange(at.size)
    left, low, n = np.repeat(label, low.shape[1]), low.ravel(), (high - low).ravel()
    some = n > 0
    left, low, n = left[some], low[some], n[some]
    ends = np.cumsum(n)
    k = 0
    while k < n.size:
        last = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, side="right")))
        part = n[k:last]
        right = np.arange(part.sum()) + np.repeat(low[k:last] - (np.cumsum(part) - part), part)
        a = np.repeat(left[k:last], part)
        near = _near(words, a, right)
        label = _merged(label, a[near], right[near])
        k = last
    return label


def _dense(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """As ``_sparse`` for the rows of one group, by search from row to row: what is reached is not compared again."""
    label, rest = np.arange(at.size), np.arange(at.size)
    while rest.size > 1:
        begin, rest = rest[0], rest[1:]
        front = [begin]
        while front and rest.size:
            x = front.pop()
            near = np.bitwise_count(at[rest] ^ at[x]) <= 1
            near[near] = _near(words, rest[near], x)
            reached = rest[near]
            if reached.size:
                label[reached] = begin
                front += reached.tolist()
                rest = rest[~near]
    return label


def clusters(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The smallest row of the cluster of each row (at, words) in order of ``at``.

    Rows of a group (the same but for the last byte of ``at``) are linked if at most one bit of that byte and
    ``MAX_DISTANCE`` of the words differ.  A group of many copies is searched, others are compared pair by pair.
    """
    values, start, count = np.unique(at, return_index=True, return_counts=True)
    end = start + count
    run = np.repeat(np.arange(values.size), count)
    low, high = [np.arange(1, at.size + 1)], [end[run]]
    for k in range(8):
        other = values | (1 << k)
        where = np.minimum(np.searchsorted(values, other), values.size - 1)
        found = (values & (1 << k) == 0) & (values[where] == other)
        low.append(np.where(found, start[where], 0)[run])
        high.append(np.where(found, end[where], 0)[run])
    low, high = np.stack(low, axis=1), np.stack(high, axis=1)
    _, first, size = np.unique(at >> 8, return_index=True, return_counts=True)
    pairs = np.add.reduceat((high - low).sum(axis=1), first)
    many = pairs > 8 * (size + size * size * 9 // 512) + 1000
    low[np.repeat(many, size)] = high[np.repeat(many, size)] = 0
    label = _sparse(at, words, low, high)
    for f, n in zip(first[many], size[many], strict=True):
        label[f : f + n] = f + _dense(at[f : f + n], words[f : f + n])
    return label


def _star(fp: np.ndarray, comp: np.ndarray, words: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of a bucket: one a and all others, in an order of its own for each bucket."""
    a = ((fp.view(np.uint64) ^ np.uint64(key)) * _TIMES[0, 0]).argmin()
    b = np.flatnonzero(comp != comp[a])
    return np.repeat(a, b.size), b


def _nearest(fp: np.ndarray, comp: np.ndarray, words: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of a bucket: every b with its nearest a of each larger group, of those within ``MAX_DISTANCE``; ``_star`` beyond ``MEETING`` groups."""
    _, at, size = np.unique(comp, return_inverse=True, return_counts=True)
    if size.size > MEETING:
        return _star(fp, comp, words, key)
    rank = np.empty(size.size, np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(size.size)
    rank = rank[at]
    left, right = [], []
    for b in np.flatnonzero(rank):
        differ = np.bitwise_count(words ^ words[b]).sum(axis=1, dtype=np.int64)
        a = np.flatnonzero((rank < rank[b]) & (differ <= MAX_DISTANCE))
        a = a[np.lexsort((differ[a], rank[a]))]
        a = a[np.diff(rank[a], prepend=-1) != 0]
        left.append(a)
        right.append(np.repeat(b, a.size))
    return np.concatenate(left), np.concatenate(right)


def _buckets(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Index rows in order of ``at``: (a, b) by ``_nearest`` or else ``_star`` of each cluster that has texts of different groups."""
    held: list[tuple[np.ndarray, ...]] = []

    def done(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Of whole groups."""
        at, fp, comp, words = (np.concatenate(c) for c in zip(*rows, strict=True))
        label = clusters(at, words)
        least = comp.copy()
        np.minimum.at(least, label, comp)
        mixed = np.zeros(at.size, bool)
        mixed[label[comp != least[label]]] = True
        stay = np.flatnonzero(mixed[label])
        if not stay.size:
            return
        stay = stay[np.argsort(label[stay], kind="stable")]
        begins = np.flatnonzero(np.diff(label[stay], prepend=-1))
        group = at >> 8
        out = []
        for part in np.split(stay, begins[1:]):
            key = int(group[part[0]]) << 40 | int(label[part[0]] - np.searchsorted(group, group[part[0]]))
            a, b = (_nearest if every else _star)(fp[part], comp[part], words[part], key)
            out.append((fp[part[a]], fp[part[b]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        at, fp, comp, *words = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
        rows = at, fp, comp, np.stack(words, axis=1).view(np.uint64)
        begun = int(np.searchsorted(at >> 8, at[-1] >> 8))  # the last group, which may go on
        if held and (held[-1][0][-1] >> 8) == at[-1] >> 8:
            held.append(rows)
            continue
        held.append(tuple(c[:begun] for c in rows))
        if sum(c[0].size for c in held):
            yield from done(held)
        held = [tuple(c[begun:] for c in rows)]
    if held:
        yield from done(held)


def indexed(nodes: DataFrame, segments: int = BITS // SEGMENT, every: bool = True) -> DataFrame:
    """(a, b): candidates of different groups of the nodes (fp, comp, bits, less); ``less`` are the keys of small sets."""
    python_ready(nodes.sparkSession, 20_000)  # rows of numbers
    dealt = _index(nodes, segments).repartition(F.shiftright("at", 8)).sortWithinPartitions("at")
    out = settle(dealt.mapInArrow(partial(_buckets, every=every), "a long, b long"))
    python_ready(nodes.sparkSession)
    less = nodes.select(F.explode("less").alias("a"), F.col("fp").alias("b")).where("a <> b")
    return out.unionByName(settle(less.join(nodes.select(F.col("fp").alias("a")).hint("merge"), "a", "left_semi").select("a", "b")))


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among different sets of hashes, by search from set to set: what is reached is not compared again."""
    if len(sets) == 2:
        return [(0, 1)] if jaccard(*sets) >= SIMILARITY else []
    size = np.array([s.size for s in sets])
    rest, waits = np.arange(size.size), np.ones(size.size, bool)  # sets that may be unreached, and whether each is
    hashes, owner = np.concatenate(sets), np.repeat(rest, size)  # of them; owner is a place in rest
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    found: list[tuple[int, int]] = []
    front: list[int] = []
    while left := int(waits.sum()):
        if 2 * left <= rest.size:
            some = waits[owner]
            hashes, owner = hashes[some], (np.cumsum(waits) - 1)[owner[some]]
            rest, waits = rest[waits], waits[waits]
        if not front:
            begin = int(waits.argmax())
            waits[begin] = False
            front.append(int(rest[begin]))
            continue
        x = front.pop()
        low = np.searchsorted(hashes, sets[x])
        n = np.searchsorted(hashes, sets[x], side="right") - low
        both = np.bincount(owner[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)], minlength=rest.size)
        reached = np.flatnonzero(waits & (both / np.maximum(size[rest] + size[x] - both, 1) >= SIMILARITY))
        waits[reached] = False
        found += [(x, y) for y in rest[reached].tolist()]
        front += rest[reached].tolist()
    return found


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, meeting, fp, text) in order of the first two: (a, b) by ``forest`` of each meeting's texts."""
    at: tuple[int, int] | None = None
    fps: list[int] = []
    sets: list[np.ndarray] = []
    out: list[tuple[int, int]] = []
    for batch in batches:
        for root, meeting, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, meeting) != at:
                out += [(fps[x], fps[y]) for x, y in forest(sets)] if len(fps) > 1 else []
                at, fps, sets = (root, meeting), [], []
            fps.append(fp)
            sets.append(shingles(text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
            out = []
    if len(fps) > 1 and (out := [(fps[x], fps[y]) for x, y in forest(sets)]):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def _compared(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links that join all that is alike in each class (fp, rid, octets, root), whose texts are in rows (rid, row)."""
    blocks = settle(classes.groupBy("root").agg(F.ceil(F.sum(F.col("octets") + TEXT) / BLOCK).alias("k")))
    own = F.expr("pmod(xxhash64(fp), k)")
    others = F.expr("transform(filter(sequence(0L, k - 1), m -> m <> own), m -> least(m, own) * k + greatest(m, own))")
    meeting = F.explode(F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).otherwise(others)).alias("meeting")
    meet = settle(classes.join(blocks.hint("merge"), "root").withColumn("own", own).select("rid", "fp", "root", meeting))
    texts = rows.select("rid", "row.text").join(meet.hint("merge"), "rid").select("root", "meeting", "fp", "text")
    dealt = texts.repartition("root", "meeting").sortWithinPartitions("root", "meeting")
    return settle(dealt.mapInArrow(_alike, "a long, b long"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one row of each group.

    The row with the group's smallest ``doc_id`` stays (null ids last; of equal ids the first row read).
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), _sketch("text").alias("s"))
    rows = settle(rows.select("row", "s.*", F.monotonically_increasing_id().alias("rid")))
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("doc_id"), "rid")).alias("m")
    octets = F.max(F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")).alias("octets")
    nodes = settle(rows.groupBy("fp").agg(first, octets, F.first("bits").alias("bits"), F.first("less").alias("less")))

    def in_group(roots: DataFrame) -> DataFrame:
        return nodes.join(roots, nodes.fp == roots.node, "left").withColumn("comp", F.coalesce("root", "fp"))

    begin = indexed(nodes.withColumn("comp", F.col("fp")), FIRST, every=False)
    rest = indexed(in_group(connected(begin)))
    classes = connected(begin.unionByName(rest))
    members = nodes.join(classes, nodes.fp == classes.node).select("fp", "m.rid", "octets", "root")
    roots = connected(_compared(settle(members), rows))
    stay = settle(in_group(roots).groupBy("comp").agg(F.min("m").alias("m")).select("m.rid"))
    return rows.join(stay.hint("merge"), "rid", "left_semi").select("row.*")
