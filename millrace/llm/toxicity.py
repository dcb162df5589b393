"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the words' beginnings (which carry inflected
forms to their stem), hashed into ``2 ** BITS`` buckets.  A text's vector holds
damped counts of the buckets that tell toxic documents from others in the
sample (log-likelihood ratio), and of the ``FREQUENT`` buckets found in most
toxic documents, which may tell nothing alone but something in pairs.  Buckets
that more than a tenth of the sample has weigh less, by ``-log10`` of that part.
Its score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),

so that a pair such as an insult and the mention of a group can weigh more, or
less, than the two apart.  The pair sum is computed in time linear in the terms.

Training is on at most ``SAMPLE`` labelled documents (a documented bound; they
are those with the lowest hash of their id; of rows that repeat an id one is
learnt from), by Adam on the logistic loss, with a fixed seed.  Labels enter
only through the sample; scores use nothing but the text.

Scale: scoring is one pass without a shuffle.  The model has at most
``2 ** BITS * (FACTORS + 1)`` numbers, in practice some thousand, and is
broadcast.

Defined cases: null and empty texts have no terms and score sigmoid(w0); labels
that are null are not learnt from; repeated rows are scored alike; without
labels of both kinds every score is the share of toxic labels (0 without
labels); a very long text is read as a whole; an empty table gives an empty result; further columns of the input,
whatever their names, are not looked at.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import python_ready, settle

BITS = 20
PREFIXES = (3, 4, 5, 6, 7)
FACTORS = 4
SAMPLE = 20_000
#: Buckets enter the model from this log-likelihood ratio (G2) between toxic and other sampled documents on.
EVIDENCE = 12.0
#: So many others enter it by the number of toxic documents that have them, if not in more than half of the sample.
FREQUENT = 256
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.02, 1e-3
SEED = 7
MEMO_WORDS = 50_000

_WORDS = re.compile(r"[^\W_]+").findall


@dataclass
class Model:
    """Weights and factors of the buckets ``cells`` (ascending); other buckets weigh nothing."""

    w0: float
    cells: np.ndarray
    w: np.ndarray
    v: np.ndarray
    #: What the counts of each bucket are multiplied by.
    scale: np.ndarray | None = None

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        """Of the values ``x`` at the places ``at`` in ``cells``."""
        vx = self.v[at] * x[:, None]
        return self.w0 + float(self.w[at] @ x) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())


def buckets(word: str) -> list[int]:
    """Of a word's terms."""
    terms = [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in terms]


class Terms(dict):
    """Word -> the places of its terms in ``cells``, mostly none; a memo of bounded size."""

    def __init__(self, cells: np.ndarray, scale: np.ndarray | None = None):
        super().__init__()
        self.place = {int(c): k for k, c in enumerate(cells)}
        self.scale = np.ones(len(cells), np.float32) if scale is None else scale

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.place[b] for b in buckets(word) if b in self.place)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found
        return found

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places (ascending) and damped counts of a text."""
        places = list(chain.from_iterable(map(self.__getitem__, _WORDS((text or "").lower()))))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        at, n = np.unique(places, return_counts=True)
        return at, np.minimum(1 + np.log2(n) / 2, 3).astype(np.float32) * self.scale[at]


def all_buckets(text: str | None) -> list[int]:
    """The distinct buckets of a text."""
    return sorted({b for word in set(_WORDS((text or "").lower())) for b in buckets(word)})


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(cells: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """A model of rows (places in cells, values) and their 0/1 labels."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(40.0 if share else -40.0, np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    size = len(cells)
    rng = np.random.default_rng(SEED)
    table = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.01, (size, FACTORS))], axis=1).astype(np.float32)
    mean, square = np.zeros_like(table), np.zeros_like(table)
    w0 = float(np.log(share / (1 - share)))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            step += 1
            part = order[k : k + BATCH]
            dense = np.zeros((len(part), size), np.float32)
            for i, j in enumerate(part):
                dense[i, rows[j][0]] = rows[j][1]
            sums = dense @ table[:, 1:]
            pairs = 0.5 * ((sums**2).sum(axis=1) - (dense**2) @ (table[:, 1:] ** 2).sum(axis=1))
            g = ((sigmoid(w0 + dense @ table[:, 0] + pairs) - labels[part]) / len(part)).astype(np.float32)
            w0 -= RATE * float(g.sum())
            pull = np.empty_like(table)
            pull[:, 0] = g @ dense
            pull[:, 1:] = dense.T @ (g[:, None] * sums) - table[:, 1:] * ((dense**2).T @ g)[:, None]
            pull += DECAY * table
            mean = 0.9 * mean + 0.1 * pull
            square = 0.999 * square + 0.001 * pull**2
            table -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)
    return Model(w0, cells, table[:, 0].copy(), table[:, 1:].copy())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _all_buckets(texts: pa.Array) -> pa.Array:
    return pa.array([all_buckets(t.as_py()) for t in texts], pa.list_(pa.int32()))


def scale_of(df: np.ndarray, n: int) -> np.ndarray:
    """Of buckets by the number of documents of the sample that have them."""
    return np.clip(-np.log10(np.maximum(df, 1) / n), 0, 1).astype(np.float32)


def telling(sample: DataFrame, n: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the model of the sample (toxic, text), ascending, and their scale."""
    seen = sample.select("toxic", F.explode(_all_buckets("text")).alias("bucket"))
    counts = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("a"))
    share = toxic / n

    def part(found: Column, expected: Column) -> Column:
        return F.when(found > 0, found * F.ln(found / expected)).otherwise(F.lit(0.0))

    a, df = F.col("a"), F.col("df")
    g2 = 2 * (part(a, df * share) + part(df - a, df * (1 - share)) + part(toxic - a, (n - df) * share) + part(n - toxic - (df - a), (n - df) * (1 - share)))
    counts = settle(counts.where(a >= 3))
    rows = counts.where(g2 >= EVIDENCE).select("bucket", "df").toArrow()  # at most 2 ** BITS, a few thousand in practice
    often = counts.where(df <= n / 2).orderBy(a.desc(), "bucket").limit(FREQUENT).select("bucket", "df").toArrow()
    found = {b: k for part in (rows, often) for b, k in zip(part.column("bucket").to_pylist(), part.column("df").to_pylist(), strict=True)}
    cells = np.array(sorted(found), np.int32)
    return cells, scale_of(np.array([found[int(b)] for b in cells], np.float64), n)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model learnt from at most ``sample`` of the labels (doc_id, toxic) and their texts in docs (doc_id, text)."""
    python_ready(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = settle(found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "t.text"))
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not 0 < total["toxic"] < total["n"]:
        return fit(np.zeros(0, np.int32), [], np.array([1.0 if total["toxic"] else 0.0]))
    cells, scale = telling(texts, total["n"], total["toxic"])
    kind = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])

    @F.arrow_udf(kind)
    def vectors(batch: pa.Array) -> pa.Array:
        terms = _terms(cells, scale)
        rows = [terms.vector(t.as_py()) for t in batch]
        return pa.StructArray.from_arrays(
            [pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["at", "x"]
        )

    table = texts.select("doc_id", "toxic", vectors("text").alias("v")).toArrow().sort_by("doc_id")  # at most ``sample`` rows
    rows = [(v["at"].values.to_numpy(), v["x"].values.to_numpy()) for v in table.column("v")]
    model = fit(cells, rows, table.column("toxic").to_numpy().astype(np.float64))
    model.scale = scale
    return model


def _terms(cells: np.ndarray, scale: np.ndarray | None, known: dict[bytes, Terms] = {}) -> Terms:  # noqa: B006 - one memo per worker
    key = cells.tobytes() + (b"" if scale is None else scale.tobytes())
    if key not in known:
        known.clear()
        known[key] = Terms(cells, scale)
    return known[key]


def score(docs: DataFrame, model: Model) -> Column:
    """The probability that the column ``text`` of docs is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        terms = _terms(m.cells, m.scale)
        return pa.array(sigmoid(np.array([m.logit(*terms.vector(t.as_py())) for t in texts])), pa.float64())

    return run("text")
