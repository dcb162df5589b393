"""Quality rules with robust multivariate outliers.

Every text is described by a few counts over the whole text.  Two fixed base
rules reject texts that are too short or mostly repetition.  The others are
judged against their own kind: within each language and source the location
and scatter of transformed statistics are estimated by the minimum covariance
determinant, and a document is rejected when its Mahalanobis distance is
beyond a far quantile of the chi-square distribution.

The determinant is sought for about half of a kind's rows, so that the
estimates hold while up to half of a kind is junk, copies included.  There are
three deterministic starts: medians and quartiles; the scatter of spatial signs;
the scatter of hyperbolic tangents.  From each, concentration steps (estimates of
the closest half, distances, the closest half again) go on until no determinant
of any kind falls by more than ``CONVERGED``, in logarithms, ``STEPS`` steps at
most.  The start with the smallest determinant is taken, and reweighted once.
``FEATURES`` has the least standard deviation that is believed of each
statistic; each can reject a document by itself.

A language and source with fewer than ``MIN_ROWS`` usable documents is judged
with the language's other small sources, and those with all other small ones
if they are still too few; what is too small even then (fewer than ``MIN_ROWS``
documents of the whole table) gives no estimates and rejects nobody.

Scale: text is read once, within its row, by built-in functions only.  The
statistics are written as a narrow table of integers, next to the rows where
those are asked for, and read alone.  A concentration step is one aggregation of
that table for all starts: sums, cross products and counts by kind, start and
binned distance, so choosing the closest rows and their moments needs no sort
and no second pass, and a kind that holds a third of all rows is summed before
it is shuffled.  Of the bin at the edge only the part that is still needed
counts, so rows that tie there, such as copies, don't enter together.  Sums of
integers make reruns agree exactly.

Defined cases: a null text counts as empty, has zero counts and fails the base
rules; a null language or source is a value of its own; repeated rows are
judged alike; a very long text is counted as a whole, in memory of some times
its size; an empty table gives an empty result; further columns of the
input, whatever their names, are kept apart and never looked at.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, lookup, settle, words_of

#: A kind (language and source) needs so many usable documents for estimates of its own: ten for each statistic.
MIN_ROWS = 60
#: Concentration steps at most, and the fall of a determinant's logarithm that ends them.
STEPS, CONVERGED = 10, 0.01
#: Rows beyond this quantile of the chi-square distribution leave the reweighted estimate.
REWEIGHT = 0.975
#: A document is rejected beyond the quantile that leaves this part of a normal distribution.
TAIL = 1e-6
#: Statistics are kept as integers in units of 1/SCALE; distances in BINS bins to a doubling; products of scores in units of 1/FINE.
SCALE, BINS, FINE = 4096, 32, 1 << 20
#: Transformed statistics and the least standard deviation that is believed of each.
FEATURES = {"word_len": 0.04, "symbols": 0.03, "capitals": 0.04, "dup_lines": 0.12, "repeats": 0.10, "doubles": 0.06}

_NAMES = list(FEATURES)
_P = len(_NAMES)


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square with k degrees of freedom (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def consistency(part: float, k: int) -> float:
    """What makes the covariance of the closest ``part`` of a normal sample consistent."""
    return part / chi2_cdf(chi2_quantile(part, k), k + 2)


def with_statistics(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, lang, source, the base counts and the transformed statistics x_* of every row; ``row`` on request."""
    carried = ["doc_id", "lang", "source", *(["row"] if keep_row else [])]
    at = docs.select("doc_id", "lang", "source", *([F.struct(*docs.columns).alias("row")] if keep_row else []), F.coalesce("text", F.lit("")).alias("text"))
    without = lambda signs: F.length(F.regexp_replace("text", signs, ""))
    at = at.select(
        *carried,
        words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
        without(BLANK_RUN).cast("long").alias("word_chars"),
        (F.length("text") - without(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("text") - without(r"\p{Lu}")).alias("n_capitals"),
    )
    n = F.size("w")
    window = lambda i: (F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    starts = F.sequence(F.lit(0), n - 3)
    at = at.select(
        *carried, "w", "word_chars", "n_symbols", "n_capitals",
        n.cast("long").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))).alias("n_doubles"),
        F.when(n >= 3, F.transform(starts, lambda i: F.xxhash64(*window(i)))).alias("hashes"),
    )
    # Equal windows have equal hashes: most texts have none twice.  Of the others, windows are sorted by hash and words, so equal ones meet.
    some_twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    by_window = F.sort_array(F.transform(starts, lambda i: F.struct(F.get("hashes", i).alias("h"), *[x.alias(k) for x, k in zip(window(i), "xyz", strict=True)], i.alias("i"))))
    at = at.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_doubles", F.when(some_twice, by_window).alias("sorted"),
    )
    same = lambda a, b: F.coalesce((a.h == b.h) & (a.x == b.x) & (a.y == b.y) & (a.z == b.z), F.lit(False))
    twice = F.filter("sorted", lambda v, k: same(v, F.get("sorted", k - 1)) | same(v, F.get("sorted", k + 1)))
    places = F.flatten(F.transform(twice, lambda v: F.array(v.i, v.i + 1, v.i + 2)))
    at = at.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_doubles",
        F.when(F.col("sorted").isNotNull(), F.size(F.array_distinct(places))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    some = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    share = lambda a, b: F.sqrt(F.least(F.col(a) / some(b), F.lit(1.0)))
    transformed = {
        "word_len": F.ln(F.greatest(F.col("word_chars") / some("n_words"), F.lit(1.0))),
        "symbols": share("n_symbols", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "doubles": share("n_doubles", "n_words"),
    }
    return at.select(
        *carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        *[F.round(transformed[k] * SCALE).cast("long").alias(f"x_{k}") for k in _NAMES],
    )


def _tag(c: str) -> Column:
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))


def _kinds(stats: DataFrame) -> DataFrame:
    """(lang, source, kind): the kind that each language and source is judged in; null where all are too few."""
    counts = settle(stats.where("not base_failed").groupBy("lang", "source").count(), files=4)
    small = counts.where(F.col("count") < MIN_ROWS)
    lang = small.groupBy(F.col("lang").alias("l")).agg(F.sum("count").alias("n_lang"))
    rest = lang.where(F.col("n_lang") < MIN_ROWS).agg(F.coalesce(F.sum("n_lang"), F.lit(0)).alias("n_rest"))
    at = lookup(counts, lang, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(rest), how="left")  # one row
    kind = (
        F.when(F.col("count") >= MIN_ROWS, F.concat(_tag("lang"), F.lit("/"), _tag("source")))
        .when(F.col("n_lang") >= MIN_ROWS, F.concat(_tag("lang"), F.lit("/*")))
        .when(F.col("n_rest") >= MIN_ROWS, F.lit("*"))
    )
    return settle(at.select("lang", "source", kind.alias("kind")), files=4)


_MEANS = [f"m_{i}" for i in range(_P)]
_CELLS = [(i, j) for i in range(_P) for j in range(i + 1)]
_FACTORS = [f"l_{i}_{j}" for i, j in _CELLS]


def _cholesky(scatter: DataFrame) -> DataFrame:
    """kind, start, means m_* and the Cholesky factor l_* of the scatter c_* with the least deviations added, and its determinant's logarithm."""
    least = [(FEATURES[k] * SCALE) ** 2 for k in _NAMES]
    at = scatter.selectExpr("kind", "start", *_MEANS, *[f"greatest(c_{i}_{j}, 0D) + {least[i]}D as c_{i}_{j}" if i == j else f"c_{i}_{j}" for i, j in _CELLS])
    for j in range(_P):
        dot = lambda i, j=j: " + ".join(["0D", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))])
        at = at.selectExpr("*", f"sqrt(greatest(c_{j}_{j} - ({dot(j)}), {least[j] * 0.01}D)) as l_{j}_{j}")
        at = at.selectExpr("*", *[f"(c_{i}_{j} - ({dot(i)})) / l_{j}_{j} as l_{i}_{j}" for i in range(j + 1, _P)])
    determinant = " + ".join(f"2 * ln(l_{i}_{i})" for i in range(_P))
    return settle(at.selectExpr("kind", "start", *_MEANS, *_FACTORS, f"{determinant} as log_det"), files=4)  # a row for each kind and start


def _estimates(moments: DataFrame, scale: Column) -> DataFrame:
    """From sums (n, s_i, s_i_j) by kind and start; scale makes the scatter consistent."""
    scatter = [f"(s_{i}_{j} / n - (s_{i} / n) * (s_{j} / n)) * scale as c_{i}_{j}" for i, j in _CELLS]
    return _cholesky(moments.withColumn("scale", scale).selectExpr("kind", "start", *[f"s_{i} / n as m_{i}" for i in range(_P)], *scatter))


def _distances(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """stats with d2, the squared Mahalanobis distance within its kind; null where there is no estimate."""
    columns = [*stats.columns, *(["start"] if "start" in estimates.columns else [])]
    at = lookup(stats, estimates.drop("log_det"), "kind")
    for i, name in enumerate(_NAMES):
        back = "".join(f" - l_{i}_{k} * y_{k}" for k in range(i))
        at = at.selectExpr("*", f"(x_{name} - m_{i}{back}) / l_{i}_{i} as y_{i}")
    return at.selectExpr(*[f"`{c}`" for c in columns], " + ".join(f"y_{i} * y_{i}" for i in range(_P)) + " as d2")


def _bin(d2: Column) -> Column:
    return F.least(F.floor(F.log2(d2 + 1) * BINS), F.lit(2000)).cast("int")


def _binned(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """Counts, sums and cross products by kind, start and binned distance."""
    x = [f"x_{k}" for k in _NAMES]
    sums = ["count(1) as n", *[f"sum({x[i]}) as s_{i}" for i in range(_P)], *[f"sum({x[i]} * {x[j]}) as s_{i}_{j}" for i, j in _CELLS]]
    at = _distances(stats, estimates).withColumn("bin", _bin(F.col("d2")))
    return at.groupBy("kind", "start", "bin").agg(*map(F.expr, sums))


def _closest_half(binned: DataFrame) -> DataFrame:
    """Sums over the (n + p + 1) / 2 rows of each kind and start that are closest; ``part`` is their part of the rows."""
    own = Window.partitionBy("kind", "start")
    ahead = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = binned.withColumn("ahead", ahead).withColumn("all", F.sum("n").over(own)).withColumn("half", F.floor((F.col("all") + _P + 1) / 2))
    needed = F.least(F.lit(1.0), (F.col("half") - F.col("ahead")) / F.col("n"))
    sums = ["n", *[f"s_{i}" for i in range(_P)], *[f"s_{i}_{j}" for i, j in _CELLS]]
    # in integers, so that reruns agree to the last bit
    close = at.where("ahead < half").select("kind", "start", "half", "all", *[F.round(F.col(c) * needed).cast("long").alias(c) for c in sums])
    return close.groupBy("kind", "start").agg((F.max("half") / F.max("all")).alias("part"), *[F.sum(c).alias(c) for c in sums])


@cache
def _known_consistency() -> list[float]:
    return [consistency(min(k / 32, 1 - 1e-9), _P) for k in range(16, 33)]


def consistency_of(part: Column) -> Column:
    """``consistency`` of a column of parts from one half to one, by linear interpolation in steps of 1/32."""
    known = F.array(*map(F.lit, _known_consistency()))
    at = F.greatest((part - 0.5) * 32, F.lit(0.0))
    k = F.least(F.floor(at), F.lit(15)).cast("int")
    low, high = F.get(known, k), F.get(known, k + 1)
    return low + (high - low) * (at - k)


def _starts(stats: DataFrame) -> DataFrame:
    """Estimates of every kind from medians and quartiles (start 0), spatial signs (1) and hyperbolic tangents (2)."""
    spread = stats.groupBy("kind").agg(*[F.percentile(f"x_{k}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i, k in enumerate(_NAMES)])
    deviation = [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FEATURES[_NAMES[i]] * SCALE)) for i in range(_P)]
    spread = settle(spread.select("kind", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(_P)], *[deviation[i].alias(f"d_{i}") for i in range(_P)]), files=4)
    scores = lookup(stats, spread, "kind").select("kind", *[((F.col(f"x_{k}") - F.col(f"m_{i}")) / F.col(f"d_{i}")).alias(f"z_{i}") for i, k in enumerate(_NAMES)])
    length = F.greatest(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, _P)), F.col("z_0") * F.col("z_0")), F.lit(1e-9))
    fine = lambda v: F.sum(F.round(v * FINE).cast("long"))
    tangent = [F.tanh(f"z_{i}") for i in range(_P)]
    sums = scores.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        *[fine(F.col(f"z_{i}") * F.col(f"z_{j}") / length).alias(f"u_{i}_{j}") for i, j in _CELLS],
        *[fine(tangent[i] * tangent[j]).alias(f"t_{i}_{j}") for i, j in _CELLS],
    )
    at = spread.join(sums, "kind")
    of = {
        0: lambda i, j: F.lit(1.0) if i == j else F.lit(0.0),
        1: lambda i, j: F.col(f"u_{i}_{j}") / FINE / F.col("n") * _P,
        2: lambda i, j: F.col(f"t_{i}_{j}") / FINE / F.col("n") * 2,
    }
    cells = lambda k: [(of[k](i, j) * F.col(f"d_{i}") * F.col(f"d_{j}")).alias(f"c_{i}_{j}") for i, j in _CELLS]
    scatters = F.array(*[F.struct(F.lit(k).alias("start"), *cells(k)) for k in of])
    return _cholesky(at.select("kind", *_MEANS, F.explode(scatters).alias("s")).select("kind", *_MEANS, "s.*"))


def minimum_covariance(stats: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimates of each kind: means m_* and Cholesky factors l_*."""
    estimates = _starts(stats)
    for step in range(STEPS):
        after = _estimates(_closest_half(_binned(stats, estimates)), consistency_of(F.col("part")))
        before = estimates.select("kind", "start", F.col("log_det").alias("old"))
        fall = after.join(before, ["kind", "start"]).agg(F.max(F.col("old") - F.col("log_det")).alias("fall")).first()["fall"]
        estimates = after
        if step and (fall is None or fall <= CONVERGED):
            break
    best = estimates.groupBy("kind").agg(F.min(F.struct("log_det", "start", *_MEANS, *_FACTORS)).alias("e")).select("kind", "e.*")
    near = _binned(stats, settle(best, files=4)).where(F.col("bin") <= _bin(F.lit(chi2_quantile(REWEIGHT, _P))))
    sums = ["n", *[f"s_{i}" for i in range(_P)], *[f"s_{i}_{j}" for i, j in _CELLS]]
    return _estimates(near.groupBy("kind", "start").agg(*[F.sum(c).alias(c) for c in sums]), F.lit(consistency(REWEIGHT, _P)))


def judge(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """The statistics of every row with d2 and ``kept``; ``row``, the whole input row, on request."""
    stats = settle(with_statistics(docs, keep_row))
    kinds = _kinds(stats).select(F.col("lang").alias("l"), F.col("source").alias("s"), "kind")
    of = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    narrow = stats.where("not base_failed").select("lang", "source", *[f"x_{k}" for k in _NAMES])
    usable = settle(lookup(narrow, kinds, of).where("kind is not null").select("kind", *[f"x_{k}" for k in _NAMES]))
    estimates = minimum_covariance(usable)
    at = _distances(lookup(stats, kinds, of).drop("l", "s"), estimates.drop("start"))
    far = F.coalesce(F.col("d2") > chi2_quantile(1 - TAIL, _P), F.lit(False))
    return at.withColumn("kept", ~F.col("base_failed") & ~far)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return judge(docs, keep_row=True).where("kept").select("row.*")
