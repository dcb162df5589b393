"""Base counts against plain Python; outliers against an independent computation."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import quality
from millrace.llm.queries import op5_quality

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x x", "a b c d a b c e b c d", "l1\nl1\n\nl2\nl1", "l\r\nl\r\n", "# $ | <b> 🙂🙂 é",
    "a\x0bb\x0cc\x1cd\x85e\xa0f", " ".join(["w"] * 2000), "\n".join(["same line here"] * 500), " ".join(str(i % 97) for i in range(5000)),
]


def test_counts(spark, tmp_path):
    rows = [(i, t, "en", None, 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op5_quality(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)  # too few documents for estimates


def test_chi_square():
    assert quality.chi2_quantile(0.975, 6) == pytest.approx(14.449375, abs=1e-5)
    assert quality.chi2_cdf(10.644641, 6) == pytest.approx(0.9, abs=1e-7)


def _corpus(n=600):
    rnd = np.random.default_rng(3)
    words = ["".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = [words[k] for k in rnd.integers(0, 3000, rnd.integers(80, 200))]
        bad = i % 10 == 0
        if bad:
            w = [x + "###" for x in w]
        rows.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), "en", "s" if i % 3 else None, bad))
    return rows


def test_outliers_go_and_the_rest_stays(spark):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    got = {r.doc_id: r for r in quality.judge(df.repartition(3)).collect()}
    assert all(got[i].kept != bad for i, _, _, _, bad in rows)
    again = {r.doc_id: r for r in quality.judge(df.repartition(5)).collect()}
    assert {i: (r.kept, r.d2) for i, r in got.items()} == {i: (r.kept, r.d2) for i, r in again.items()}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(not r[4] for r in rows)


def _plain_estimates(x):
    """Minimum covariance determinant by sorting, from the operator's three starts; one reweighting."""
    n, p = x.shape
    h = (n + p + 1) // 2
    floor = np.diag(np.array([quality.FEATURES[k] * quality.SCALE for k in quality.FEATURES]) ** 2)
    q1, q2, q3 = np.percentile(x, [25, 50, 75], axis=0)
    d = np.maximum((q3 - q1) / 1.349, np.sqrt(np.diag(floor)))
    z = (x - q2) / d
    signs, tangents = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-5), np.tanh(z)
    starts = [np.diag(d**2), p * signs.T @ signs / n * np.outer(d, d), 2 * tangents.T @ tangents / n * np.outer(d, d)]

    def d2(m, c):
        return np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)

    def refit(close, part):
        return x[close].mean(0), np.cov(x[close].T, bias=True) * quality.consistency(part, p) + floor

    best = None
    for c in starts:
        m, c = q2, c + floor
        for _ in range(30):
            m, c = refit(np.argsort(d2(m, c), kind="stable")[:h], h / n)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    m, c = refit(d2(*best[1:]) <= quality.chi2_quantile(quality.REWEIGHT, p), quality.REWEIGHT)
    return d2(m, c)


def test_verdicts_are_those_of_the_method_done_plainly(spark, tmp_path):
    """The query against numpy, by kind: distances to a few hundredths (bins), the same verdicts."""
    rows = _corpus(900)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id: r.kept for r in op5_quality(spark, str(tmp_path)).collect()}
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    limit = quality.chi2_quantile(1 - quality.TAIL, len(quality.FEATURES))
    for source in ("s", None):
        ids = [i for i, _, _, s, _ in rows if s == source and not got[i].base_failed]
        x = np.array([[got[i][f"x_{k}"] for k in quality.FEATURES] for i in ids], dtype=float)
        want = _plain_estimates(x)
        assert np.allclose([got[i].d2 for i in ids], want, rtol=0.1, atol=0.3)
        assert all(kept[i] == (d <= limit) for i, d in zip(ids, want, strict=True) if abs(d / limit - 1) > 0.1)
    assert all(kept[i] == (not bad) for i, _, _, _, bad in rows)


def _kind(n, make):
    rnd = np.random.default_rng(5)
    words = ["".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        w = [words[k] for k in rnd.integers(0, 3000, rnd.integers(80, 200))]
        rows.append((i, make(i, w), "en", "s"))
    return rows


def _lines(w):
    return "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))


def test_a_third_of_copies_of_one_junk_text(spark):
    junk = " ".join(f"j{k}$$" for k in range(100))
    rows = _kind(600, lambda i, w: junk if i % 3 == 0 else _lines(w))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 3 != 0) for r in got)


ALONE = {
    "word_len": lambda w: _lines([x * 4 for x in w]),
    "symbols": lambda w: _lines([x + "#" for x in w]),
    "capitals": lambda w: _lines([x.upper() for x in w]),
    "dup_lines": lambda w: " ".join(w[:60]) + "\n" + "\n".join(["menu home"] * 3 + ["menu page"] * 3 + ["other item"] * 3),
    "repeats": lambda w: " ".join([*w[:60], *w[:20], *w[60:70]]),
    "doubles": lambda w: " ".join(x for v in w[:50] for x in (v, v)),
}


def test_each_statistic_rejects_alone(spark):
    """In each of six kinds one document stands out by one statistic."""
    rows = []
    for k, statistic in enumerate(sorted(ALONE)):
        rows += [(1000 * k + i, t, "en", statistic) for i, t, _, _ in _kind(150, lambda i, w, s=statistic: ALONE[s](w) if i == 7 else _lines(w))]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {1000 * k + 7 for k in range(len(ALONE))} and not any(r.base_failed for r in got)


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(str(k % 30_011) for k in range(60_000))
    rows = [(1, long, "en", "s", "r", 0.5), (2, None, None, None, "r", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, d2 double")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert (got[1].n_words, got[1].n_repeat_words) == plain(long)[::4] and got[2].base_failed
    assert quality.keep_good(df).columns == df.columns


def test_kinds(spark):
    rows = [("en", "a")] * 75 + [("en", "b")] * 45 + [("en", None)] * 18 + [("fr", "a")] * 36 + [(None, "a")] * 27
    stats = spark.createDataFrame([(*r, False) for r in rows], "lang string, source string, base_failed boolean")
    got = {(r.lang, r.source): r.kind for r in quality._kinds(stats).collect()}
    assert got == {("en", "a"): "2:en/1:a", ("en", "b"): "2:en/*", ("en", None): "2:en/*", ("fr", "a"): "*", (None, "a"): "*"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_quality(spark, str(tmp_path)).count() == 0
