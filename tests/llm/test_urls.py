"""Hosts, paths and rules against plain Python; the template tree on hosts made for it."""

from __future__ import annotations

import random
import re

from millrace.llm import urls
from millrace.llm.queries import op3_urls

URLS = [
    None, "", "nothing", "http://A.NET", "http://a.net/", "http://net/x", "http://anet/x", "https://M.Example.NET/en/1?q=/x", "http://example.net/en", "http://example.net/EN/1",
    "http://example.com/de/1#x", "http://sub.example.com/de/", "http://xexample.com/de/1", "http://a.org/fr/1", "http://org/fr/", "http://a.org/fr", "x://y://z/p", "http://h?a=http://b/c",
    "http://h#/x", "http://É.NET/x", "http://\na.net/x\ny", "://a.net/en/", "http://net.", "http://a.net//double",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for said, rule in urls.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = (rule, said)
    return host, path, best


def test_query(spark, tmp_path):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[5], "y"), (None, URLS[5], "y")]
    spark.createDataFrame(rows, "page_id long, url string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op3_urls(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, set()).add((r.host, r.path, r.rule, r.verdict))
    for i, u in enumerate(URLS):
        host, path, best = plain(u)
        assert any((h, p, rule) == (host, path, best and best[0]) and (v == best[1] if best else v in ("allow", "block")) for h, p, rule, v in by_id[i]), u


def test_variable_segments_become_wildcards(spark):
    rows = [("h", f"/{lang}/{k}") for lang in ("en", "de") for k in range(40)] + [("h", "/once/5"), ("g", "/en/1"), ("h", "/a/b/c/d/e/f")]
    got = {(r.host, r.path): r.template for r in urls.templates(spark.createDataFrame(rows, "host string, path string")).collect()}
    assert got["h", "/en/7"] == "/en/*" and got["h", "/once/5"] == "/*/*" and got["g", "/en/1"] == "/*/*" and got["h", "/a/b/c/d/e/f"] == "/*/*/*/*/*/*"


def _judged(spark, rows):
    return {(r.h, r.t): (r.labels, r.purity) for r in urls.judged_templates(spark.createDataFrame(rows, "host string, template string, label string")).collect()}


def test_purity_decides(spark):
    rnd = random.Random(1)
    rows = []
    for branch, shape, blocked, n in (("bad", "*", 1.0, 40), ("mixed", "*/x/*", 0.5, 60), ("good", "*/*", 0.0, 50)):
        rows += [("h", f"/{branch}/{shape}", "block" if rnd.random() < blocked else "allow") for _ in range(n)]
    rows += [("h", "/new/*/y", None)] * 30
    got = {t: v for (_, t), v in _judged(spark, rows).items()}
    assert got["/bad/*"][1] >= urls.REJECT and got["/good/*/*"][1] < 0.1 and got["/new/*/y"][0] == 0 and 0.3 < got["/mixed/*/x/*"][1] < urls.REJECT


def test_branches_without_labels_join_those_of_their_shape(spark):
    rows = [("h", "/a/*", "block")] * 30 + [("h", "/a/*/print", "block")] * 10 + [("h", "/b/*", None)] * 60 + [("h", "/b/*/print", None)] * 20
    rows += [("h", "/c/*/*/img", None)] * 80 + [("g", "/b/*", None)] * 9
    got = _judged(spark, rows)
    assert got["h", "/b/*"][0] == 30 and got["h", "/b/*"][1] >= urls.REJECT and got["h", "/b/*/print"][1] >= urls.REJECT
    assert got["h", "/c/*/*/img"][0] == 0 and got["g", "/b/*"] == (0, urls.PRIOR)


def test_sparse_branches_pool_their_labels(spark):
    rows = [("h", f"/{k}/*", "block") for k in "abcdefgh" for _ in range(4)]
    assert all(labels == 32 and purity >= urls.REJECT for labels, purity in _judged(spark, rows).values())


def test_other_labels_keep_branches_apart(spark):
    rows = [("h", "/a/*", "block")] * 40 + [("h", "/b/*", "allow")] * 40
    got = _judged(spark, rows)
    assert got["h", "/a/*"][0] == 40 and got["h", "/b/*"][1] < 0.3


def test_long_urls_and_levels(spark):
    """Levels grow while nodes have enough urls; a very long url is read to its end."""
    deep = "/".join("abcdefghij")
    rows = [("h", f"/{deep}/{k}") for k in range(20)] + [("h", "/q" * 5000), ("h", None)]
    got = {(r.host, r.path): r.template for r in urls.templates(spark.createDataFrame(rows, "host string, path string").na.fill("")).collect()}
    assert got["h", f"/{deep}/3"] == f"/{deep}/*" and got["h", "/q" * 5000] == "/*" * 5000 and got["h", ""] == ""


def test_labelled_templates_reject_unlabelled_urls(spark):
    """A rule labels part of a template; the rest of the template goes with it."""
    rows = [(k, f"http://h.example/{'ads' if k % 2 else 'news'}/{'tracked' if k % 4 == 1 else 'x'}{k}") for k in range(400)]
    rows += [(1000 + k, f"http://h.example/news/{k}/more") for k in range(200)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), (("block", "h.example/ads/tracked"),)).collect()
    assert {r.verdict for r in got if "/ads/" in r.path} == {"block"} and {r.verdict for r in got if "/news/" in r.path} == {"allow"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert op3_urls(spark, str(tmp_path)).count() == 0
