"""URL filters by path-template trees.

Listed rules decide first.  A url that no rule fits is judged by its template.
For every host a tree of path templates is grown level by level: a segment
value that holds a fair share of the urls below its parent stays literal, all
others are variable and become one wildcard.  The rules' own verdicts label
part of the urls.

Branches that differ in one literal segment only are merged when they are
statistically alike: they have the same main shapes of what lies below them
(those of ``MAIN_SHAPE`` of their urls or more), all shapes are distributed as
below all siblings with these main shapes (chi-square), and their labelled
shares, where they have labels, don't differ.  So a branch without labels joins labelled ones
of its kind.  A template is rejected when it has labels, its own or merged ones,
and their purity, smoothed towards the host's purity, which itself is smoothed
towards ``PRIOR``, reaches ``REJECT``.  A template without any label is allowed.

Scale: html is never read.  Every level is one aggregation by host, template
and segment (partial sums first, so one hot host is no hot task) and one lookup
of the literal segments, broadcast only while they are few.  Levels grow until
no node with further segments has enough urls for a literal one; what lies
deeper can only be variable.  Everything is built-in functions; nothing is
collected.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and forms a template of its own; a very long url has a segment for
each of its parts, all variable where others don't share them; repeated rows
count each and are judged alike; an empty table gives an empty result; further
columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle

#: (verdict, host and path) of the contract's list.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A literal segment has so many urls at least, and this share of its parent's.
LITERAL_COUNT, LITERAL_SHARE = 5, 0.02
#: Smoothed purity: (blocked + STRENGTH * prior) / (labelled + STRENGTH), rejected from REJECT on.
STRENGTH, PRIOR, REJECT = 4.0, 0.25, 0.7
#: A shape with this share of a branch's urls is one of its main shapes.
MAIN_SHAPE = 0.1
#: Branches are alike when chi-square is within so many standard deviations of its mean, and labelled shares within so many standard errors.
SHAPE_ERRORS, LABEL_ERRORS = 3.0, 1.96

def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    lower = F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    none = F.lit("")
    return F.coalesce(lower, none), F.coalesce(F.regexp_extract(url, whole, 2), none)


def _fits(rule: str) -> Column:
    domain, _, path = rule.partition("/")
    below = (F.col("host") == domain) | F.endswith("host", F.lit(f".{domain}"))
    return below & F.startswith("path", F.lit(f"/{path}"))


def by_rules(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: len(x[1])):
        rule, verdict = F.when(_fits(r), r).otherwise(rule), F.when(_fits(r), said).otherwise(verdict)
    return rule, verdict


def templates(urls: DataFrame) -> DataFrame:
    """urls (host, path, ...) with ``template``: literal segments and wildcards."""
    at = urls.withColumn("parts", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("template", F.lit(""))
    columns = at.columns
    k = 0
    while True:
        part = F.get("parts", F.lit(k))
        counts = settle(at.where(F.size("parts") > k).groupBy("host", "template", part.alias("part")).agg(F.count(F.lit(1)).alias("n")))
        parents = counts.groupBy("host", "template").agg(F.sum("n").alias("all")).where(F.col("all") >= LITERAL_COUNT)
        if parents.isEmpty():
            break
        literal = counts.where(F.col("n") >= LITERAL_COUNT).join(parents, ["host", "template"])
        literal = settle(
            literal.where(F.col("n") >= F.col("all") * LITERAL_SHARE).select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("part").alias("p"))
        )
        on = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (part == F.col("p"))
        longer = F.when(F.size("parts") > k, F.concat("template", F.lit("/"), F.coalesce("p", F.lit("*")))).otherwise(F.col("template"))
        at = settle(lookup(at, literal, on).withColumn("template", longer).select(*columns))
        k += 1
    rest = F.expr(f"repeat('/*', greatest(size(parts) - {k}, 0))")
    return at.withColumn("template", F.concat("template", rest)).drop("parts")


def _smoothed(blocked: str, labelled: str, prior: Column) -> Column:
    return (F.col(blocked) + STRENGTH * prior) / (F.col(labelled) + STRENGTH)


def _branches(leaf: DataFrame) -> DataFrame:
    """For every leaf and each of its literal segments: host, template, prefix, literal, suffix, and the leaf's counts."""
    parts = F.slice(F.split("template", "/"), 2, 1 << 20)
    at = leaf.select("*", parts.alias("parts")).select("*", F.posexplode("parts").alias("i", "literal")).where("literal <> '*'")
    return at.select(
        "host", "template", "n", "labelled", "blocked", "literal",
        F.array_join(F.slice("parts", 1, F.col("i")), "/").alias("prefix"),
        F.array_join(F.slice(F.col("parts"), F.col("i") + 2, F.size("parts")), "/").alias("suffix"),
    )


def judged_templates(labelled: DataFrame) -> DataFrame:
    """(h, t, labels, purity) of every template of rows (host, template, label); label is block, allow or null."""
    blocked = F.coalesce(F.sum((F.col("label") == "block").cast("long")), F.lit(0))
    leaf = settle(labelled.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), blocked.alias("blocked")))
    rows = _branches(leaf)
    branch = ["host", "prefix", "literal"]
    main = rows.groupBy(*branch).agg(F.sum("n").alias("n_branch")).join(rows, branch).where(F.col("n") >= F.col("n_branch") * MAIN_SHAPE)
    shapes = main.groupBy(*branch).agg(F.array_join(F.sort_array(F.collect_set("suffix")), " ").alias("shape"))  # 1 / MAIN_SHAPE each at most
    rows = settle(rows.join(shapes, branch))
    # shapes below a branch against those below all its siblings
    kin = ["host", "prefix", "shape"]
    by_suffix = rows.groupBy(*kin, "suffix").agg(F.sum("n").alias("n_suffix"))
    by_parent = by_suffix.groupBy(*kin).agg(F.sum("n_suffix").alias("n_parent"), F.count(F.lit(1)).alias("suffixes"))
    fit = F.sum(F.col("n") * F.col("n") / F.col("n_suffix"))
    own = rows.join(by_suffix, [*kin, "suffix"]).groupBy(*kin, "literal")
    own = own.agg(F.sum("n").alias("n_branch"), F.sum("labelled").alias("b_labelled"), F.sum("blocked").alias("b_blocked"), fit.alias("fit"))
    chi2 = F.col("fit") * F.col("n_parent") / F.col("n_branch") - F.col("n_branch")
    free = F.col("suffixes") - 1
    alike = own.join(by_parent, kin).where(chi2 <= free + SHAPE_ERRORS * F.sqrt(2 * free) + 1e-6)
    # labelled shares among those
    alike = settle(alike.select(*kin, "literal", "b_labelled", "b_blocked"))
    shares = alike.groupBy(*kin).agg((F.sum("b_blocked") / F.greatest(F.sum("b_labelled"), F.lit(1))).alias("share"))
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("b_labelled"))
    near = (F.col("b_labelled") == 0) | (F.abs(F.col("b_blocked") / F.col("b_labelled") - F.col("share")) <= LABEL_ERRORS * error + 1e-12)
    merging = alike.join(shares, kin).where(near).select(*kin, "literal")
    members = rows.join(merging, [*kin, "literal"])
    merged = members.groupBy(*kin, "suffix").agg(F.sum("labelled").alias("m_labelled"), F.sum("blocked").alias("m_blocked"))
    best = members.join(merged, [*kin, "suffix"]).groupBy("host", "template").agg(F.max(F.struct("m_labelled", "m_blocked")).alias("m"))
    hosts = leaf.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("blocked").alias("h_blocked"))
    hosts = hosts.select("host", _smoothed("h_blocked", "h_labelled", F.lit(PRIOR)).alias("of_host"))
    both = leaf.join(best, ["host", "template"], "left").join(hosts, "host")
    counted = both.select("host", "template", "of_host", F.coalesce("m.m_labelled", "labelled").alias("labels"), F.coalesce("m.m_blocked", "blocked").alias("bad"))
    return settle(counted.select(F.col("host").alias("h"), F.col("template").alias("t"), "labels", _smoothed("bad", "labels", F.col("of_host")).alias("purity")))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row."""
    host, path = host_and_path(F.col("url"))
    at = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = by_rules(rules)
    at = settle(templates(settle(at.select("*", rule.alias("rule"), said.alias("label")))))
    trees = judged_templates(at)
    out = lookup(at, trees, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")))
    own = F.when((F.col("labels") > 0) & (F.col("purity") >= REJECT), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "template", "purity")
