"""Personal data: fixed patterns, then information-theoretic sanitisation.

The patterns find what is personal by its form: email, ip, card, phone, and
secrets (long strings without blanks in which letters and digits alternate and
whose characters carry ``SECRET_BITS`` bits each or more).  What they find are
the protected entities, each value and each kind.  The corpus tells which other
terms give an entity away.  Co-occurrence is counted over whole documents: for
an entity ``e`` and a term ``t``, the disclosure is the pointwise mutual
information of the two, as a part of the entity's information content,

    log(N * n(e, t) / (n(e) * n(t))) / log(N / n(e)),

1 where the term never occurs without the entity.

Copies of one text prove nothing.  For values, a pair counts only with
``SUPPORT`` contexts: documents whose fingerprints (64-bit SimHash of word
pairs) are more than ``ALIKE`` bits apart from each other.  For kinds, the part
``n(e, t) / n(t)`` is drawn towards the corpus' part ``n(e) / N`` by ``PULL``
documents against as many as there are different values beside the term.
However many copies are added, they take no evidence away.

In the texts that hold the entity, every occurrence of a term outside the
patterns is generalised from the disclosure ``GENERALISE`` on, and removed from
``REMOVE`` on.

Scale: one pass finds the patterns, and the words of the texts that hold any.
Only values seen in ``SUPPORT`` contexts are paired with words.  Pairs are
summed before they are shuffled; a text gives one row for each of its words and
kinds.  The counts n(t) need only the terms that may still reach the threshold,
given how often they occur in texts with any entity: their table is broadcast
while it has a checked size, else words are joined by a shuffle.  No text is
shuffled.

All patterns take time linear in the text.

Defined cases: a null text counts as empty; repeated rows are all returned, and
count as documents of their own; a null id is kept; a very long text is read as
a whole; an empty table gives an empty result; further columns of the input,
whatever their names, are kept apart and never looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, python_ready, settle
from .simhash import fingerprint

#: Kinds of the contract's patterns, and all kinds in the order in which spans with the same start are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
#: Contexts that a value's pair needs, and the disclosures from which terms are generalised or removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: A kind's disclosure is drawn towards none by so many documents.
PULL = 10
#: Texts whose fingerprints differ in so many bits at most are near copies (others differ in about 32).
ALIKE = 20
#: A secret's least length, bits for each character, and changes between letter and digit.
SECRET_LENGTH, SECRET_BITS, SECRET_TURNS = 20, 3.0, 4

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a digit run that fails from its start fails from all of its digits
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = regex.compile(r"\p{L}{2,}")  # as the words of the corpus counts
_SECRET = re.compile(rf"[A-Za-z0-9_-]{{{SECRET_LENGTH},}}")
_TURN = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")
_DIGITS = str.maketrans("", "", " -+().")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def find_patterns(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what has a personal form, in order."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := m[0].translate(_DIGITS)) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0].translate(_DIGITS)) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def entropy(value: str) -> float:
    """Bits for each character, by the value's own character counts."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def find_secrets(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Secrets that touch none of the spans, which are in order."""
    found, k, reach = [], 0, 0
    for m in _SECRET.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start() and len(_TURN.findall(m[0])) >= SECRET_TURNS and entropy(m[0]) >= SECRET_BITS:
            found.append((*m.span(), "secret"))
    return found


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


_SPAN = _fields(start=T.IntegerType(), end=T.IntegerType(), kind=T.StringType())
_WORD = _fields(term=T.StringType(), at=T.ArrayType(T.IntegerType()))
_SIGN = _fields(kind=T.StringType(), value=T.LongType())
_FOUND = _fields(spans=T.ArrayType(_SPAN), words=T.ArrayType(_WORD), entities=T.ArrayType(T.LongType()), signs=T.ArrayType(_SIGN), context=T.LongType())
_PA_FOUND = pa.struct([
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))),
    ("words", pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.int32()))]))),
    ("entities", pa.list_(pa.int64())), ("signs", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.int64())]))), ("context", pa.int64()),
])


def _words_outside(text: str, spans: list[tuple[int, int, str]]) -> dict[str, list[int]]:
    """The lower-cased words that touch no span, with the places where they begin; spans are in order."""
    words: dict[str, list[int]] = {}
    k, reach = 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            words.setdefault(m[0].lower(), []).append(m.start())
    return words


def examine(text: str) -> dict[str, object]:
    """Spans of all kinds but terms; where there are any also the words outside them, the entities, one value of each kind, and the context."""
    base = find_patterns(text)
    spans = sorted([*base, *find_secrets(text, base)], key=lambda x: (x[0], KINDS.index(x[2])))
    out: dict[str, object] = {"spans": [{"start": a, "end": b, "kind": k} for a, b, k in spans], "words": [], "entities": [], "signs": [], "context": 0}
    if spans:
        values = {(k, _hash(f"{k}:{text[a:b].lower()}")) for a, b, k in spans}
        least: dict[str, int] = {}
        for kind, value in values:
            least[kind] = min(value, least.get(kind, value))
        context = fingerprint(text, 2)
        out["words"] = [{"term": w, "at": at} for w, at in _words_outside(text, spans).items()]
        out["entities"] = sorted(value for _, value in values)
        out["signs"] = [{"kind": k, "value": v} for k, v in sorted(least.items())]
        out["context"] = context - ((context >> 63) << 64)
    return out


@F.arrow_udf(_FOUND)
def _find(texts: pa.Array) -> pa.Array:
    return pa.array([examine(t.as_py() or "") for t in texts], _PA_FOUND)


def _supported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (entity, term, context, docs) in order: (entity, term, n_pair) of the pairs with ``SUPPORT`` contexts."""
    pair: tuple[int, str] | None = None
    apart: list[int] = []
    n = 0
    for batch in chain(batches, [None]):
        rows = zip(*(batch.column(c).to_pylist() for c in ("entity", "term", "context", "docs")), strict=True) if batch else [(None, None, 0, 0)]
        out: list[tuple[int, str, int]] = []
        for entity, term, context, docs in rows:
            if (entity, term) != pair:
                if len(apart) >= SUPPORT:
                    out.append((*pair, n))
                pair, apart, n = (entity, term), [], 0
            n += docs
            if len(apart) < SUPPORT and all(((context ^ other) & (2**64 - 1)).bit_count() > ALIKE for other in apart):
                apart.append(context)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["entity", "term", "n_pair"])


def _with_support(rows: DataFrame) -> DataFrame:
    """(entity, term, n_pair) of rows (entity, term, context), one for each document."""
    counted = rows.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("docs"))
    ordered = counted.repartition("entity", "term").sortWithinPartitions("entity", "term", "context")
    return settle(ordered.mapInArrow(_supported, "entity long, term string, n_pair long"))


def disclosures(found: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure) and (kind, term, disclosure) of the pairs that reach ``GENERALISE``.

    found has what ``examine`` says of the texts with spans, one row each; texts are all texts.
    """
    n = texts.count()
    words = F.explode(F.transform("words", lambda w: w.term)).alias("term")
    values = _with_support(found.select(F.explode("entities").alias("entity"), F.lit("").alias("term"), "context")).select("entity", F.col("n_pair").alias("n_entity"))
    held = lookup(found.select(F.explode("entities").alias("entity"), "context", "words"), values.select("entity"), "entity", "inner")
    by_value = _with_support(held.select("entity", words, "context")).join(values, "entity")
    signs = found.select(F.explode("signs").alias("s"), "words").select("s.kind", "s.value", "words")
    kinds = signs.groupBy("kind").agg(F.count(F.lit(1)).alias("n_entity"))
    beside = signs.select("kind", "value", words).groupBy("kind", "term", "value").agg(F.count(F.lit(1)).alias("docs"))
    by_kind = beside.groupBy("kind", "term").agg(F.sum("docs").alias("n_pair"), F.count(F.lit(1)).alias("n_values")).join(F.broadcast(kinds), "kind")  # five kinds
    close = settle(found.select(words).groupBy("term").agg(F.count(F.lit(1)).alias("n_close")))

    def disclosure(n_term: str, of_kind: bool) -> Column:
        part = F.least("n_pair", "n_entity", n_term) / F.col(n_term)
        all_ = F.col("n_entity") / n
        if of_kind:
            part = (F.col("n_values") * part + PULL * all_) / (F.col("n_values") + PULL)
        return F.log2(part / all_) / F.log2(1 / all_)

    # A term occurs in at least as many documents as in those with any entity: most pairs fall by that alone.
    reach = lambda pairs, of_kind: settle(pairs.join(close, "term").where(F.col("n_entity") < n).where(disclosure("n_close", of_kind) >= GENERALISE))
    by_value, by_kind = reach(by_value, False), reach(by_kind, True)
    terms = settle(by_value.select("term").union(by_kind.select("term")).distinct())
    said = texts.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([\p{L}]{2,})"), F.lit(1)), F.lower))).alias("term"))
    n_term = settle(lookup(said, terms, "term", "inner").groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    told = lambda pairs, key, of_kind: settle(pairs.join(n_term, "term").select(key, "term", disclosure("n_term", of_kind).alias("disclosure")).where(F.col("disclosure") >= GENERALISE))
    return told(by_value, "entity", False), told(by_kind, "kind", True)


def find(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, spans (the patterns') and terms (start, end, disclosure) of every row; ``row``, the input row, on request."""
    python_ready(docs.sparkSession)
    own = [F.struct(*docs.columns).alias("row")] if keep_row else []
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), *own, _find("text").alias("f"))
    found = settle(found.select("doc_id", "rid", *[c for c in ("row",) if keep_row], "f.*"))
    holding = found.where(F.size("entities") > 0).select("rid", "words", "entities", "signs", "context")
    values, kinds = disclosures(holding, docs.select("text"))
    word = F.explode("words").alias("w")
    # words of a text are looked up by its values that have told terms, and by its kinds
    telling = settle(values.select("entity").distinct())
    held = lookup(holding.select("rid", F.explode("entities").alias("entity"), "words"), telling, "entity", "inner").select("rid", "entity", word)
    of_value = lookup(held.select("rid", "entity", "w.term", "w.at"), values, ["entity", "term"], "inner")
    signed = holding.select("rid", F.explode("signs.kind").alias("kind"), "words").select("rid", "kind", word)
    of_kind = lookup(signed.select("rid", "kind", "w.term", "w.at"), kinds, ["kind", "term"], "inner")
    told = of_value.select("rid", "term", "at", "disclosure").union(of_kind.select("rid", "term", "at", "disclosure"))
    each = told.groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure"), F.first("at").alias("at"))
    span = F.struct(F.col("start"), (F.col("start") + F.length("term")).alias("end"), "disclosure")
    terms = each.select("rid", "term", "disclosure", F.explode("at").alias("start")).groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    out = lookup(found.drop("words", "entities", "signs", "context"), settle(terms), "rid")
    return out.withColumn("terms", F.coalesce("terms", none)).drop("rid")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def all_spans(spans: Column, terms: Column) -> Column:
    """Patterns and terms by start, then kind; terms come last of those with the same start."""
    order = lambda s, kind: F.struct(s.start.alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), kind).alias("k"), s.end.alias("end"), kind.alias("kind"))
    each = F.concat(F.transform(spans, lambda s: order(s, s.kind)), F.transform(terms, lambda s: order(s, F.lit("term"))))
    return F.sort_array(each)


def rewrite(text: str | None, spans: list[dict[str, object]], terms: list[dict[str, object]]) -> str | None:
    """The text with patterns named by their kind, telling terms generalised or removed."""
    if text is None:
        return None
    by_start = [(s["start"], s["end"], f"<{s['kind'].upper()}>") for s in spans]
    by_start += [(t["start"], t["end"], "" if t["disclosure"] >= REMOVE else "<TERM>") for t in terms]
    out, at = [], 0
    for a, b, said in sorted(by_start):
        if b <= at:
            continue
        out += [text[at : max(a, at)], said if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


@F.arrow_udf(T.StringType())
def _rewrite(texts: pa.Array, spans: pa.Array, terms: pa.Array) -> pa.Array:
    rows = zip(texts, spans, terms, strict=True)
    return pa.array([rewrite(t.as_py(), s.as_py(), x.as_py()) if len(s) or len(x) else t.as_py() for t, s, x in rows], pa.string())


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data taken out of ``text``."""
    found = find(docs, keep_row=True)
    clean = _rewrite(F.col("row.text"), F.col("spans"), F.col("terms"))
    return found.select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
