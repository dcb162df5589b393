"""Patterns against the contract's expressions read plainly; disclosures against plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from millrace.llm import pii
from millrace.llm.queries import op8_pii


def plain(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(a, b, k) for a, _, k, b in sorted(out)]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_patterns_on_random_texts():
    rnd = random.Random(8)
    for alphabet in ("ab@.1 2+-()0%é\n", "0123456789. ", "a@.-", "+0123456789 ()-.", "4 1-"):
        for _ in range(6000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 45)))
            assert pii.find_patterns(text) == plain(text), text
    for _ in range(2000):
        digits = "".join(rnd.choice("0123456789") for _ in range(rnd.randint(11, 20)))
        text = f"pay {digits} now"
        assert pii.find_patterns(text) == plain(text)


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "@" * 300_000, "x@y." * 80_000):
        pii.find_patterns(text)
    assert time.perf_counter() - began < 10


NAMES = [("quorn", "zq@mail.example.org"), ("velda", "+1 (555) 010-7788 1")]


def _docs():
    rnd = random.Random(2)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    say = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    docs = []
    for name, entity in NAMES:
        docs += [f"{say(12)} {name.title()} {say(1)} {entity} {say(9)}" for _ in range(8)]
    docs += [f"{say(30)} other{k}@x.example.net {say(20)}" for k in range(30)]
    copied = f"{say(10)} rareterm one@copy.example.com uniqueword {say(10)}"
    docs += [copied] * 20 + [copied + f" {k}" for k in range(10)]
    docs += [say(60) for _ in range(60)]
    return [(i, re.sub(r"[0-9](?=[a-z])", "", d), "x") for i, d in enumerate(docs)]


def test_terms_that_give_an_entity_away(spark):
    rows = _docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").repartition(3)
    found = {r.doc_id: r for r in pii.find(df).collect()}
    text = {i: t for i, t, _ in rows}
    told = Counter(text[i][t.start : t.end].lower() for i, r in found.items() for t in r.terms)
    assert told == {name: 8 for name, _ in NAMES}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i, t in clean.items():
        assert "@" not in t and "Quorn" not in t and "Velda" not in t
        if not found[i].spans:
            assert t == text[i]
    assert any("rareterm <EMAIL> uniqueword" in t for t in clean.values())


def _plain_terms(rows):
    """Spans of terms by plain counting over whole documents; every document is a context of its own here."""
    n = len(rows)
    words = {i: set(re.findall(r"[^\W\d_]{2,}", t.lower())) for i, t in rows}
    n_term = Counter(w for ws in words.values() for w in ws)
    spans = {i: [(a, b, k) for a, b, k in plain(t)] + [(m.start(), m.end(), "secret") for m in re.finditer(r"\b[0-9a-f]{40}\b", t)] for i, t in rows}
    outside = {i: [m for m in re.finditer(r"[^\W\d_]{2,}", t) if all(m.end() <= a or b <= m.start() for a, b, _ in spans[i])] for i, t in rows}
    docs, values = defaultdict(set), defaultdict(set)
    for i, t in rows:
        for a, b, k in spans[i]:
            docs[k, t[a:b].lower()].add(i)
            docs[k].add(i)
    for i, t in rows:
        for k in {k for _, _, k in spans[i]}:
            for w in {m[0].lower() for m in outside[i]}:
                values[k, w].add(min(t[a:b].lower() for a, b, kk in spans[i] if kk == k))
    told = defaultdict(set)
    for e, holding in docs.items():
        for w in {m[0].lower() for i in holding for m in outside[i]}:
            both = sum(w in {m[0].lower() for m in outside[i]} for i in holding)
            part, all_ = both / n_term[w], len(holding) / n
            if isinstance(e, str):
                v = len(values[e, w])
                part = (v * part + pii.PULL * all_) / (v + pii.PULL)
            elif both < pii.SUPPORT:
                continue
            if all_ < 1 and math.log(part / all_) / math.log(1 / all_) >= pii.GENERALISE:
                for i in holding:
                    told[i] |= {(m.start(), m.end()) for m in outside[i] if m[0].lower() == w}
    return {i: sorted(x) for i, x in told.items() if x}


def test_spans_are_those_of_plain_counts(spark, tmp_path):
    """Names beside one address far apart in the text, and a word that stands beside secrets of all values."""
    rnd = random.Random(3)
    filler = [f"{a}{b}{c}" for a in "bcdfghklmnprstvw" for b in "aeiou" for c in "bdgklmnprst"]
    say = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    texts = [f"Quorn {say(60)} zq@mail.example.org {say(40)} quorn" for _ in range(8)]
    texts += [f"{say(20)} apikey = {rnd.getrandbits(160):040x} {say(20)}" for _ in range(25)]
    texts += [f"{say(30)} m{k}@x.example.net {say(20)}" for k in range(20)] + [say(80) for _ in range(400)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term:")] for r in op8_pii(spark, str(tmp_path)).collect()}
    got = {i: sorted(x) for i, x in got.items() if x}
    assert got == _plain_terms(rows)
    said = Counter(texts[i][a:b].lower() for i, x in got.items() for a, b in x)
    assert said["quorn"] == 16 and said["apikey"] == 25
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(re.search(r"quorn|apikey|@|[0-9a-f]{40}", t, re.I) for t in clean.values())


def test_secrets():
    found = lambda t: [t[a:b] for a, b, _ in pii.find_secrets(t, pii.find_patterns(t))]
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert found(f'token = "{key}"###') == [key]
    assert found("a-very-long-hyphenated-heading-2020-01-02 aaaaaaaaaaaaaaaaaaaaaaaaaaa 1111111111111111111111111") == []
    assert found(f"{key}@mail.example.com") == []


def test_copies_take_no_evidence_away(spark):
    """A name beside an address in 30 texts, one of which has 1,000 copies, also with changed words; a term of the copies alone proves nothing."""
    rnd = random.Random(9)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    say = lambda n: [rnd.choice(filler) for _ in range(n)]
    texts = [" ".join([*say(40), "Quorn", *say(1), "zq@mail.example.org", *say(40)]) for _ in range(30)]
    copied = [*say(60), "rareterm", "one@copy.example.com", *say(60)]
    for _ in range(300):
        near = list(copied)
        for at in rnd.sample([k for k in range(122) if k not in (60, 61)], 6):
            near[at] = rnd.choice(filler)
        texts.append(" ".join(near))
    texts += [texts[0]] * 1000 + [" ".join(say(60)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = Counter(texts[r.doc_id][t.start : t.end] for r in pii.find(df).collect() for t in r.terms)
    assert told == {"Quorn": 1030}


def test_rewriting():
    spans = [{"start": 3, "end": 8, "kind": "email"}, {"start": 6, "end": 10, "kind": "ip"}]
    assert pii.rewrite("ab 12345678 cd", spans, []) == "ab <EMAIL>8 cd"
    assert pii.rewrite("ab cd", [], [{"start": 0, "end": 2, "disclosure": 0.9}, {"start": 3, "end": 5, "disclosure": 1.0}]) == "<TERM> "
    assert pii.rewrite(None, [], []) is None


def test_query(spark, tmp_path):
    rows = [(1, "a@b.c 1.2.3.4 +1 234 567 890", "q"), (2, None, "q"), (3, "", "q"), (1, "a@b.c 1.2.3.4 +1 234 567 890", "q"), (None, "é 4111 1111 1111 1111", None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r)[:6] for r in op8_pii(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc, text, _ in rows:
        found = plain(text or "")
        n = Counter(k for _, _, k in found)
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in found)
        want.append((doc, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert op8_pii(spark, str(tmp_path / "e")).count() == 0
