"""Each stage against brute force on its own input, and the whole against the stages."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from millrace.llm import mixing, pii, quality
from millrace.llm.common import settle

from .test_minhash import stay

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [say(rnd.randint(60, 160)) for _ in range(240)]
    texts += [texts[0]] * 6 + [texts[1] + " tail"] * 2 + [say(10), "", None, "x " * 100]
    texts += [f"{say(40)} mail me{k}@x.example.org or {say(30)}" for k in range(8)]
    return [(i, t, "en" if i % 5 else None, ["a", "b", "c", None][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark):
    """(docs, result) of every stage."""
    docs = settle(spark.createDataFrame(_rows(), COLUMNS).repartition(3))
    out = {}
    for name, stage in pipeline.STAGES:
        result = settle(stage(spark, docs, ""))
        out[name] = (docs.collect(), result.collect(), result)
        docs = result
    return out


def test_stages_keep_the_columns(stages):
    for _, (_, _, result) in list(stages.items())[:-1]:
        assert result.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(stages, spark):
    before, after, _ = stages["quality rules"]
    good = {r.doc_id for r in quality.judge(spark.createDataFrame(before, COLUMNS)).where("kept").collect()}
    assert {r.doc_id for r in after} == good and len(after) == len(good)
    plain_good = {r.doc_id for r in before if len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) >= 50 and "x x x" not in r.text}
    assert good == plain_good


def test_near_duplicates(stages):
    """By brute-force Jaccard of five-word shingles."""
    before, after, _ = stages["near duplicates"]
    assert sorted(r.doc_id for r in after) == sorted(stay(sorted((r.doc_id, r.text, "") for r in before)))
    assert len(after) < len(before)


def test_personal_data(stages):
    before, after, _ = stages["personal data"]
    got = {r.doc_id: r for r in after}
    assert len(got) == len(before) and sum("<EMAIL>" in r.text for r in after) == 8
    for r in before:
        assert got[r.doc_id].text == pii.rewrite(r.text, [{"start": a, "end": b, "kind": k} for a, b, k in pii.find_patterns(r.text)], [])
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_mixing(stages, spark):
    before, after, _ = stages["mixing"]
    times = {r.doc_id: r.times for r in mixing.mix(spark.createDataFrame(before, COLUMNS)).collect()}
    assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in times.items() if n})


def test_tokens(stages):
    import public_tokenizers

    before, after, _ = stages["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in before}
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    for r in after:
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(stages, spark, tmp_path):
    spark.createDataFrame(_rows(), COLUMNS).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["tokens"][1])


def test_empty_table_and_further_columns(spark):
    docs = spark.createDataFrame([], COLUMNS + ", rid string, fp int, row int, kept boolean, times int, spans string")
    for _, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, ""))
        assert docs.count() == 0


def test_clashing_columns(spark):
    rows = [(*r, "r", 1, 2, True, 3, "s") for r in _rows()]
    docs = spark.createDataFrame(rows, COLUMNS + ", rid string, fp int, row int, kept boolean, times int, spans string")
    columns = docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, ""))
        assert docs.columns == columns and docs.count() > 0
