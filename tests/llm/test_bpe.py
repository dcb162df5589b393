"""The automaton against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.queries import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.codec(f.read())


def _ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_toy_automaton_is_what_the_merges_give():
    """Every string over three letters, against merging by rank."""
    merges = [("a", "a"), ("b", "c"), ("a", "bc"), ("aa", "abc"), ("c", "c"), ("c", "aa")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *(x + y for x, y in merges)])}
    machine = bpe.Automaton(vocab, merges)
    rank = {m: k for k, m in enumerate(merges)}

    def by_rank(s):
        parts = list(s)
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
            best, _ = min(pairs)
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [vocab[p] for p in parts]

    for n in range(1, 9):
        for k in range(3**n):
            s = "".join("abc"[k // 3**i % 3] for i in range(n))
            ids = machine.encode_word(s.encode())
            assert ids == by_rank(s), s
            assert machine.decode(ids) == s
            # the automaton accepts this token sequence
            assert all(machine.has_arc(x, y) for x, y in zip(ids, ids[1:], strict=False))


def test_one_merge_per_token():
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("a", "aa"), ("aa", "a")])


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(codec, library, seed):
    rnd = random.Random(seed)
    pieces = ["a", "aa", "b", " ", "  ", "\n", "\t", "é", "ß", "日本", "<|endoftext|>", "'s", "'ll", "1", "23", "!", "\x1c", "\x85", "\xa0", "🙂", "the", "ing", " THE", "_"]
    for _ in range(1500):
        s = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30)))
        want = library.encode(s, add_special_tokens=False).ids
        assert _ids(codec, s) == want, s
        assert codec.decode(codec.encode(s)) == library.decode(want, skip_special_tokens=False)
    for _ in range(1500):
        s = "".join(chr(rnd.choice([rnd.randint(0, 0x2FF), rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(rnd.randint(1, 20)))
        assert _ids(codec, s) == library.encode(s, add_special_tokens=False).ids


def test_characters_that_are_new_to_unicode(codec, library):
    for c in sorted(codec._later)[::40]:
        s = f"a{c}1{c} {c}"
        assert _ids(codec, s) == library.encode(s, add_special_tokens=False).ids


def test_a_very_long_word(codec, library):
    s = "abcab" * 40_000
    assert _ids(codec, s) == library.encode(s, add_special_tokens=False).ids


def test_decode_replaces_bytes_that_are_no_text(codec, library):
    ids = library.encode("日本", add_special_tokens=False).ids[:1]
    assert codec.automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, library, tmp_path):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world", "x"), (None, "a\nb <|endoftext|>", None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op1_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op1_bpe(spark, str(tmp_path)).count() == 0


def test_ids_and_text(spark):
    from pyspark.sql import functions as F

    from millrace.llm.common import python_ready

    python_ready(spark)
    row = spark.createDataFrame([("naïve café",)], "text string").select(bpe.bpe(F.col("text"), PATH).alias("c")).first().c
    assert row.decoded == "naïve café" and len(row.ids) > 2


def test_other_kinds_of_tokenizers_are_refused():
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert bpe.unsupported(spec) == []
    for change in (
        {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": spec["model"] | {"ignore_merges": True}},
        {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
    ):
        with pytest.raises(ValueError, match="byte-level"):
            bpe.codec(json.dumps(spec | change))
