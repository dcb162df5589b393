"""Byte-pair encoding and decoding by a compiled tokenization automaton.

**Compilation.**  Start with the automaton that accepts every byte string: one
state per byte (the last arc taken), each with an arc for every byte.  Then
apply one *merge gadget* per merge rule, in order of priority.  The gadget of
``(u, v) -> w``

1. adds the state ``w`` with a copy of the arcs that leave ``v`` at that time,
2. removes the arc ``v`` from the state ``u``,
3. gives an arc ``w`` to every state that still has an arc ``u``.

After the last gadget the automaton accepts exactly the token sequences that
the merges produce, is deterministic, and each arc is labelled with the bytes
of its token.  Rows are not stored: a gadget copies a state and a column of
arcs, so it is recorded by its time and its two parts, next to the removed
arcs; whether a state has an arc follows by going back through the copies, and
answers are kept in a table.

**Encoding.**  A word is read byte by byte.  A second table (the arc labels as
a trie with failure links) gives the labels that end at each byte; the one
label whose arc may leave the state reached where the label begins is taken.
Exactly one fits, since the automaton is deterministic and accepts every
string.  The word's tokens are then read off backwards.  Time is linear in the
word, however long it is.

**Decoding** emits the arc labels and reads the bytes as UTF-8, with the
replacement character for what isn't.

Defined cases: a null text counts as empty (no tokens, the digests of the empty
string); the string of a special token in a text becomes that token; a very
long text is encoded as a whole; repeated rows are all returned; an empty table
gives an empty result; further columns of the input, whatever their names, are
kept apart and never looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a text into words ahead of the merges (fixed values of byte-level BPE).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def later_letters() -> frozenset[str]:
    """Characters that the ``regex`` module takes for letters or numbers and Python's Unicode tables don't know yet."""
    known = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", known) if unicodedata.category(c) == "Cn")


#: A worker remembers the tokens of twice so many words at most, none longer than this.
MEMO_WORDS, MEMO_CHARS = 150_000, 64
#: And so many entries of the transition tables.
MEMO_ARCS = 300_000


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """The compiled automaton of a byte-level BPE vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        to_byte = byte_of_char()
        self.special = special or {}
        size = max([*vocab.values(), *self.special.values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        for text, token in vocab.items():
            self.labels[token] = bytes(to_byte[c] for c in text)
        for text, token in self.special.items():
            self.labels[token] = text.encode()
        self.birth = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        made = [i for t, i in vocab.items() if len(t) == 1]
        for time, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.left[w] >= 0 or len(a + b) < 2:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.birth[w], self.left[w], self.right[w] = time, u, v
            self.removed[u, v] = time
            made.append(w)
        self._arcs: dict[int, bool] = {}
        self._steps: dict[int, int] = {}
        self._trie(made)

    def has_arc(self, state: int, arc: int) -> bool:
        """Whether the token ``arc`` may follow the token ``state``."""
        key = state << 20 | arc
        if len(self._arcs) >= MEMO_ARCS:
            self._arcs.clear()
        removed, birth, never = self.removed, self.birth, len(self.removed) + 1
        time = never
        while True:
            if removed.get((state, arc), never) < time:
                found = False
                break
            if birth[arc] < 0 and birth[state] < 0:
                found = True
                break
            if birth[arc] >= birth[state]:  # gadget step 3, after the removal
                time = birth[arc] + 1
                arc = self.left[arc]
            else:  # gadget step 1, before the removal
                time = birth[state]
                state = self.right[state]
        self._arcs[key] = found
        return found

    def _trie(self, made: list[int]) -> None:
        """Transitions over bytes that tell which arc labels end at a byte."""
        go: dict[int, int] = {}
        token, depth = [-1], 1
        below: list[list[tuple[int, int]]] = [[]]
        for t in made:
            node = 0
            for b in self.labels[t]:
                key = node << 8 | b
                nxt = go.get(key)
                if nxt is None:
                    nxt = go[key] = depth
                    depth += 1
                    token.append(-1)
                    below.append([])
                    below[node].append((b, nxt))
                node = nxt
            token[node] = t
        fail, link = [0] * depth, [-1] * depth
        queue = deque(n for _, n in below[0])
        while queue:
            node = queue.popleft()
            for b, nxt in below[node]:
                f = fail[node]
                while f and (f << 8 | b) not in go:
                    f = fail[f]
                fail[nxt] = go.get(f << 8 | b, 0)
                queue.append(nxt)
            f = fail[node]
            link[node] = f if token[f] >= 0 else link[f]
        self._go, self._token, self._fail, self._link = go, token, fail, link
        self._first = [n if token[n] >= 0 else link[n] for n in range(depth)]
        self._size = list(map(len, self.labels))

    def _step(self, node: int, b: int) -> int:
        """The trie node after one more byte, by way of the failure links."""
        go, fail, key = self._go, self._fail, node << 8 | b
        while (nxt := go.get(node << 8 | b)) is None and node:
            node = fail[node]
        if nxt is None:
            raise ValueError(f"the vocabulary has no token for the byte {b}")
        if len(self._steps) >= MEMO_ARCS:
            self._steps.clear()
        self._steps[key] = nxt
        return nxt

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        token, link, first, size, arcs, steps = self._token, self._link, self._first, self._size, self._arcs, self._steps
        last = [-1]
        node = end = 0
        for b in word:
            end += 1
            nxt = steps.get(node << 8 | b)
            node = self._step(node, b) if nxt is None else nxt
            at = first[node]
            while True:
                t = token[at]
                begin = end - size[t]
                if not begin:
                    break
                known = arcs.get(last[begin] << 20 | t)
                if self.has_arc(last[begin], t) if known is None else known:
                    break
                at = link[at]
            last.append(t)
        out = []
        while end:
            t = last[end]
            out.append(t)
            end -= size[t]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers.

    Two generations of bounded size: when the younger is full, it becomes the older, from which words in use come back.
    """

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            tokens = self.automaton.encode_word(word.encode())
            ids = struct.pack(f"<{len(tokens)}I", *tokens)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self._words = _Words(automaton)
        self._findall = regex.compile(SPLIT).findall
        self._later = later_letters()
        special = sorted(automaton.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _split(self, text: str) -> list[str]:
        """The pre-split words.

        Versions of Unicode differ in few characters; a text with one of them is split by the tokenizer's library.
        """
        if text.isascii() or _is_latin(text) or self._later.isdisjoint(text):
            return self._findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._split(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.automaton.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist())


def unsupported(spec: dict[str, object]) -> list[str]:
    """What a tokenizer file asks for that the automaton doesn't do.

    Truncation, padding and post-processing don't count: texts are encoded without special tokens, as a whole.
    """
    model, split, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    why = [] if model.get("type", "BPE") == "BPE" else [f"model {model['type']}"]
    if spec.get("normalizer"):
        why.append("a normalizer")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        why.append("another pre-tokenizer")
    if decoder.get("type") != "ByteLevel":
        why.append("another decoder")
    why += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    why += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    return why


@lru_cache(maxsize=2)
def codec(tokenizer_json: str) -> Codec:
    """Compiled once per worker from the JSON text of a byte-level BPE tokenizer; other kinds are refused."""
    spec = json.loads(tokenizer_json)
    model = spec["model"]
    if why := unsupported(spec):
        raise ValueError(f"this tokenizer isn't plain byte-level BPE: {', '.join(why)}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Codec(Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])}))


def _compiled(path: str, known: dict[str, Codec] = {}) -> Codec:  # noqa: B006 - one table per worker
    if path not in known:
        with open(path, encoding="utf-8") as f:
            known[path] = codec(f.read())
    return known[path]


def bpe(text: Column, path: str, digests: bool = False) -> Column:
    """Struct column of a text: ids (array of int) and decoded, or, with ``digests``, what identifies them.

    ``path`` is a tokenizer file that every worker has, such as one of an installed package.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        c = _compiled(path)
        ids = (c.encode(t.as_py()) for t in texts)
        if digests:
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(c.decode(i).encode()).hexdigest()) for i in ids]
            kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        else:
            rows = [(np.frombuffer(i, "<u4").astype(np.int32), c.decode(i)) for i in ids]
            kinds = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names=[n for n, _ in kinds])

    return run(text)
