"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import freed, fresh, give_back, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
NO_PAIR = 1 << 62
#: Words after a space that a worker keeps, in each of two generations; a third of it of words that begin a line, and of endings.
CACHED = 210_000
#: Characters of text whose new words are encoded together.
BLOCK = 1 << 22
#: The part of both that a thrifty worker takes.
THRIFTY = 4


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoGenerations(dict):
    """A bounded cache: at most 2 * size entries; what was used lately stays.

    make(key) gives the value and whether to keep it.
    """

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value, keep = self.make(key)
            if not keep:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def merge_all(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the leftmost pair of the lowest rank until no pair can be merged.

    Leaf i of the tree holds rank << 32 | i for the pair of symbol i and its right
    neighbour, each inner node the least of its children: the root is the next merge.
    A merge changes three leaves, each in logarithmic time.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get((symbols[i], symbols[i + 1]))) is not None:
            tree[size + i] = r[0] << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    symbols = list(symbols)
    right = list(range(1, n + 1))  # n: none
    left = list(range(-1, n - 1))

    while (root := tree[1]) != NO_PAIR:
        i = root & 0xFFFFFFFF
        j = right[i]
        merged = symbols[i] = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        after = right[i] = right[j]
        tree[size + j] = tree[size + i] = NO_PAIR
        if after < n:
            left[after] = i
            if (r := get((merged, symbols[after]))) is not None:
                tree[size + i] = r[0] << 32 | i
        low = i
        if (before := left[i]) >= 0:
            r = get((symbols[before], merged))
            tree[size + before] = NO_PAIR if r is None else r[0] << 32 | before
            low = before
        low, high = (size + low) >> 1, (size + j) >> 1
        while low:  # the parents of the three leaves, level by level
            for k in range(low, high + 1):
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
            low >>= 1
            high >>= 1
    return [s for s in symbols if s >= 0]


class MergeTable:
    """Ranks and results of the mergeable pairs, as sorted arrays."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 20 | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], -1)
        self.rank, self.into = (np.array([v[k] for v in ranks.values()], np.int64)[order] for k in (0, 1))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each pair, and whether it can be merged."""
        keys = left << 20 | right
        at = np.searchsorted(self.keys[:-1], keys)
        return at, (self.keys[at] == keys) & (left >= 0) & (right >= 0)


def merge_many(rows: list[list[int]], table: MergeTable) -> list[np.ndarray]:
    """merge_all of many short rows, whose trees grow and shrink side by side: row w of each array is one word's."""
    n = max(map(len, rows))
    size = 1 << max(1, (n - 1).bit_length())
    count = len(rows)
    lengths = np.array([len(r) for r in rows])
    symbols = np.full((count, n + 1), -1, np.int64)
    symbols[np.arange(n + 1)[None, :] < lengths[:, None]] = np.concatenate([np.array(r, np.int64) for r in rows])
    right = np.tile(np.arange(1, n + 2), (count, 1))
    left = np.tile(np.arange(-1, n), (count, 1))
    tree = np.full((count, 2 * size), NO_PAIR, np.int64)

    def leaf(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        at, good = table.find(symbols[w, i], symbols[w, j])
        tree[w, size + i] = np.where(good, table.rank[np.where(good, at, 0)] << 32 | i, NO_PAIR)

    for i in range(n - 1):
        leaf(np.arange(count), np.full(count, i), np.full(count, i + 1))
    for i in range(size - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
    while len(w := np.flatnonzero(tree[:, 1] != NO_PAIR)):
        i = tree[w, 1] & 0xFFFFFFFF
        j = right[w, i]
        at, _ = table.find(symbols[w, i], symbols[w, j])
        symbols[w, i] = table.into[at]
        symbols[w, j] = -1
        after = right[w, i] = np.minimum(right[w, j], n)
        left[w, after] = i
        tree[w, size + j] = NO_PAIR
        leaf(w, i, after)
        before = left[w, i]
        has = before >= 0
        leaf(w[has], before[has], i[has])
        for changed in (j, i, np.where(has, before, i)):
            k = (size + changed) >> 1
            while k[0]:
                tree[w, k] = np.minimum(tree[w, 2 * k], tree[w, 2 * k + 1])
                k >>= 1
    return [r[r >= 0] for r in symbols]


#: A chunk that begins or ends with one of these isn't separate from its neighbours.
_SPACE = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 ᠎    　﻿" + "".join(map(chr, range(0x2000, 0x2010))))


def separate(part: str) -> bool:
    """Whether the text between two spaces is encoded alike whatever stands beyond them."""
    return bool(part) and part[0] not in _SPACE and part[-1] not in _SPACE


_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.uint32).tobytes()


def _letters(s: str) -> bool:
    """Only letters of the Latin blocks, on which all versions of Unicode agree."""
    return s.isalpha() and max(s) < "\u0250"


_WORDS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class ChunkedEncoder:
    """Token ids of whole texts, as packed 32-bit integers.

    A single space between two characters that aren't white space always begins a
    word, so the pieces between such spaces are encoded one by one and kept; texts
    with other white space beside a space are encoded at once. The words that a block of
    texts needs and that aren't kept are encoded together.
    """

    def __init__(self, encode_whole, encode_words, kept: int = CACHED, block: int = BLOCK):
        self.block_size = block
        self.encode_whole, self.encode_words = encode_whole, encode_words  # str -> ids; words -> packed ids of each
        self.ready: dict[str, bytes] = {}
        self.tails = TwoGenerations(lambda s: (self._word(s), len(s) < 9), kept // 3)
        self.line_end = _packed(encode_whole("\n"))
        self.spaced = TwoGenerations(lambda s: self._piece(s, " "), kept)
        self.bare = TwoGenerations(lambda s: self._piece(s, ""), kept // 3)

    def forget(self) -> None:
        """Let go of all words that are kept."""
        for kept in (self.tails, self.spaced, self.bare):
            kept.forget()

    def _word(self, word: str) -> bytes:
        return self.ready.get(word) or self.encode_words([word])[0]

    def prepare(self, texts: list[str]) -> None:
        """Encode the words of the texts that aren't kept."""
        parts = set()
        for t in texts:
            parts.update(t.split(" "))
        spaced, bare, old_spaced, old_bare = self.spaced, self.bare, self.spaced.old, self.bare.old
        words = set()
        for part in parts:
            if part in spaced or part in old_spaced:
                continue
            for m in _WORDS.finditer(part):
                if m.start():
                    if (w := m.group()) not in bare and w not in old_bare:
                        words.add(w)
                elif (w := m.group()) not in spaced and w not in old_spaced:
                    words.add(" " + w)
        listed = [w for w in words if len(w) < 30]
        self.ready = dict(zip(listed, self.encode_words(listed))) if listed else {}

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """packed of each text, block by block."""
        out, block, size = [], [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= self.block_size:
                self.prepare(block)
                out += map(self.packed, block)
                block, size = [], 0
        self.prepare(block)
        out += map(self.packed, block)
        self.ready = {}
        return out

    def _piece(self, part: str, ahead: str) -> tuple[bytes, bool]:
        """Of part after the space ahead or a line end, and whether to keep it.

        One byte, which is no whole number of ids, if part isn't separate. A single
        line end between other characters is a token of its own, and so is
        punctuation that ends a word.
        """
        if not separate(part):
            return b"!", True
        if _letters(part):
            return self._word(ahead + part), len(part) < 60
        if (word := part.rstrip(_PUNCTUATION)) and _letters(word):
            return (self.spaced if ahead else self.bare)[word] + self.tails[part[len(word):]], len(part) < 8
        if "\n" in part:
            first, *rest = part.split("\n")
            parts = [(self.spaced if ahead else self.bare)[first], *(self.bare[p] for p in rest)]
            if b"!" not in parts:
                return self.line_end.join(parts), False
        return _packed(self.encode_whole(ahead + part)), len(part) < 60

    def packed(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1] in _SPACE:
            return _packed(self.encode_whole(text))
        parts = list(map(self.spaced.__getitem__, rest))
        if b"!" in parts:
            return _packed(self.encode_whole(text))
        return _packed(self.encode_whole(first)) + b"".join(parts)


class SegmentTreeBPE:
    """A byte-level BPE vocabulary, encoded by merge_all and decoded by look-up."""

    def __init__(self, path: str, thrifty: bool = False):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        self.of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.table = MergeTable(self.ranks)
        self.encoder = ChunkedEncoder(self.encode, self.encode_words, *(n // THRIFTY if thrifty else n for n in (CACHED, BLOCK)))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word; short words of like lengths are merged side by side."""
        if len(words) < 16:
            return [_packed(self.encode_word(w)) for w in words]
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(words)
        for low, high in ((1, 8), (9, 16), (17, 64)):
            some = [k for k, r in enumerate(raw) if low <= len(r) <= high]
            if some:
                for k, ids in zip(some, merge_many([[self.of_byte[b] for b in raw[k]] for k in some], self.table)):
                    out[k] = ids.astype(np.uint32).tobytes()
        for k, r in enumerate(raw):
            if len(r) > 64:
                out[k] = _packed(self.encode_word(words[k]))
        return out

    def encode_word(self, word: str) -> list[int]:
        return merge_all([self.of_byte[b] for b in word.encode()], self.ranks)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        while text:
            at, special = min(((p, s) for s in self.added if (p := text.find(s)) >= 0), default=(len(text), ""))
            part = text[:at]
            for _, (a, b) in self.split(part) if part else ():
                ids += self.encode_word(part[a:b])
            if special:
                ids.append(self.added[special])
            text = text[at + len(special):]
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str, thrifty: bool = False) -> SegmentTreeBPE:
    return SegmentTreeBPE(path, thrifty)


def list_of_packed(packed: list[bytes]) -> pa.ListArray:
    """A list column from 32-bit integers, without a Python object for each."""
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def bpe_encode(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """Add the column out: array of token ids of the whole text.

    A null or empty text has an empty array; texts of any length are encoded whole,
    repeated rows alike. Strings of special tokens in a text become those tokens. An
    existing column of the name out is replaced, all others pass through. An empty df gives no rows.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        return list_of_packed(load(path).encoder.packed_all(texts.to_pylist()))

    return df.withColumn(out, encode(text_or_empty(text)))


def bpe_decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """Add the column out: the text that the ids stand for; invalid UTF-8 becomes U+FFFD.

    A null or empty array gives an empty text, repeated rows are decoded alike. An existing column
    of the name out is replaced, all others pass through. An empty df gives no rows.
    """

    @F.arrow_udf(T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        bpe = load(path)
        values, offsets = column.values.to_numpy(), column.offsets.to_pylist()
        return pa.array([bpe.decode(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string())

    return df.withColumn(out, decode(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def slices(texts: pa.Array, most: int = BLOCK) -> Iterator[list[str]]:
    """The texts as lists of at most so many bytes, or of one longer text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset:texts.offset + len(texts) + 1]
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield texts.slice(begin, end - begin).to_pylist()
        begin = end


def forgotten(batches: Iterator, bpe: SegmentTreeBPE) -> Iterator:
    """freed, and the worker forgets its words at the end: it may stand idle beside those of other stages."""
    try:
        yield from freed(batches)
    finally:
        bpe.encoder.forget()
        give_back()


def bpe_round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str = VOCABULARY, thrifty: bool = False) -> DataFrame:
    """bpe_encode, and bpe_decode of the ids that it gave, in one step.

    It gives what the two give one after the other, but a task has one Python worker
    and holds the lists of a few megabytes of text at a time. A thrifty worker keeps a quarter of the words, takes a quarter of
    the text at a time, and lets go of all words at the end of a task: it costs time, and leaves memory to the workers of other stages. Nulls, empty texts and
    existing columns of those names are as there.
    """

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, thrifty)
        for batch in forgotten(batches, bpe) if thrifty else freed(batches):
            for texts in slices(batch, bpe.encoder.block_size):
                packed = bpe.encoder.packed_all(texts)
                back = pa.array((bpe.decode(np.frombuffer(p, np.uint32).tolist()) for p in packed), pa.string())
                yield pa.StructArray.from_arrays([list_of_packed(packed), back], ["ids", "decoded"])

    coded = both(text_or_empty(text))
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())]
    both_of = fresh("_coded", df)
    return df.select(*others, coded.alias(both_of)).select(*others, F.col(f"{both_of}.ids").alias(ids), F.col(f"{both_of}.decoded").alias(decoded))
