"""Token files: a wavelet matrix of token ids per block, in one compressed file per shard.

A shard is a Parquet file whose rows are blocks of whole documents in ascending order
of their ids. A block holds bit-planes, highest bit first; each plane is the bits of
the ids in the order that the planes above leave (zeros first, else in order), with
the number of ones ahead of each 512 bits, so that rank takes constant time and
access, counting and search need one step a plane.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.bpe import VOCABULARY, TwoGenerations, byte_alphabet, separate
from pulseframe.llm.common import shuffle_files_go_at_the_end, text_or_empty

END_ID = 2
#: A block is closed once it has so many ids; a document is never split.
BLOCK_IDS = 1 << 20
#: Words that a worker keeps, in each of two generations.
KEPT_WORDS = 500_000
#: Characters of text that are cut into words together, and words that are one call's text.
BLOCK, JOINED = 1 << 23, 2048
#: A word of Latin letters and the punctuation at its end: byte-level pre-tokenizers cut it between the two and nowhere else.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
PLAIN = f"^{LETTERS}[!-/:-@\\[-`{{-~]*$"
SUPER = 64  # bytes of a plane between two rank counts
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """A sequence of unsigned integers under 2**bits, as succinct bit-planes."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        now = np.ascontiguousarray(values, np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for bit in range(bits - 1, -1, -1):
            on = (now & now.dtype.type(1 << bit)) != 0
            low = np.compress(~on, now)  # several times as fast as now[~on]
            planes.append(np.packbits(on, bitorder="little"))
            zeros.append(len(low))
            ranks.append(cls._directory(planes[-1]))
            now = np.concatenate([low, np.compress(on, now)])
        return cls(len(values), bits, planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(_ONES[plane], np.arange(0, len(plane), SUPER), dtype=np.uint32) if len(plane) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QB", self.n, self.bits) + struct.pack(f"<{self.bits}Q", *self.zeros)
        return head + b"".join(p.tobytes() for p in self.planes) + b"".join(r.tobytes() for r in self.ranks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        n, bits = struct.unpack_from("<QB", data)
        zeros = list(struct.unpack_from(f"<{bits}Q", data, 9))
        at, size = 9 + 8 * bits, -(-n // 8)
        planes = [np.frombuffer(data, np.uint8, size, at + k * size) for k in range(bits)]
        at, count = at + bits * size, -(-size // SUPER) + 1
        ranks = [np.frombuffer(data, np.uint32, count, at + 4 * k * count) for k in range(bits)]
        return cls(n, bits, planes, zeros, ranks)

    def _ones_ahead(self, k: int, i: int) -> int:
        whole = i // 8
        at = whole // SUPER
        out = int(self.ranks[k][at]) + int(_ONES[self.planes[k][at * SUPER:whole]].sum())
        return out + (int(self.planes[k][whole] & (1 << i % 8) - 1).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            on = int(self.planes[k][i // 8]) >> i % 8 & 1
            ones = self._ones_ahead(k, i)
            value, i = value << 1 | on, self.zeros[k] + ones if on else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the value's run on the last level begins, and how many of the first i values are in it."""
        begin = 0
        for k in range(self.bits):
            a, b = self._ones_ahead(k, begin), self._ones_ahead(k, i)
            if value >> self.bits - 1 - k & 1:
                begin, i = self.zeros[k] + a, self.zeros[k] + b
            else:
                begin, i = begin - a, i - b
        return begin, i - begin

    def count(self, value: int, i: int | None = None) -> int:
        """How many of the first i values (all by default) equal value."""
        return self._range(value, self.n if i is None else i)[1]

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence, from 0."""
        begin, n = self._range(value, self.n)
        if not 0 <= nth < n:
            raise IndexError("no such occurrence")
        at = begin + nth
        for k in range(self.bits - 1, -1, -1):
            on = value >> self.bits - 1 - k & 1
            at = self._select_bit(k, on, at - self.zeros[k] if on else at)
        return at

    def _select_bit(self, k: int, on: int, nth: int) -> int:
        low, high = 0, self.n - 1
        while low < high:
            middle = (low + high) // 2
            ones = self._ones_ahead(k, middle + 1)
            if (ones if on else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]

    def values(self) -> np.ndarray:
        """All values in order, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            on = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            now[self.zeros[k]:] |= now.dtype.type(1 << self.bits - 1 - k)
            back = np.empty_like(now)
            back[np.flatnonzero(~on)], back[np.flatnonzero(on)] = now[: self.zeros[k]], now[self.zeros[k]:]
            now = back
        return now


def gathered(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of values (starts has one more than they are) in the order which, and their ends."""
    sizes = starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0], ends
    return values[np.repeat(starts[which] - (ends - sizes), sizes) + np.arange(ends[-1])], ends


class LibraryEncoder:
    """Token ids of whole texts by the tokenizers library, as packed 32-bit integers.

    The texts of a block are cut at their spaces; each different piece is encoded
    once, with the space ahead of it, and short ones are kept for later blocks. A text
    with a piece that isn't separate from its neighbours is encoded at once. Plain words
    go to the vocabulary's model cut and spelled as the pre-tokenizer would, which is
    most of its work.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.bits = max(vocabulary.values()).bit_length()
        self.spelled = {b: c for c, b in byte_alphabet().items()}
        space, self.spelled[10] = self.spelled[32], " "  # a line end is where to cut
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        split, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        # words alone are looked up, so an added token that holds punctuation isn't in one
        byte_level = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        self.usual = byte_level and self.tokenizer.normalizer is None and all(t.content.strip(PUNCTUATION) != t.content for t in added)
        self.endings = TwoGenerations(lambda s: (self.whole([s])[0], True), 4096)
        self.begins = np.zeros(1 << self.bits, bool)  # ids of tokens that begin with a space
        self.begins[[i for token, i in vocabulary.items() if token.startswith(space)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([4 * len(x) for x in ids]).tolist()
        packed = np.fromiter((i for x in ids for i in x), np.uint32, ends[-1] // 4 if ends else 0).tobytes()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def spaced(self, parts: list[str], plain: bool) -> list[bytes]:
        """Packed ids of a space and each part; they are kept for later if the part is short."""
        out = list(map(self.now.get, parts))
        unknown = [k for k, x in enumerate(out) if x is None]
        names = [parts[k] for k in unknown]
        held = list(map(self.old.get, names))
        made = iter(self._joined([p for p, x in zip(names, held) if x is None], plain))
        fresh = {}
        for k, p, x in zip(unknown, names, held):
            out[k] = x = next(made) if x is None else x
            if len(p) < 60:
                fresh[p] = x
        if len(self.now) + len(fresh) > self.kept:
            self.now, self.old = {}, self.now
        self.now.update(fresh)
        return out

    def _joined(self, parts: list[str], plain: bool) -> list[bytes]:
        """The parts are encoded as one text, in which a part begins where a token begins with a space."""
        out: list[bytes] = []
        groups = [parts[k:k + JOINED] for k in range(0, len(parts), JOINED)]
        if plain:
            texts = [("\n".join([" " + w for w in g])).encode().decode("latin-1").translate(self.spelled) for g in groups]
        else:
            texts = [" " + " ".join(g) for g in groups]
        joined = (self.model if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        for group, coded in zip(groups, joined):
            ids = np.array(coded.ids, np.uint32)
            starts = np.flatnonzero(self.begins[ids]) * 4
            if len(starts) != len(group):  # an added token took the space beside it
                out += self.whole([" " + p for p in group])
                continue
            packed, starts = ids.tobytes(), starts.tolist()
            out += [packed[a:b] for a, b in zip(starts, [*starts[1:], len(packed)])]
        return out

    def pieces(self, parts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, starts, missing: the ids of a space and each part that is inside, none for all others, and which of those inside aren't separate."""
        plain = inside & pc.match_substring_regex(parts, PLAIN).to_numpy(zero_copy_only=False) if self.usual else np.zeros(len(parts), bool)
        usual = parts.filter(pa.array(plain))
        words = pc.utf8_rtrim(usual, characters=PUNCTUATION).dictionary_encode()
        endings = pc.replace_substring_regex(usual, f"^{LETTERS}", "").dictionary_encode()
        other = np.flatnonzero(inside & ~plain)
        names = parts.take(pa.array(other)).to_pylist()
        alone = np.array(list(map(separate, names)), bool)
        missing = np.zeros(len(parts), bool)
        missing[other[~alone]] = True
        other, names = other[alone], [p for p, x in zip(names, alone.tolist()) if x]
        coded = [b"", *self.spaced(words.dictionary.to_pylist(), True), *(self.endings[e] for e in endings.dictionary.to_pylist()), *self.spaced(names, False)]
        two = np.zeros((len(parts), 2), np.int64)  # a part is a word and its ending, or one other piece
        two[plain, 0] = words.indices.to_numpy() + 1
        two[plain, 1] = endings.indices.to_numpy() + 1 + len(words.dictionary)
        two[other, 0] = np.arange(len(coded) - len(other), len(coded))
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)])
        ids, ends = gathered(np.frombuffer(b"".join(coded), np.uint32), starts, two.ravel())
        return ids, np.concatenate([[0], ends[1::2]]), missing

    def block(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        at, parts = coded.indices.to_numpy(), coded.dictionary
        heads = ends[:-1]
        first = np.zeros(len(at), bool)
        first[heads] = True
        inside = np.zeros(len(parts), bool)  # parts that stand after a space somewhere
        inside[at[~first]] = True
        ids, starts, missing = self.pieces(parts, inside)
        odd = np.add.reduceat(missing[at] & ~first, heads, dtype=np.int64) > 0
        head = parts.take(pa.array(at[heads])).to_pylist()
        odd |= np.array([not separate(h) for h in head], bool)
        odd = odd.tolist()
        ahead = self.whole([t if o else h for t, h, o in zip(texts, head, odd)])
        at = at.astype(np.int64)
        at[heads] = len(parts)  # no ids: a head has no space ahead
        rest, to = gathered(ids, np.append(starts, starts[-1]), at)
        packed, to = rest.tobytes(), np.concatenate([[0], to * 4])
        return [x if o else x + packed[a:b] for x, o, a, b in zip(ahead, odd, to[heads].tolist(), to[ends[1:]].tolist())]

    def packed_all(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, block by block."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= BLOCK:
                yield from self.block(held)
                held, size = [], 0
        if held:
            yield from self.block(held)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


BLOCKS = "shard long, block long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, matrix binary"
_BLOCKS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("matrix", pa.binary())])


def write_tokens(df: DataFrame, to: str, id_column: str = "doc_id", text: str = "text", path: str = VOCABULARY, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append end_id, and write shards in ascending order of the ids.

    A null or empty text has the end id alone. Null ids come first; rows that share
    an id are in order of their texts. Other columns are ignored. An empty df writes
    no block.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        end = np.array([end_id], np.uint32).tobytes()
        shard, block = TaskContext.get().partitionId(), 0
        ids, lengths, packed, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(packed), np.uint32), encoder.bits).to_bytes()
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "n_ids": [total], "doc_ids": [ids], "lengths": [lengths], "matrix": [matrix]}, _BLOCKS)

        for batch in batches:
            for i, one in zip(batch.column(0).to_pylist(), encoder.packed_all(batch.column(1).to_pylist())):
                one += end
                ids.append(i)
                lengths.append(len(one) // 4)
                packed.append(one)
                total += lengths[-1]
                if total >= block_ids:
                    yield close()
                    block, ids, lengths, packed, total = block + 1, [], [], [], 0
        if ids:
            yield close()

    rows = df.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text).alias("text"))
    sorted_rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    with shuffle_files_go_at_the_end(df.sparkSession):
        sorted_rows.mapInArrow(build, BLOCKS).write.option("compression", "zstd").parquet(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """One row per document of the files: shard, block, doc_id, ahead (ids before it in its block), n_tokens, ids (unsigned 32-bit, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, ids, lengths, matrix = (batch.column(k)[row].as_py() for k in range(5))
                values = WaveletMatrix.from_bytes(matrix).values().astype("<u4")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(ids), pa.int64()),
                        pa.array([block] * len(ids), pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array(ends - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([values[e - n:e].tobytes() for e, n in zip(ends.tolist(), lengths)], pa.binary()),
                    ],
                    ["shard", "block", "doc_id", "ahead", "n_tokens", "ids"],
                )

    files = spark.read.schema(BLOCKS).parquet(at)
    return files.select("shard", "block", "doc_ids", "lengths", "matrix").mapInArrow(read, "shard long, block long, doc_id long, ahead long, n_tokens long, ids binary")


def block_starts(spark: SparkSession, at: str) -> DataFrame:
    """(shard, block, first): ids of all documents ahead of each block. Only the shards, one row each, meet in one window."""
    blocks = spark.read.schema(BLOCKS).parquet(at).select("shard", "block", "n_ids")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(ahead(Window.orderBy("shard"))), F.lit(0)).alias("shard_first"))
    inside = F.coalesce(F.sum("n_ids").over(ahead(Window.partitionBy("shard").orderBy("block"))), F.lit(0))
    return blocks.withColumn("inside", inside).join(shards, "shard").select("shard", "block", (F.col("shard_first") + F.col("inside")).alias("first"))


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int], np.ndarray, WaveletMatrix]]:
    """(shard, block, doc_ids, ends of the documents, matrix) of rows (shard, block, doc_ids, lengths, matrix); nothing is decoded."""
    for batch in batches:
        for row in range(batch.num_rows):
            shard, block, ids, lengths, matrix = (batch.column(k)[row].as_py() for k in range(5))
            yield shard, block, ids, np.cumsum(lengths), WaveletMatrix.from_bytes(matrix)


def _blocks(spark: SparkSession, at: str, shard: int | None) -> DataFrame:
    files = spark.read.schema(BLOCKS).parquet(at)
    files = files if shard is None else files.filter(F.col("shard") == shard)
    return files.select("shard", "block", "doc_ids", "lengths", "matrix")


def count_tokens(spark: SparkSession, at: str, tokens: list[int], shard: int | None = None) -> DataFrame:
    """(shard, token, n) of every shard, or one: how often it has each of the tokens, 0 too, by ranks in its matrices.

    Repeated tokens count once. Files without blocks, and no tokens, give no rows.
    """
    wanted = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, _, _, matrix in _per_block(batches):
            n = [matrix.count(t) if t >> matrix.bits == 0 else 0 for t in wanted]
            yield pa.RecordBatch.from_pydict({"shard": [shard] * len(wanted), "token": wanted, "n": n}, pa.schema([(c, pa.int64()) for c in ("shard", "token", "n")]))

    return _blocks(spark, at, shard).mapInArrow(count, "shard long, token long, n long").groupBy("shard", "token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, at: str, tokens: list[int], shard: int | None = None) -> DataFrame:
    """(shard, token, position, doc_id, place) of every occurrence of the tokens: where it stands in its shard and in its document, from 0, by selection in the matrices.

    Documents with null ids have a null doc_id. Files without blocks, and no tokens, give no rows.
    """
    wanted = sorted(set(tokens))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, block, ids, ends, matrix in _per_block(batches):
            for t in wanted:
                if t >> matrix.bits:
                    continue
                found = np.array(matrix.occurrences(t), np.int64)
                doc = np.searchsorted(ends, found, "right")
                place = found - np.concatenate([[0], ends])[doc]
                yield pa.RecordBatch.from_pydict(
                    {"shard": [shard] * len(found), "block": [block] * len(found), "token": [t] * len(found), "inside": found, "doc_id": [ids[d] for d in doc], "place": place},
                    pa.schema([(c, pa.int64()) for c in ("shard", "block", "token", "inside", "doc_id", "place")]),
                )

    found = _blocks(spark, at, shard).mapInArrow(find, "shard long, block long, token long, inside long, doc_id long, place long")
    return found.join(shard_starts(spark, at), ["shard", "block"]).select("shard", "token", (F.col("ahead") + F.col("inside")).alias("position"), "doc_id", "place")


def shard_starts(spark: SparkSession, at: str) -> DataFrame:
    """(shard, block, ahead, n_ids): ids of a shard ahead of each of its blocks, and in it."""
    blocks = spark.read.schema(BLOCKS).parquet(at).select("shard", "block", "n_ids")
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("ahead"), "n_ids")


def access_tokens(spark: SparkSession, at: str, positions: DataFrame) -> DataFrame:
    """positions (shard, position) with the token that stands there; a position that its shard doesn't have gets null.

    Positions meet their block by the last start at or below them; each block answers its own by bits and
    ranks. Repeated positions get equal tokens, null ones null. No positions give no rows.
    """
    starts = shard_starts(spark, at)
    marks = starts.select("shard", F.col("ahead").alias("position"), F.lit(0).alias("kind"), "block", "ahead", "n_ids").unionByName(
        positions.select("shard", F.col("position").cast("long").alias("position"), F.lit(1).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("block", "ahead", "n_ids")))
    )
    before = Window.partitionBy("shard").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, 0)
    asked = marks.select("shard", "position", "kind", *(F.last(c, ignorenulls=True).over(before).alias(c) for c in ("block", "ahead", "n_ids"))).filter("kind = 1")
    inside = asked.select("shard", "position", "block", F.when((F.col("position") >= F.col("ahead")) & (F.col("position") < F.col("ahead") + F.col("n_ids")), F.col("position") - F.col("ahead")).alias("inside"))

    def access(wanted: pa.Table, block: pa.Table) -> pa.Table:
        at = wanted.column("inside").to_pylist()
        matrix = WaveletMatrix.from_bytes(block.column("matrix")[0].as_py()) if block.num_rows and wanted.num_rows else None
        token = pa.array([None if i is None or matrix is None else matrix.access(i) for i in at], pa.int64())
        return pa.table({"shard": wanted.column("shard"), "position": wanted.column("position"), "token": token})

    matrices = spark.read.schema(BLOCKS).parquet(at).select("shard", "block", "matrix")
    return inside.groupBy("shard", "block").cogroup(matrices.groupBy("shard", "block")).applyInArrow(access, "shard long, position long, token long")
