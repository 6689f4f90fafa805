"""Removal of repeated phrases: recurring passages are confirmed, made into Aho-Corasick automata, and found again in the documents.

A window is 20 consecutive words. Its anchor is the least-hashed run of 8 words in it (the first of equals),
which equal windows share. Consecutive windows of a document with one anchor make a passage of 20 to 32 words.
Of equal passages the first is the original; all windows of the others start earlier somewhere. Originals that share an
anchor but differ are compared window by window; those of other anchors have no window in common. So about
one row in seven words moves, and only where its anchor recurs.

Passages and windows that recur are the phrases. Documents with phrases are dealt out in shards of about a
megabyte; each gets the phrases that occur in it again, compiles them to one automaton (a letter a word, from
a hash of it), streams its documents through and verifies each hit by 128 bits over the words. So an automaton is as
large as its shard's own text makes it, and no document meets phrases that it can't have.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import discard, freed, materialize, text_or_empty
from pulseframe.llm.exact import maybe_among, split_among

SPAN, ANCHOR = 20, 8
#: Words of the longest passage.
LONGEST = SPAN + SPAN - ANCHOR
#: Bytes hashed at once, words looked at at once.
PIECE, STEP = 1 << 20, 1 << 17
#: Passages that a shard's documents share with others, on average: about a megabyte of text.
SHARD = 20_000
#: Odd multipliers of the two hashes, and the constants of the mixer that follows.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the multiplier and of its inverse."""
    if multiplier not in _powers or len(_powers[multiplier][0]) < n:
        made = []
        for m in (multiplier, pow(multiplier, -1, 1 << 64)):
            p = np.full(max(n, PIECE + 2), m, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[multiplier] = tuple(made)
    return _powers[multiplier]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX[0]
    h = (h ^ (h >> np.uint64(29))) * MIX[1]
    return h ^ (h >> np.uint64(32))


def span_hashes(digits: np.ndarray, multiplier: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of digits[start:end] for each pair, wherever it stands."""
    power, inverse = powers(multiplier, len(digits) + 1)
    sums = np.zeros(len(digits) + 1, np.uint64)
    np.cumsum(digits * power[: len(digits)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of data begin, and two hashes of each. Long data is hashed piece by piece, at white space."""
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        word = np.concatenate([[False], ~_SPACE[part], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        digits = part.astype(np.uint64) + np.uint64(1)
        found.append((starts + at, *(span_hashes(digits, m, starts, ends) for m in MULTIPLIERS)))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


class Block:
    """The words of some documents: doc (index of the document), place (in it), and two hashes of each word."""

    def __init__(self, texts: list[bytes]):
        starts, self.h1, self.h2 = word_hashes(b"\n".join(texts))
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.doc = np.searchsorted(begins, starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.place = np.arange(len(starts)) - (np.cumsum(self.counts) - self.counts)[self.doc]
        self.codes = (self.h1 % np.uint64(255) + np.uint64(1)).astype(np.uint8)

    def slices(self, overlap: int) -> Iterator[slice]:
        """Slices of words that together hold every run of overlap + 1 words."""
        for at in range(0, len(self.doc), STEP):
            yield slice(at, at + STEP + overlap)


def blocks(texts: pa.Array) -> Iterator[tuple[int, Block]]:
    """(index of the first text, block): documents of about a megabyte together, a longer one alone."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        data = t.as_py().encode()
        if held and size + len(data) > PIECE:
            yield first, Block(held)
            held, size, first = [], 0, k
        held.append(data)
        size += len(data)
    if held:
        yield first, Block(held)


def passages(block: Block, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage in the part: its first word, its end and its anchor's hash."""
    h1, doc = block.h1[part], block.doc[part]
    n = len(h1) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at = np.arange(len(h1) - ANCHOR + 1)
    ranks = span_hashes(h1, MULTIPLIERS[0], at, at + ANCHOR)
    least = np.lib.stride_tricks.sliding_window_view(ranks, SPAN - ANCHOR + 1)[:n].argmin(axis=1) + np.arange(n)
    whole = np.flatnonzero(doc[:n] == doc[SPAN - 1:])  # windows that don't cross documents
    if not len(whole):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    new = np.ones(len(whole), bool)
    new[1:] = (least[whole[1:]] != least[whole[:-1]]) | (whole[1:] != whole[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(whole)) - 1
    return whole[first], whole[last] + SPAN, ranks[least[whole[first]]]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def gathered(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:end] of all pairs one after the other, and the offsets between them."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return values[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])], offsets


def letters(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """The codes of each span, filled up with zeros, as four 64-bit numbers: of fixed width, so that they are aggregated by hash."""
    at = starts[:, None] + np.arange(LONGEST)
    packed = np.where(at < ends[:, None], codes[np.minimum(at, len(codes) - 1)], 0).astype(np.uint8).reshape(-1, LONGEST)
    return [pa.array(np.ascontiguousarray(c)) for c in packed.view(np.int64).T]


def first_places(doc: np.ndarray, place: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Of each entry the least place among those with its document and hashes."""
    order = np.lexsort((place, *hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in (doc, *hashes)], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = place[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def repeated(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which passages have an anchor that their document has more than once: others can't repeat anything in it."""
    order = np.lexsort((anchor, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, n): how many passages of a block have it."""
    for batch in freed(batches):
        for _, block in blocks(batch.column("text")):
            for part in block.slices(SPAN - 1):
                found, n = np.unique(passages(block, part)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(found), pa.array(n.astype(np.int64))], ["anchor", "n"])


class Found:
    """The passages of a block: document, place of the first word, slice and span in it, anchor, and two hashes."""

    def __init__(self, block: Block):
        parts = [(part, *passages(block, part)) for part in block.slices(SPAN - 1)]
        self.block, self.parts = block, [(part, starts, ends) for part, starts, ends, _ in parts]
        joined = lambda f: np.concatenate([f(*p) for p in parts]) if parts else np.zeros(0, np.int64)
        self.doc, self.place = joined(lambda part, s, e, a: block.doc[part][s]), joined(lambda part, s, e, a: block.place[part][s])
        self.anchor = joined(lambda part, s, e, a: a)
        self.repeated = repeated(self.doc, self.anchor)

    def hashes(self, multiplier: int, words: np.ndarray) -> np.ndarray:
        return np.concatenate([span_hashes(words[part], multiplier, s, e) for part, s, e in self.parts]) if self.parts else np.zeros(0, np.uint64)

    def letters(self) -> list[pa.Array]:
        columns = [letters(self.block.codes[part], s, e) for part, s, e in self.parts if len(s)]
        return [pa.concat_arrays(c) for c in zip(*columns)] or [pa.array([], pa.int64())] * 4

    def windows(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Two hashes and the first place in the document of every window, in the order of the passages, and the offsets of the passages."""
        values, sizes = [], []
        for part, s, e in self.parts:
            at = np.arange(max(0, len(self.block.h1[part]) - SPAN + 1))
            each = [gathered(span_hashes(h[part], m, at, at + SPAN), s, e - SPAN + 1)[0] for h, m in zip((self.block.h1, self.block.h2), MULTIPLIERS)]
            values.append((*each, gathered(self.block.place[part], s, e - SPAN + 1)[0]))
            sizes.append(e - SPAN + 1 - s)
        if not values:
            return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)], np.zeros(1, np.int64)
        w1, w2, place = (np.concatenate(c) for c in zip(*values))
        sizes = np.concatenate(sizes)
        again = np.repeat(self.repeated, sizes)
        place[again] = first_places(np.repeat(self.doc, sizes)[again], place[again], w1[again], w2[again])
        return [w1, w2, place], np.concatenate([[0], np.cumsum(sizes)])


def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, anchor, h1, h2, c0 to c3) of every passage; start is that of the first equal passage of the document."""
    for batch in freed(batches):
        for first, block in blocks(batch.column("text")):
            found = Found(block)
            h1, h2 = (found.hashes(m, h) for m, h in zip(MULTIPLIERS, (block.h1, block.h2)))
            again, start = found.repeated, found.place.copy()
            start[again] = first_places(found.doc[again], start[again], h1[again], h2[again])
            where = pa.array(found.doc + first)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(where), pa.array(start), signed(found.anchor), signed(h1), signed(h2), *found.letters()], ["doc", "start", "anchor", "h1", "h2", "c0", "c1", "c2", "c3"])


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, c0 to c3, w1, w2, first) of every passage: of its windows two hashes, and where the first equal one of the document starts."""
    for batch in freed(batches):
        for at, block in blocks(batch.column("text")):
            found = Found(block)
            (w1, w2, first), offsets = found.windows()
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v.view(np.int64))) for v in (w1, w2, first)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(found.doc + at)), pa.array(found.place), *found.letters(), *lists], ["doc", "start", "c0", "c1", "c2", "c3", "w1", "w2", "first"])


class Phrases:
    """An automaton over phrases spelled by one letter a word; each letter string leads to all phrases that are spelled so."""

    def __init__(self, phrases: pa.Table):
        self.h1, self.h2, self.doc, self.start = (phrases.column(c).to_numpy() for c in ("h1", "h2", "doc", "start"))
        packed = np.column_stack([phrases.column(f"c{k}").to_numpy() for k in range(4)]).astype(np.int64)
        self.sizes = (packed.view(np.uint8).reshape(len(packed), LONGEST) > 0).sum(axis=1)
        spelled: dict[bytes, list[int]] = {}
        for k, (row, n) in enumerate(zip(packed, self.sizes)):
            spelled.setdefault(row.tobytes()[:n], []).append(k)
        self.automaton = ahocorasick.Automaton()
        for codes, those in spelled.items():
            self.automaton.add_word(codes.decode("latin-1"), those)
        self.automaton.make_automaton()

    def covered(self, block: Block, docs: np.ndarray) -> np.ndarray:
        """Which words of the block lie in a phrase that also starts earlier; docs orders the block's documents."""
        gone = np.zeros(len(block.doc) + 1, np.int64)
        if not len(self.automaton):
            return gone[:-1] > 0
        for part in block.slices(LONGEST - 1):
            hits = list(self.automaton.iter(block.codes[part].tobytes().decode("latin-1")))
            if not hits:
                continue
            phrase = np.array([k for _, those in hits for k in those])
            end = np.repeat([e for e, _ in hits], [len(those) for _, those in hits]) + 1
            start = end - self.sizes[phrase]
            doc = block.doc[part]
            same = doc[start] == doc[end - 1]
            for h, m, told in ((block.h1, MULTIPLIERS[0], self.h1), (block.h2, MULTIPLIERS[1], self.h2)):
                same &= span_hashes(h[part], m, start, end).view(np.int64) == told[phrase]
            mine, first = docs[doc[start]], self.doc[phrase]
            same &= (mine > first) | (mine == first) & (block.place[part][start] > self.start[phrase])
            np.add.at(gone, start[same] + part.start, 1)
            np.add.at(gone, end[same] + part.start, -1)
        return np.cumsum(gone)[:-1] > 0


def kept_rows(docs: pa.Table, phrases: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept) of documents (id, doc, text)."""
    found = Phrases(phrases) if phrases is not None and phrases.num_rows else None
    for batch in docs.to_batches():
        for first, block in blocks(batch.column("text")):
            gone = found.covered(block, batch.column("doc").to_numpy()[first:]) if found else np.zeros(len(block.doc), bool)
            ends = np.cumsum(block.counts)
            kept, removed = [], []
            for k, n in enumerate(block.counts):
                words, out = batch.column("text")[first + k].as_py().encode().split(), gone[ends[k] - n : ends[k]]
                kept.append(b" ".join(compress(words, ~out) if out.any() else words).decode())
                removed.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(kept)), pa.array(block.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])


def ordered(docs: DataFrame) -> DataFrame:
    """Add doc, a number that orders documents by id (null last), then by a hash of their text; equal rows share it.

    Where ids are whole numbers, none null or repeated, they serve themselves. Else the distinct (id, hash) are sorted in ranges, numbered by the
    sizes of the ranges, and joined.
    """
    kind = docs.schema["id"].dataType
    counted = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count_if(F.col("id").isNull()).alias("none")).first()
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and (counted.n or 0) <= 1 and not counted.none:
        return docs.withColumn("doc", F.col("id").cast("long"))
    tied = docs.withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").isNull().asc(), F.col("id").asc(), F.col("tie").asc()]
    names = tied.select("id", "tie").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    names = materialize(names.select("id", "tie", F.monotonically_increasing_id().alias("doc")), "order")  # rising from range to range, and inside each
    right = names.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "doc")
    return tied.join(right, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).drop("_id", "_tie", "tie")


def remove_repeated_phrases(df: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """One row per row of df: id, n_words, n_removed, kept (the words that stay, joined by one space).

    A word goes if a window of 20 words that covers it also starts earlier: in a document with a smaller id or
    earlier in the same one; windows are judged on the input. White space is ASCII's, words are compared as they are. A null text counts as empty; texts
    under 20 words lose nothing. A null id comes after all others; rows with one id are ordered by a
    hash of their text, and those that also share the text are one document: all get the same result. Texts of any length are
    read whole, window by window. Other columns play no part, whatever their names; an empty df gives no rows.

    Equality rests on 128 bits over the words. shards is the number of automata, by default one for every 20,000 passages whose anchors recur.
    """
    kind = df.schema[id_column].dataType
    docs = ordered(df.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")))
    letters_ = ["c0", "c1", "c2", "c3"]

    # Anchors that recur, and the passages that have them.
    anchors = docs.select("text").mapInArrow(anchor_rows, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    anchors = materialize(anchors, "anchors")
    found = docs.select("doc", "text").mapInArrow(passage_rows, "doc long, start long, anchor long, h1 long, h2 long, c0 long, c1 long, c2 long, c3 long")
    found = materialize(maybe_among(found, {"anchor": F.col("anchor")}, anchors), "passages")
    discard(anchors)
    n_shards = shards or max(1, found.count() // SHARD)
    shard_of = lambda doc: F.pmod(F.xxhash64(doc), F.lit(n_shards)).alias("shard")

    def firsts(rows: DataFrame, *more: str) -> DataFrame:
        """Of equal passages or windows the first place, their number, and what all share."""
        return rows.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.min_by("start", "doc").alias("start"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in (*letters_, *more)))

    def needed(rows: DataFrame, first: DataFrame) -> DataFrame:
        """The phrases of each shard: those that occur in it, unless it is for the first time and once."""
        inside = rows.groupBy("h1", "h2", shard_of("doc")).agg(F.count(F.lit(1)).alias("inside"))
        return inside.join(first.filter("n > 1").drop("n"), ["h1", "h2"]).filter((F.col("inside") > 1) | (F.col("shard") != shard_of("doc"))).select("shard", "h1", "h2", "doc", "start", *letters_)

    # Passages that recur; the first of each is the original.
    originals = materialize(firsts(found, "anchor"), "originals")
    phrases = materialize(needed(found, originals), "phrases")
    told = materialize(maybe_among(found, {"h1": F.col("h1"), "h2": F.col("h2")}, originals.filter("n > 1").select("h1", "h2")).select("doc").distinct(), "told")
    discard(found)

    # Originals that share an anchor, window by window.
    shared = originals.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    apart = materialize(originals.join(shared, "anchor", "left_semi").select("doc", "start"), "apart")
    discard(originals)
    whole = maybe_among(docs.select("doc", "text"), {"doc": F.col("doc")}, apart.select("doc"))
    whole = whole.mapInArrow(window_rows, "doc long, start long, c0 long, c1 long, c2 long, c3 long, w1 array<long>, w2 array<long>, first array<long>")
    whole = maybe_among(whole, {c: F.col(c) for c in ("doc", "start")}, apart)
    windows = whole.select("doc", F.array(*letters_).alias("c"), F.posexplode(F.arrays_zip("w1", "w2", "first")).alias("k", "w"))
    windows = materialize(windows.select("doc", F.col("w.first").alias("start"), F.col("w.w1").alias("h1"), F.col("w.w2").alias("h2"), *window_letters()), "windows")
    first = materialize(firsts(windows).filter("n > 1"), "firsts")
    more = materialize(needed(windows, first), "phrases")
    told = told.unionByName(windows.join(first.select("h1", "h2"), ["h1", "h2"], "left_semi").select("doc")).distinct()
    told = materialize(told, "told")
    discard(windows, first, apart)

    # Each shard's automaton over its documents; documents without a recurring passage stay where they are.
    moved, rest = split_among(docs, {"doc": F.col("doc")}, told)
    out = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def shard(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        names = pa.schema([docs.schema.field("id"), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        return pa.Table.from_batches(list(kept_rows(docs, phrases)), names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            yield from kept_rows(pa.Table.from_batches([batch]), None)

    dealt = moved.select(shard_of("doc"), "id", "doc", "text").groupBy("shard")
    swept = dealt.cogroup(phrases.unionByName(more).groupBy("shard")).applyInArrow(shard, out)
    return swept.unionByName(rest.select("id", "doc", "text").mapInArrow(alone, out)).withColumnRenamed("id", id_column)


def window_letters() -> list[Column]:
    """c0 to c3 of the window that begins k letters into the passage c, shifted byte by byte."""
    def number(j: int) -> Column:
        at, shift = (F.col("k") / 8).cast("int") + j, (F.col("k") % 8).cast("int") * 8
        value = lambda i: F.coalesce(F.try_element_at("c", i + 1), F.lit(0).cast("long"))
        low = F.call_function("shiftrightunsigned", value(at), shift)
        return low.bitwiseOR(F.when(shift == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", value(at + 1), 64 - shift)))

    left = SPAN - 16  # letters in the third number
    return [number(0).alias("c0"), number(1).alias("c1"), number(2).bitwiseAND(F.lit((1 << 8 * left) - 1)).alias("c2"), F.lit(0).cast("long").alias("c3")]


REPEATED_SQL = r"""
    WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    windows AS MATERIALIZED (SELECT doc_id, s, sha256(array_to_string(words[s : s + 19], ' ')) AS w FROM (SELECT *, unnest(range(1, len(words) - 18)) AS s FROM lists)),
    firsts AS MATERIALIZED (SELECT w, min((doc_id, s)) AS f FROM windows GROUP BY w HAVING count(*) > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM windows JOIN firsts USING (w) WHERE (doc_id, s) > f) GROUP BY doc_id),
    flagged AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM lists),
    dropped AS (SELECT doc_id, unnest(places) AS p FROM gone),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM flagged ANTI JOIN dropped USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM lists LEFT JOIN kept USING (doc_id)
"""
