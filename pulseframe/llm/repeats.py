"""Removal of repeated passages: prefix doubling over sampled positions, sorted by Spark.

A string of SPAN bytes at position p is a window. Its anchor is the position of the
GRAM bytes inside it that hash least, so equal windows have equal anchors at equal
distances, and the windows of a text fall into runs of consecutive windows with the
same anchor; ranks are needed at anchors alone, about one position in 18. Ranks are
fingerprints of the bytes that they stand for, so equal strings have equal ranks in
any document without a sort of the whole corpus.

* Round 1 ranks GRAM bytes at each anchor. Spark sorts the (rank, position) pairs;
  positions whose rank is unique are done.
* Round 2 pairs the rank with that of the bytes beside it, at 17 bytes to either side
  (33 bytes; any window around the anchor holds one of the two), and with that of
  the whole run (50 to 84 bytes). Equal runs are past the threshold and decided;
  positions that no other document shares either side of 33 bytes with are done.
* Round 3 ranks the single windows (50 bytes) of the runs that are left.

In each round a task first compares its own rows: of equal strings only the first of its
least document is compared, and a rank with very many different runs in one task is sent
to round 3 at once. The further places of a string in that document travel under scattered
keys and take the verdict of the first by a join. So no rank, however common within
documents or across them, brings more than a bounded number of rows from each comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import discard, materialize, text_or_empty
from pulseframe.llm.exact import maybe_among, split_among

SPAN, GRAM = 50, 16
PER_WINDOW = SPAN - GRAM + 1
SIDE = (SPAN - GRAM + 1) // 2
#: Bytes of text that are handled at once, and the longest piece of a text; pieces overlap by SPAN - 1.
CHUNK, PIECE = 1 << 20, 1 << 22
#: Rows that a task compares among themselves at a time.
COMPARED = 1 << 20
#: Different runs of one rank in a task from which all go to round 3.
MANY_RUNS = 64
#: What a row is: to be compared, already known to be removed, a mark that its rank has very many runs, bound for round 3;
#: a further place of a string in its document (the other bits are the rank's), and a row to be compared that has such.
COMPARE, REMOVED, MARK, UNSETTLED, FOLLOWS, LEADS = 0, 1, 2, 3, 4, 8
NO_ID = (1 << 63) - 1

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_POSITION = np.uint64((1 << 24) - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit rank of the pair."""
    h = a * _C1
    h ^= h >> np.uint64(32)
    h += b
    h *= _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    return h


class Bytes:
    """Texts laid end to end, read as 8-byte words at any byte."""

    def __init__(self, data: bytes):
        self.n = len(data)
        self._data = b"\0" * 64 + data + b"\0" * 128
        self.words = np.ndarray((len(self._data) - 7,), "<u8", self._data, strides=(1,))

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.words[positions + 64]

    def grams(self) -> np.ndarray:
        """Rank of the GRAM bytes at each position."""
        return _mix(self.words[64:64 + self.n].copy(), self.words[72:72 + self.n].copy())

    def spans(self, positions: np.ndarray, seed: int = 0) -> np.ndarray:
        """Rank of the SPAN bytes at the positions."""
        h = np.full(len(positions), seed, np.uint64)
        for k in (0, 8, 16, 24, 32, 40, SPAN - 8):
            h = _mix(h, self.at(positions + k))
        return h

    def side(self, positions: np.ndarray) -> np.ndarray:
        """8 bits of the rank of the SIDE bytes at the positions."""
        h = _mix(_mix(self.at(positions), self.at(positions + 8)), self.at(positions + SIDE - 8))
        return h >> np.uint64(56)


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size:]) if size < width else a


def runs_of(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: the piece, first window, distance of the anchor from it and number of windows of each, and the ranks of round 1 and 2."""
    data = Bytes(b"".join(pieces))
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    grams = data.grams()
    keys = (grams & ~_POSITION) | np.arange(data.n, dtype=np.uint64)
    anchors = (sliding_least(keys, PER_WINDOW) & _POSITION).astype(np.int64)[: data.n - SPAN + 1]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)[: len(anchors)]
    windows = np.flatnonzero(np.arange(SPAN, SPAN + len(anchors)) <= ends[piece])
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchors = anchors[windows]
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    count = np.diff(np.concatenate([first, [len(windows)]]))
    start, anchor = windows[first], anchors[first]
    run = _mix(_mix(data.spans(start), data.spans(start + count - 1)), count.astype(np.uint64))
    pair = (run & ~np.uint64(0xFFFF)) | data.side(anchor - SIDE) << np.uint64(8) | data.side(anchor + GRAM)
    at = piece[start].astype(np.int64)
    return at, start - (ends - lengths)[at], anchor - start, count, grams[anchor], pair


def pieces_of(text: bytes) -> list[tuple[int, bytes]]:
    if len(text) <= PIECE:
        return [(0, text)]
    return [(at, text[at:at + PIECE + SPAN - 1]) for at in range(0, len(text), PIECE)]


def location(start: np.ndarray, anchor: np.ndarray | int, count: np.ndarray | int) -> np.ndarray:
    """A run's first window, the distance of its anchor from there, and its windows, in one number."""
    return start << 16 | anchor << 8 | count


ROWS = "key long, pair long, loc long, doc long, row long, kind long"
_NAMES = ["key", "pair", "loc", "doc", "row", "kind"]


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c if c.dtype == np.int64 else c.view(np.int64)) for c in columns], _NAMES)


def _by_document(columns: list[np.ndarray]) -> pa.RecordBatch:
    """In order of documents, so that what their rows share is packed well in the shuffle."""
    order = np.lexsort((columns[2], columns[3]))
    return _batch([c[order] for c in columns])


def _scatter(doc: np.ndarray, loc: np.ndarray) -> np.ndarray:
    """Keys for rows that need no partner: they are dealt out evenly."""
    return _mix(doc.view(np.uint64), loc.view(np.uint64))


def is_compared(kind: np.ndarray) -> np.ndarray:
    return (kind == COMPARE) | (kind == LEADS)


def is_follower(kind: np.ndarray) -> np.ndarray:
    return (kind & 7) == FOLLOWS


def led(kind: np.ndarray, rank: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Kinds where, of rows to be compared, each that isn't fresh follows the fresh one ahead of it."""
    follows = (kind == COMPARE) & ~fresh
    leads = (kind == COMPARE) & fresh & np.append(follows[1:], False)
    return np.where(follows, (rank.view(np.int64) & ~7) | FOLLOWS, np.where(leads, LEADS, kind))


def order_by(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order of lexsort by first, then more, then place, for a first key that mostly tells rows apart: only its ties are sorted by all."""
    order = np.argsort(first)
    ranked = first[order]
    same = ranked[1:] == ranked[:-1]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(same) else []
    if len(tied):
        rows = order[tied]
        order[tied] = rows[np.lexsort((rows, *(c[rows] for c in reversed(more)), ranked[tied]))]
    return order


def own_comparison(rank: np.ndarray, pair: np.ndarray, loc: np.ndarray, doc: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    """What a task sends of its rows: of equal (rank, run) those of the least document, the first of equal pairs leading; the other documents' are known to be removed."""
    run = pair >> np.uint64(16)
    order = order_by(rank, run, doc, pair)
    rank, pair, run, loc, doc, row = (c[order] for c in (rank, pair, run, loc, doc, row))
    new_rank = np.concatenate([[True], rank[1:] != rank[:-1]])
    new_run = new_rank | np.concatenate([[True], run[1:] != run[:-1]])
    least = doc[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
    kind = np.where(doc > least, REMOVED, COMPARE)
    key = rank.copy()
    heads = np.flatnonzero(new_rank)
    new_pair = new_run | np.concatenate([[True], pair[1:] != pair[:-1]])
    many = np.add.reduceat((new_pair & (kind == COMPARE)).astype(np.int64), heads) > MANY_RUNS
    crowded = many[np.cumsum(new_rank) - 1] & (kind == COMPARE)
    kind[crowded] = UNSETTLED
    kind = led(kind, rank, new_pair)
    alone = ~is_compared(kind)
    key[alone] = _scatter(doc[alone], loc[alone])
    if many.any():
        marks = heads[many]
        key, pair, loc, doc, row = (np.concatenate([a, b[marks]]) for a, b in ((key, rank), (pair, pair), (loc, loc), (doc, doc), (row, row)))
        kind = np.concatenate([kind, np.full(len(marks), MARK)])
    return _by_document([key, pair, loc, doc, row, kind])


def rank_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, size, held = [], 0, []

        def flush() -> None:
            at, start, anchor, count, rank, pair = runs_of([p for *_, p in held])
            doc, row, base = (np.array([h[k] for h in held], np.int64)[at] for k in range(3))
            parts.append((rank, pair, location(start + base, anchor, count), doc, row))

        for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            for base, piece in pieces_of(text.as_py().encode()):
                if len(piece) >= SPAN:
                    held.append((doc, row, base, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        flush()
                        size, held = 0, []
                        if sum(len(x[0]) for x in parts) >= COMPARED:
                            yield own_comparison(*(np.concatenate(c) for c in zip(*parts)))
                            parts.clear()
        if held:
            flush()
        if parts:
            yield own_comparison(*(np.concatenate(c) for c in zip(*parts)))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by key, cut only between keys."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in range(6)]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest is not None and len(rest[0]):
        yield rest


def _of_group(values: np.ndarray, heads: np.ndarray, group: np.ndarray, how) -> np.ndarray:
    return how.reduceat(values, heads)[group]


def settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by rank: those known to be removed, those for round 3, and the followers."""
    for key, pair, loc, doc, row, kind in _whole_groups(batches):
        leads, follows = kind == LEADS, is_follower(kind)
        kind = np.where(leads, COMPARE, kind)
        out = kind != COMPARE
        keep = [np.flatnonzero(out & (kind != MARK))]
        size = np.diff(np.concatenate([heads := np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]]))
        marked = np.add.reduceat((kind == MARK).astype(np.int64), heads) > 0
        wanted = np.repeat((size > 1), size) & ~out
        index = np.flatnonzero(wanted)
        if len(index):
            mark = np.repeat(marked, size)[index]
            k, p, d = key[index], pair[index].view(np.uint64), doc[index]
            run = p >> np.uint64(16)
            order = np.lexsort((d, run, k))
            index, k, p, d, run, mark = (c[order] for c in (index, k, p, d, run, mark))
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (run[1:] != run[:-1])])
            least = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            removed = d > least
            unsettled = mark & ~removed
            sides = []
            for shift in (8, 0):
                side = p >> np.uint64(shift) & np.uint64(0xFF)
                by = np.lexsort((side, k))
                a, b, r, e = k[by], side[by], run[by], d[by]
                heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                group = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(a)]])))
                differ = (_of_group(r, heads, group, np.minimum) != _of_group(r, heads, group, np.maximum)) & (_of_group(e, heads, group, np.minimum) != _of_group(e, heads, group, np.maximum))
                hit = np.zeros(len(k), bool)
                hit[by] = differ
                sides.append(hit)
                unsettled |= hit & ~removed
            # A window shared with others has SIDE bytes or more ahead of the anchor, or else behind its GRAM bytes.
            at = loc[index]
            anchor, count = at >> 8 & 0xFF, at & 0xFF
            ahead = np.clip(anchor - SIDE + 1, 0, count)  # windows that reach so far ahead
            begin = np.where(mark | sides[0], 0, np.minimum(np.maximum(anchor - SIDE, 0), count))
            end = np.where(mark | sides[1], count, ahead)
            loc = loc.copy()
            loc[index] = np.where(unsettled, location((at >> 16) + begin, begin, np.maximum(end - begin, 0)), at)
            kind = kind.copy()
            kind[index[removed]] = REMOVED
            kind[index[unsettled]] = UNSETTLED
            keep.append(np.sort(index[removed | unsettled]))
        rows = np.concatenate(keep)
        if len(rows):
            yield _batch([c[rows] for c in (np.where(leads, key, 0), np.where(leads | follows, pair, 0), loc, doc, row, kind)])


def rank_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 3: the windows of the runs in the column locs, as rows of one window each."""
    parts: list[tuple[np.ndarray, ...]] = []

    def compared() -> pa.RecordBatch:
        rank, second, loc, doc, row = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((doc, second, rank))
        rank, second, loc, doc, row = (c[order] for c in (rank, second, loc, doc, row))
        fresh = np.concatenate([[True], (rank[1:] != rank[:-1]) | (second[1:] != second[:-1])])
        kind = np.where(doc > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1], REMOVED, COMPARE)
        kind = led(kind, rank, fresh)
        alone = ~is_compared(kind)
        rank[alone] = _scatter(doc[alone], loc[alone])
        parts.clear()
        return _by_document([rank, second, loc, doc, row, kind])

    for batch in batches:
        for doc, row, text, locs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            loc = locs.values.to_numpy()
            count = loc & 0xFF
            if not (n := int(count.sum())):
                continue
            at = np.repeat(loc >> 16, count) + np.arange(n) - np.repeat(np.cumsum(count) - count, count)
            data = Bytes(text.as_py().encode())
            parts.append((data.spans(at), data.spans(at, 1), location(at, 0, 1), np.full(n, doc, np.int64), np.full(n, row, np.int64)))
            if sum(len(p[0]) for p in parts) >= COMPARED:
                yield compared()
        if parts:
            yield compared()


def settle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by rank: those that a smaller document has too, and the followers."""
    for key, pair, loc, doc, row, kind in _whole_groups(batches):
        order = np.lexsort((doc, pair, ~is_compared(kind), key))
        key, pair, loc, doc, row, kind = (c[order] for c in (key, pair, loc, doc, row, kind))
        known, leads, follows = ~is_compared(kind), kind == LEADS, is_follower(kind)
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]) | (known[1:] != known[:-1])])
        least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        rows = np.flatnonzero(known | (doc > least))
        if len(rows):
            yield _batch([c[rows] for c in (np.where(leads, key, 0), np.where(leads | follows, pair, 0), loc, doc, row, np.where(follows, kind, REMOVED))])


def with_followers(rows: DataFrame, name: str) -> DataFrame:
    """Settled rows (doc, row, loc, kind), where followers have taken the verdict of the row that leads them; those without one are gone.

    The join's left side may hold any number of followers under one key; its right side has one row there.
    """
    follows = F.col("kind").bitwiseAND(7) == FOLLOWS
    low = lambda shift: F.shiftright("loc", shift).bitwiseAND(0xFF)
    unsettled = F.col("kind") == UNSETTLED
    led_by = rows.filter(~follows & ((F.col("key") != 0) | (F.col("pair") != 0)))
    verdicts = led_by.select(
        "doc", F.shiftright("key", 3).alias("rank"), "pair", F.col("kind").alias("verdict"), F.when(unsettled, low(8)).alias("begin"), F.when(unsettled, low(0)).alias("count")
    ).distinct()
    placed = F.shiftleft(F.shiftright("loc", 16) + F.col("begin"), 16) + F.shiftleft("begin", 8) + F.col("count")
    followers = rows.filter(follows).select("doc", "row", "loc", F.shiftright("kind", 3).alias("rank"), "pair").join(verdicts, ["doc", "rank", "pair"])
    followers = materialize(followers.select("doc", "row", F.coalesce(placed, "loc").alias("loc"), F.col("verdict").alias("kind")), name)
    return rows.filter(~follows).select("doc", "row", "loc", "kind").unionByName(followers)


def cut(text: bytes, locs: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the text, and the removed spans, from the runs' locations."""
    if not len(locs):
        return text, []
    locs = np.sort(locs)
    start, end = locs >> 16, (locs >> 16) + (locs & 0xFF) + SPAN - 1
    reach = np.maximum.accumulate(end)
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    spans = list(zip(start[fresh].tolist(), reach[np.concatenate([fresh[1:] - 1, [len(locs) - 1]])].tolist()))
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), spans


SPANS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
_SPANS = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


@F.arrow_udf(SPANS)
def _cut(texts: pa.Array, locs: pa.Array) -> pa.Array:
    rows = []
    for t, x in zip(texts, locs):
        raw = t.as_py().encode()
        kept, spans = cut(raw, x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64))
        rows.append({"n_bytes": len(raw), "spans": [{"start": a, "end": b} for a, b in spans], "kept": kept})
    return pa.array(rows, _SPANS)


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: id, n_bytes, spans (removed bytes: start, end), kept (the bytes left).

    A byte goes if a string of SPAN bytes that covers it also begins in a document
    with a smaller id; strings are judged on the input, in UTF-8, within documents. A
    null or empty text has no bytes. A null id is larger than any other; rows with
    the same id don't remove from each other, and each is judged by its own text.
    Texts under SPAN bytes stay whole. Other columns of df are ignored. An empty df
    gives no rows.
    """
    docs = df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), text_or_empty(text).alias("text"))
    shared = not docs.groupBy("doc").count().filter("count > 1").isEmpty()  # only then an id doesn't tell a row
    docs = docs.select("doc", (F.xxhash64("text") if shared else F.lit(0).cast("long")).alias("row"), "text")
    long_enough = docs.filter(F.octet_length("text") >= SPAN)

    anchors = long_enough.mapInArrow(rank_anchors, ROWS)
    ranked = materialize(anchors.repartition("key").sortWithinPartitions("key").mapInArrow(settle_runs, ROWS), "runs")
    runs = with_followers(ranked, "run_followers")
    which = {c: F.col(c) for c in ("doc", "row")}
    # Texts move to what is known of them; those of which nothing is known stay where they are.
    unsettled = materialize(runs.filter(F.col("kind") == UNSETTLED).groupBy("doc", "row").agg(F.collect_set("loc").alias("locs")), "unsettled")
    windows = maybe_among(long_enough, which, unsettled).join(unsettled, ["doc", "row"]).select("doc", "row", "text", "locs").mapInArrow(rank_windows, ROWS)
    decided = materialize(windows.repartition("key").sortWithinPartitions("key").mapInArrow(settle_windows, ROWS), "windows")
    removed = runs.filter(F.col("kind") == REMOVED).unionByName(with_followers(decided, "window_followers"))
    removed = materialize(removed.groupBy("doc", "row").agg(F.collect_list("loc").alias("locs")), "removed")
    discard(ranked, decided, unsettled)
    cut, whole = split_among(docs, which, removed)
    done = cut.join(removed, ["doc", "row"], "left").select("doc", "text", "locs").unionByName(whole.select("doc", "text", F.lit(None).cast("array<bigint>").alias("locs")))
    done = done.select("doc", _cut("text", "locs").alias("x"))
    return done.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_column), "x.n_bytes", "x.spans", "x.kept")
