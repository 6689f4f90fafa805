"""SimHash near-dedup: fingerprints, links by pivot distance tables, components.

The table of a fingerprint holds its Hamming distances to reference fingerprints, apart
for each of a few blocks of bits; their sums over the blocks are the distances to the whole
references. No coordinate of two fingerprints differs by more than the fingerprints do.
Two that differ in max_bits bits agree in some of the blocks altogether, so all
coordinates of these blocks are equal: they are the key under which fingerprints meet. Pairs
that meet are discarded by the largest difference of the other coordinates and of the
sums; survivors are verified.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import exact
from pulseframe.llm.common import discard, freed, materialize, text_or_empty

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Reference fingerprints, and those of them whose distances are carried along to discard pairs: one byte each of a long.
REFERENCES, CARRIED = 14, 7
#: Fingerprints that meet under one key before it is split.
HOT_CELL = 512


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64, repeats included."""
    words = text.encode().lower().split()  # of bytes: A-Z and the six ASCII spaces alone
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Add the long column out: the 64 bits of the fingerprint. A text without words, or null, has 0."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in freed(batches):
            yield pa.array(np.array([fingerprint(t.as_py() or "", shingle) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, prints(text_or_empty(text)))


def hex_digits(print_: Column) -> Column:
    return F.lpad(F.lower(F.hex(print_)), 16, "0")


def block_masks(blocks: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(n: int = REFERENCES) -> list[int]:
    rng = random.Random(SEED)
    return [rng.getrandbits(64) for _ in range(n)]


def distances(prints: np.ndarray, mask: int, refs: list[int]) -> np.ndarray:
    """Distances of each fingerprint to each reference within the mask, a row of bytes each."""
    return np.bitwise_count((prints[:, None] ^ np.array(refs, np.uint64)[None, :]) & np.uint64(mask))


def packed(table: np.ndarray) -> np.ndarray:
    """The first CARRIED columns, one byte each in a long."""
    out = np.zeros((len(table), 8), np.uint8)
    out[:, : min(CARRIED, table.shape[1])] = table[:, :CARRIED]
    return out.view("<i8")[:, 0]


def table_key(tables: list[np.ndarray]) -> np.ndarray:
    """All distances of some tables as one number; equal ones have equal numbers."""
    h = np.zeros(len(tables[0]), np.uint64)
    for column in (c for t in tables for c in t.T):
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def within(a: Column, b: Column, most: int) -> Column:
    """Whether no byte of the two longs (seven bytes of at most 64) differs by more than most."""
    top = F.lit(0x0080808080808080)
    lift = F.lit(0x0080808080808080 + most * 0x0001010101010101)
    return (a + lift - b).bitwiseAND(b + lift - a).bitwiseAND(top) == top


def parts_beside(mask: int, parts: int) -> list[int]:
    """The bits outside the mask in parts of about equal size."""
    return [sum(1 << int(b) for b in part) for part in np.array_split([b for b in range(64) if not mask >> b & 1], parts)]


def candidates(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, refs: list[int] | None = None, hot: int = HOT_CELL) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that the tables don't tell apart: all links, and few others; a pair may come more than once.

    Pairs that differ in max_bits bits or fewer agree in blocks - max_bits blocks at least;
    the more fingerprints, the more blocks and the longer the keys (the links are
    the same). A key under which more than hot fingerprints meet is split by the
    tables of max_bits + 1 parts of its other bits, of which such a pair agrees in one.
    """
    refs = references() if refs is None else refs
    if blocks is None:
        blocks = max_bits + 2 + (prints.count() > 1 << 24)
    masks = block_masks(blocks)
    chosen = list(combinations(range(blocks), blocks - max_bits))
    carried = [f"v{j}" for j in range(blocks)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            by_block = [distances(x, m, refs) for m in masks]
            vs = [packed(t) for t in by_block]
            for k, c in enumerate(chosen):
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, vs), pa.array(np.full(len(x), k)), pa.array(table_key([by_block[j] for j in c]))], ["print", *carried, "k", "key"])

    parts = [parts_beside(sum(masks[j] for j in c), max_bits + 1) for c in chosen]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, k, key = (batch.column(name).to_numpy() for name in ("print", "k", "key"))
            of_key = np.array(parts, np.uint64)[k]
            for i in range(max_bits + 1):
                table = np.bitwise_count((x.view(np.uint64)[:, None] ^ np.array(refs, np.uint64)[None, :]) & of_key[:, i][:, None])
                sub = table_key([table, key.view(np.uint8).reshape(-1, 8)])
                yield pa.RecordBatch.from_arrays([*batch.columns[: blocks + 1], batch.column("k"), pa.array(k * 16 + i + 16), pa.array(sub)], ["print", *carried, "k", "cell", "key"])

    types = "print long, " + ", ".join(f"{v} long" for v in carried)
    keyed = materialize(prints.select("print").mapInArrow(tables, f"{types}, k long, key long"), "keyed")
    crowds = materialize(keyed.groupBy("k", "key").count().filter(F.col("count") > 1), "crowds")
    # A key of one fingerprint meets none; the others' fingerprints are joined by it, or, where it is hot, by its parts.
    cool = keyed.join(crowds.filter(F.col("count") <= hot).select("k", "key"), ["k", "key"], "left_semi").select("print", *carried, "k", F.lit(0).cast("long").alias("cell"), "key")
    warm = keyed.join(crowds.filter(F.col("count") > hot).select("k", "key"), ["k", "key"], "left_semi").select("print", *carried, "k", "key")
    met = materialize(cool.unionByName(warm.mapInArrow(split, f"{types}, k long, cell long, key long")), "met")

    a, b = met.alias("a"), met.alias("b")
    same = reduce(Column.__and__, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("k", "cell", "key")))
    coordinates = [(F.col(f"a.{v}"), F.col(f"b.{v}")) for v in carried]
    sums = [reduce(Column.__add__, side) for side in zip(*coordinates)]
    near = reduce(Column.__and__, (within(x, y, max_bits) for x, y in [*coordinates, tuple(sums)]))
    # A pair that meets under several keys counts under the first whose blocks agree.
    differing = F.col("a.print").bitwiseXOR(F.col("b.print"))
    agrees = lambda c: differing.bitwiseAND(F.lit(signed(sum(masks[j] for j in c)))) == 0
    first = reduce(lambda out, k: F.when(agrees(chosen[k]), k).otherwise(out), reversed(range(len(chosen))), F.lit(-1))
    pairs = a.join(b, same & (F.col("a.print") < F.col("b.print")) & near & (first == F.col("a.k")))
    return pairs.select(F.col("a.print").alias("a"), F.col("b.print").alias("b"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, refs: list[int] | None = None, hot: int = HOT_CELL) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in max_bits bits or fewer: the candidates that verification leaves."""
    return candidates(prints, max_bits, blocks, refs, hot).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least) for every node of the edges (a, b): the least node reachable.

    Large-star and small-star steps in turn until nothing changes; a step is an
    aggregation by node and a join, which the planner splits where a node has very
    many neighbours, so none need meet in one task.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a != b").distinct(), "large")
        discard(now)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select("b", "m").toDF("a", "b").unionByName(least.select("a", F.col("m").alias("b")))
        now = materialize(small.filter("a != b").distinct(), "small")
        discard(large)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("least"))).distinct()
        state = seen


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of df: id, row (hash of the text), fingerprint (long), component_id, kept.

    component_id is the smallest id among the documents reachable over links, itself
    included; nulls are passed over. Of each component the row with the smallest id
    is kept (null ids last; of rows with one id that with the smallest row). Texts
    without words, null ones too, share fingerprint 0 and link like any other. Equal
    fingerprints are one node, so copies and repeated rows meet no pairs. Texts of any length are read
    whole; other columns of df, whatever their names, play no part. An empty df gives no rows.
    """
    rows = df.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")).withColumn("row", F.xxhash64("text"))
    prints = materialize(simhash(rows, "text", "print", shingle).select("id", "row", "print"), "prints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = materialize(prints.groupBy("print").agg(least.alias("least")), "nodes")
    found = components(links(nodes.select("print"), max_bits)).withColumnRenamed("least", "component")
    named = nodes.join(found, nodes["print"] == found["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    named = materialize(named.join(first, "component").select("print", "first"), "named")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))
    return prints.join(named, "print").select(F.col("id").alias(id_column), "row", F.col("print").alias("fingerprint"), F.col("first.id").alias("component_id"), kept.alias("kept"))


def keep_one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of df of which near_duplicates keeps one a component, with their columns.

    Rows with the same id and text, of which there are none after exact dedup, are kept
    together. Nulls, empty texts and an empty df are as in near_duplicates. Rows of components of one aren't moved.
    """
    dropped = near_duplicates(df, id_column, text, shingle, max_bits).filter(~F.col("kept")).select(F.col(id_column).alias("id"), "row")
    return exact.without(df, {"id": df[id_column], "row": F.xxhash64(text_or_empty(df[text]))}, materialize(dropped, "dropped"))
