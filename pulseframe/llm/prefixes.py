"""Conversation prefix trie: chained digests of prefixes, nodes by (depth, digest), sums over subtrees.

A node is named by (smallest member, depth). Nodes with one smallest member lie under one another,
so each conversation owns one stretch of nodes, or none if an earlier one is equal. A stretch adds its
sums to every stretch that it hangs below, at the depth where it leaves it, and sums then run up
inside each stretch. So a conversation of d turns is exploded to at most d ancestors,
where nodes exploded one by one would give d * d / 2 rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import materialize, text_or_empty

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: Identifiers that are joined to one piece of text before pieces of a node meet.
PIECE = 8192


def ordered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, pos, digest, n_bytes) of each conversation, pos from 0 by turn (null first), then role and text.

    Null roles and texts count as empty; repeated rows are turns of their own; rows without a
    conversation's id belong to none and are left out.
    """
    rows = df.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("conv", (F.row_number().over(order) - 1).alias("pos"), digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(turns: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % step, then goes on with its own after its first h;
    h is crc32 of its decimal id, modulo most. Rows (conv, part, pos, digest, n_bytes)."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    own = turns.filter(F.col("pos") >= h).withColumn("part", F.lit(1))
    takers = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % step).alias("base"), h.alias("h"))
    heads = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv", "base").join(takers, "base").filter(F.col("pos") < F.col("h")).withColumn("part", F.lit(0))
    return own.unionByName(heads.select(*own.columns))


def chained(rows: DataFrame) -> DataFrame:
    """(conv, depth, digest, n_bytes, last): the digest of a prefix covers that of the prefix before it and the digest of its turn.

    A task folds the sorted turns of its conversations, one row at a time, and keeps one digest.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, depth, digest = None, 0, b""  # held: the row that waits to learn whether it is its conversation's last
        for batch in batches:
            out = []
            for conv, turn, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("conv", "digest", "n_bytes"))):
                same = held is not None and held[0] == conv
                if held is not None:
                    out.append((*held, not same))
                depth, digest = (depth + 1, digest) if same else (1, b"")
                digest = hashlib.sha256(digest + turn).digest()
                held = (conv, depth, digest, n_bytes)
            yield batch_of(out)
        if held is not None:
            yield batch_of([(*held, True)])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()))], ["conv", "depth", "digest", "n_bytes", "last"])

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "part", "pos").select("conv", "digest", "n_bytes")
    return ordered.mapInArrow(fold, "conv long, depth long, digest binary, n_bytes long, last boolean")


def joined_sha256(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of rows (node, depth, conv): SHA-256 of a node's decimal ids, ascending, comma-joined.

    Ranges of sorted ids are joined to pieces first, so that a node that ends a third of all
    conversations sends a few pieces, and these are hashed one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            out = []
            for node, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "conv"))):
                if ids and (key != (node, depth) or len(ids) == PIECE):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = node, depth
                ids.append(conv)
            yield rows_of(out)
        if ids:
            yield rows_of([(*key, ids[0], ",".join(map(str, ids)))])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["node", "depth", "least", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["node", "depth", "ends_sha256"])

        for batch in batches:
            out = []
            for node, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "piece"))):
                if key == (node, depth):
                    digest.update(b"," + piece.encode())
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (node, depth), hashlib.sha256(piece.encode())
            yield done(out)
        if key:
            yield done([(*key, digest.hexdigest())])

    ranges = ends.repartitionByRange("node", "depth", "conv").sortWithinPartitions("node", "depth", "conv").select("node", "depth", "conv")
    joined = ranges.mapInArrow(pieces, "node long, depth long, least long, piece string")
    met = joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "least")
    return met.mapInArrow(hashes, "node long, depth long, ends_sha256 string")


def prefix_trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows are turns (conv, part, pos, digest, n_bytes), conversations all ids (conv), those without turns too: they end at the root,
    whose depth is 0. Equal conversations share all nodes. Conversations of any length and groups of equal ones
    of any size are split or folded row by row. No conversations give no rows.
    """
    spark = rows.sparkSession
    ids = materialize(conversations.select("conv").distinct(), "conversations")
    root = ids.agg(F.min("conv").alias("root"), F.count(F.lit(1)).alias("n_all")).filter("n_all > 0")
    chains = materialize(chained(rows), "chains")

    members = chains.groupBy("depth", "digest").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs"))
    above = F.lag("node").over(Window.partitionBy("conv").orderBy("depth"))
    paths = chains.join(members, ["depth", "digest"]).drop("digest").withColumn("parent", above)
    paths = materialize(paths.crossJoin(F.broadcast(root)).withColumn("parent", F.coalesce("parent", "root")).drop("n_all"), "paths")

    top = root.select(F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.col("n_all").alias("n_convs"), F.lit(0).cast("long").alias("n_bytes"))
    nodes = paths.filter("conv = node").select("node", "depth", "parent", "n_convs", "n_bytes").unionByName(top)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["node", "depth"], "left").na.fill(0, ["n_children"])
    nodes = materialize(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}), "nodes")

    # Each conversation that owns nodes, with every other owner that it hangs below and the depth where it leaves that one's nodes.
    owned = nodes.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    hangs = paths.filter("conv <> node").select("conv", F.col("node").alias("above"), "depth")
    roots = ids.crossJoin(F.broadcast(root)).filter("conv <> root").select("conv", F.col("root").alias("above"), F.lit(0).cast("long").alias("depth"))
    leaves = hangs.unionByName(roots).groupBy("conv", "above").agg(F.max("depth").alias("depth"))
    added = leaves.join(owned.withColumnRenamed("node", "conv"), "conv").groupBy(F.col("above").alias("node"), "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    below = Window.partitionBy("node").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = nodes.join(added, ["node", "depth"], "left").na.fill(0, ["more_leaves", "more_saved"])
    ends = paths.filter("last").select("node", "depth", "conv")
    bare = ids.join(chains.select("conv").distinct(), "conv", "left_anti").crossJoin(F.broadcast(root)).select(F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"), "conv")
    summed = summed.join(joined_sha256(ends.unionByName(bare)), ["node", "depth"], "left")
    return summed.select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.sum(F.col("leaf") + F.col("more_leaves")).over(below).alias("n_leaves"),
        F.sum(F.col("saved") + F.col("more_saved")).over(below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


#: CRC-32 of a decimal number, bit by bit: 3988292384 is the reversed polynomial, 4294967295 all ones.
_CRC = """xor(list_reduce(list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::BIGINT),
        lambda a, b: list_reduce(list_transform(range(8), lambda i: 0::BIGINT), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""
TRIE_SQL = f"""
    WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT c, {_CRC} % 9 AS h, c - c % 5 AS base FROM (SELECT DISTINCT c FROM t)),
    whole AS (
        SELECT c, list({{'role': role, 'text': text}} ORDER BY part, pos) AS turns FROM (
            SELECT ids.c, 0 AS part, pos, role, text FROM ids JOIN t ON t.c = base AND pos < h
            UNION ALL SELECT ids.c, 1, pos, role, text FROM ids JOIN t ON t.c = ids.c AND pos >= h) GROUP BY c),
    convs AS (SELECT c, coalesce(turns, []) AS turns FROM ids LEFT JOIN whole USING (c)),
    prefixes AS (SELECT c, d, turns[:d] AS p, turns[:greatest(d - 1, 0)] AS above, d = len(turns) AS last, coalesce(strlen(turns[d].text), 0) AS n FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM convs)),
    nodes AS (SELECT p, d, any_value(above) AS above, min(c) AS node, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
                     coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM prefixes GROUP BY p, d),
    linked AS (SELECT a.*, b.node AS parent, (SELECT count(*) FROM nodes k WHERE k.d = a.d + 1 AND k.above = a.p) AS n_children FROM nodes a LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.above),
    up AS (SELECT node, d, node AS top, d AS top_d, parent, (n_children = 0)::INT AS leaf, saved FROM linked
           UNION ALL SELECT up.node, up.d, l.node, l.d, l.parent, leaf, up.saved FROM up JOIN linked l ON up.top_d > 0 AND l.d = up.top_d - 1 AND l.node = up.parent),
    sums AS (SELECT top AS node, top_d AS d, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
    SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM linked JOIN sums USING (node, d)
"""
