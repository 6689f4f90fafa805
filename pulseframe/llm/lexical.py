"""Ranked lexical search: postings as rows, integer scores, the best documents of every item.

A posting is (bucket, term, document, tf, n): the bucket is a hash of the term, under which
postings meet the terms of the items. Postings travel by document, not by bucket: all matches of
a document are then summed where they are joined, and only each task's best rows of an item move.
By bucket alone every match (dozens for each document and item) would have to move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import freed, materialize, small, text_or_empty

#: ASCII letters and digits and all bytes beyond ASCII make terms; A-Z become a-z, all else a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BUCKETS = 256
#: Bytes of a text that are split at once, and postings of an Arrow batch.
PIECE, BATCH = 1 << 20, 100_000
#: Parts of a thousand: the base and the share of length in m; K times m is added to tf.
BASE, LENGTH, SATURATION = 10, 90, 8


def term_counts(text: str) -> Counter:
    """term -> occurrences; long texts are split piece by piece, at spaces."""
    data = text.encode().translate(TERM_BYTES)
    counts, at = Counter(), 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else (data.find(b" ", at + PIECE) + 1 or len(data))
        counts.update(data[at:end].split())
        at = end
    return counts


def postings(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, id, bucket, term, tf, n) of every document: its terms with their occurrences, n all of its terms with repeats.

    Every row of df is a document; row tells those apart that share an id (of any kind, nulls
    too). A document with a term also has one row of the empty term, by which documents and
    lengths are counted. Null and empty texts have no rows. Texts are read whole. Other columns play no part.
    """
    kind = df.schema[id_column].dataType
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), text_or_empty(text).alias("text"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            at, terms, tfs, ns = [], [], [], []

            def rows() -> pa.RecordBatch:
                where = pa.array(np.array(at, np.int64))
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()), pa.array(ns, pa.int64())], ["row", "id", "term", "tf", "n"]
                )

            for k, text in enumerate(batch.column(2)):
                counts = term_counts(text.as_py())
                if counts:
                    n = counts.total()
                    at += [k] * (len(counts) + 1)
                    terms += [b"", *counts]
                    tfs += [0, *counts.values()]
                    ns += [n] * (len(counts) + 1)
                    if len(at) >= BATCH:
                        yield rows()
                        at, terms, tfs, ns = [], [], [], []
            if at:
                yield rows()

    long = T.LongType()
    out = T.StructType([T.StructField("row", long), T.StructField("id", kind), T.StructField("term", T.StringType()), T.StructField("tf", long), T.StructField("n", long)])
    return source.mapInArrow(spell, out).withColumn("bucket", bucket_of(F.col("term")))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def terms_of(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, bucket, term); rows of one item are put together."""
    found = postings(items, item_id, text).filter("term <> ''")
    return found.select(F.col("id").alias("item"), "bucket", "term").distinct()


def search(df: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank, id, score; highest score first, equal scores by id (null last).

    A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), N documents with a term, df those
    with this term. A document scores w * ((10**9 tf) div (1000 tf + 8 m)) a term, where m is 10
    plus 90 times its length over the mean, rounded down; scores of 0 are left out. Every row of df is a document of its own,
    repeated ones too. Null and empty texts on either side match nothing, rows that share an item_id are one item.
    Texts of any length are read whole, other columns play no part, and an empty df or empty items give no rows.

    Postings of terms that no item has stay where they are (the terms are broadcast if few, else
    joined); a frequent term is spread over the documents that have it.
    """
    wanted = materialize(terms_of(items, item_id, item_text), "terms")
    keys = small(wanted.select("bucket", "term").distinct().unionByName(wanted.limit(1).select(bucket_of(F.lit("")).alias("bucket"), F.lit("").alias("term"))))
    found = postings(df, id_column, text).join(keys, ["bucket", "term"], "left_semi")

    counts = materialize(found.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n_all")), "frequencies")
    whole = counts.filter("term = ''").select(F.col("df").alias("n_docs"), F.col("n_all").alias("n_terms"))  # one row, or none without documents
    weight = F.floor(1000 * F.ln((2 * F.col("n_docs") + 2) / (2 * F.col("df") + 1)))
    weighed = wanted.join(counts.filter("term <> ''").crossJoin(F.broadcast(whole)).select("bucket", "term", weight.alias("w"), "n_docs", "n_terms"), ["bucket", "term"])

    by_document = found.filter("term <> ''").repartition("row")
    matches = by_document.join(small(weighed), ["bucket", "term"]).withColumn("m", F.expr(f"{BASE} + (({LENGTH} * n * n_docs) div n_terms)"))
    points = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + {SATURATION} * m))")
    scores = matches.groupBy("row", "item").agg(F.first("id").alias("id"), F.sum(points).alias("score")).filter("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = scores.select("item", "id", "score", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
    WITH lists AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
    whole AS (SELECT count(*) AS nd, sum(len(terms))::BIGINT AS l FROM lists WHERE len(terms) > 0),
    words AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM lists),
    post AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM words GROUP BY ALL),
    spelled AS (SELECT item_id, {_TERMS} AS terms FROM benchmark),
    items AS MATERIALIZED (SELECT DISTINCT item_id, unnest(terms) AS term FROM spelled),
    weights AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * (SELECT nd FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post GROUP BY term),
    points AS (SELECT doc_id, post.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * (SELECT nd FROM whole)) // (SELECT l FROM whole)))) AS p FROM post JOIN weights ON post.term = weights.term),
    scored AS (SELECT item_id, doc_id, sum(p)::BIGINT AS score FROM items JOIN points ON items.term = points.term GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
