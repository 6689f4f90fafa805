"""Mixing sources to target weights by capped water-filling, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import fresh, materialize, small

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
#: Documents of a source in one bucket, on average, and buckets of all sources beyond one each: the
#: fractional repetition is taken bucket by bucket, and a bucket grows once there are so many.
BUCKET_DOCS, BUCKETS = 4096, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """From rows (source, size): source, source_size, n_docs, n_buckets and target, one row per source.

    Sources in code point order, null last, take the weights in turn. A target is
    the least of max_epochs * source_size and weight * level; the level, at which the targets
    add up to the sum of all sizes, follows from the sources in the order in which they
    reach their caps. Windows here see one row per source, not per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumns({"rank": rank, "weight": weight, "cap": F.col("source_size").cast("double") * max_epochs})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    per = per.withColumns({"left": left, "open_weight": open_weight})
    # Where the next source in order isn't above its cap any more, none after it is either.
    settled = F.col("weight") * F.col("left") / F.col("open_weight") <= F.col("cap")
    level = F.min(F.when(settled, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), "left", "open_weight"))).over(everything)
    per = per.withColumn("level", level)
    target = F.least(F.col("cap"), F.col("weight") * F.col("level")["left"] / F.col("level")["open_weight"])
    full = F.greatest(F.lit(bucket_docs).cast("double"), F.ceil(F.sum("n_docs").over(everything) / BUCKETS))
    return per.select("source", "source_size", "n_docs", F.ceil(F.col("n_docs") / full).alias("n_buckets"), F.coalesce(target, F.lit(0.0)).alias("target"))


def seeded_key(id_: F.Column, seed: int) -> F.Column:
    """Where a document stands in its bucket, and which bucket that is."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))


def bucket_of(key: F.Column, n_buckets: F.Column) -> F.Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n_buckets


def epochs_of(target: F.Column, source_size: F.Column) -> F.Column:
    return F.when(source_size > 0, target / source_size).otherwise(0.0)


def dealt_rows(df: DataFrame, id_column: str, source: str, text: str, weights, max_epochs: int, seed: int, bucket_docs: int) -> tuple[DataFrame, DataFrame]:
    """The targets, and a row per row of df: id, source, size, source_size, target, key, bucket, whole and extra."""
    rows = df.select(F.col(id_column).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"))
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows, weights, max_epochs, bucket_docs), "targets")
    epochs = epochs_of(F.col("target"), F.col("source_size"))
    dealt = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumns({"key": seeded_key(F.col("id"), seed), "whole": F.floor(epochs), "part": epochs - F.floor(epochs)})
    dealt = dealt.withColumn("bucket", bucket_of(F.col("key"), F.col("n_buckets")))
    bucket = Window.partitionBy("source", "bucket")
    ahead = F.coalesce(F.sum("size").over(bucket.orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owed = F.floor(F.col("part") * F.sum("size").over(bucket) + 0.5)
    return targets, dealt.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), owed - ahead)).cast("long"))


def mix(df: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """One row per row of df: id, source, size, source_size, target, whole, extra, taken.

    size counts words (null text: 0). Each document is taken whole times; buckets of
    a source then take documents in seeded order, until the words they still owe
    are taken: extra words, all of a document's or, for one document in a bucket, a
    part. taken = whole * size + extra, at most max_epochs * size. The same rows and
    seed give the same result. A null id is hashed as "null"; a null source is a
    source. Empty documents take nothing. An empty df gives no rows.
    """
    _, dealt = dealt_rows(df, id_column, source, text, weights, max_epochs, seed, bucket_docs)
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return dealt.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", F.col("whole").cast("long").alias("whole"), "extra", taken.alias("taken"))


def repeat_rows(df: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """The rows of df, each as often as the mix takes it, with their columns under their names.

    Texts stay whole: the one document in a bucket that mix takes in part is taken
    whole if at least half of it is due, else not once more. Rows without words, null
    and empty texts among them, go; rows with the same id, source and size are taken
    alike. Null ids and sources are as in mix. An empty df gives no rows.

    What a bucket takes once more is all up to one document in seeded order, so a row
    per bucket and one per source say how often any row is taken, and no text moves.
    """
    targets, dealt = dealt_rows(df, id_column, source, text, weights, max_epochs, seed, bucket_docs)
    place = F.struct("key", "id", "size")
    cuts = dealt.filter((F.col("size") > 0) & (F.col("extra") * 2 >= F.col("size"))).groupBy("source", "bucket").agg(F.max(place).alias("last"))
    cuts = materialize(cuts, "cuts")
    name = {c: fresh(f"_{c}", df) for c in ("of", "whole", "n_buckets", "key", "at", "bucket", "last", "copies", "copy")}
    per = targets.select(F.col("source").alias(name["of"]), F.floor(epochs_of(F.col("target"), F.col("source_size"))).cast("int").alias(name["whole"]), F.col("n_buckets").alias(name["n_buckets"]))
    cuts = cuts.select(F.col("source").alias(name["at"]), F.col("bucket").alias(name["bucket"]), F.col("last").alias(name["last"]))
    col = {k: F.col(v) for k, v in name.items()}
    rows = df.withColumn(name["key"], seeded_key(df[id_column], seed)).join(small(per), df[source].eqNullSafe(col["of"]))
    rows = rows.join(small(cuts), df[source].eqNullSafe(col["at"]) & (bucket_of(col["key"], col["n_buckets"]) == col["bucket"]), "left")
    last = col["last"]
    before = F.when(col["key"] != last["key"], col["key"] < last["key"]).otherwise(F.struct(df[id_column].alias("id"), word_count(df[text]).alias("size")) <= F.struct(last["id"], last["size"]))
    copies = col["whole"] + F.coalesce(before, F.lit(False)).cast("int")
    with_words = F.coalesce(df[text].rlike(WORD), F.lit(False))
    taken = rows.filter(with_words).withColumn(name["copies"], copies).filter(col["copies"] > 0)
    return taken.withColumn(name["copy"], F.explode(F.sequence(F.lit(1), col["copies"]))).select(*(df[c] for c in df.columns))


MIX_SQL = f"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM per),
    weighed AS (SELECT *, (CASE rnk % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM ranked),
    ordered AS (SELECT *, sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER o, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight
                FROM weighed WINDOW o AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    lvl AS (SELECT lft, open_weight FROM ordered WHERE weight * lft / open_weight <= cap ORDER BY cap / weight, rnk LIMIT 1),
    targets AS (SELECT o.source, o.source_size, o.n_docs, least(o.cap, o.weight * lvl.lft / lvl.open_weight) AS target FROM ordered o, lvl),
    dealt AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, 'null')) AS k, t.n_docs,
                     CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS epochs
              FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    bucketed AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % ceil(n_docs / greatest({BUCKET_DOCS}, (SELECT ceil(sum(n_docs) / {BUCKETS}) FROM per)))::BIGINT AS bucket FROM dealt),
    owed AS (SELECT *, floor((epochs - floor(epochs)) * sum(size) OVER (PARTITION BY source, bucket) + 0.5) AS due,
                    coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM bucketed)
    SELECT doc_id, size, source_size, target, (floor(epochs) * size + greatest(0, least(size, due - ahead)))::BIGINT AS taken FROM owed
"""
