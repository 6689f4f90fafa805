"""Exact dedup with a log-structured merge index of digests, all in DataFrame operations.

Memtables are slices of a bounded number of rows, dealt by identifier, so that copies of one text are spread over all. Each
is flushed as a run: digests in sorted order, with the smallest and largest identifier and the
number of rows, and with a filter of the run's digests beside it. Compaction asks the filters first: rows whose bit
no other run has set pass as they are, and only the others are merged by digest. The digests that more than one
row has make another filter, a bit set sized by their number; the rows that pass it are
hits, and their texts are compared byte by byte before they count as equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import fresh, materialize, scratch, shuffle_files_go_at_the_end, text_or_empty
from pulseframe.sources.storage import exists

#: Bits of the filter for each digest in it (about one in so many other rows passes), and its least and largest size
#: as powers of two. Its rows are words of 64 bits: at most 2**20 rows of 16 bytes, so it can always be broadcast.
BITS_A_DIGEST, LEAST_BITS, MOST_BITS = 16, 12, 26
#: Rows of a memtable, about, and the fewest memtables of a flush.
MEMTABLE_ROWS, MEMTABLES = 1 << 20, 4


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class DigestIndex:
    """Runs of (digest, least_id, largest_id, n), each with its filter, in one folder; merged on compaction."""

    def __init__(self, spark: SparkSession, memtable_rows: int = MEMTABLE_ROWS, memtables: int = MEMTABLES):
        self.spark, self.memtable_rows, self.memtables, self.runs, self.schema, self.rows = spark, memtable_rows, memtables, [], None, 0

    def flush(self, rows: DataFrame) -> None:
        """Aggregate rows (digest, id) in memtables and write each as a run in order of its digests, and its filter."""
        n = rows.count()
        tables = max(self.memtables, -(-n // self.memtable_rows))
        path = scratch(self.spark, "run")
        run = (
            rows.withColumn("memtable", F.pmod(F.xxhash64("id"), F.lit(tables)))
            .groupBy("memtable", "digest")
            .agg(F.min("id").alias("least_id"), F.max("id").alias("largest_id"), F.count(F.lit(1)).alias("n"))
            .sortWithinPartitions("memtable", "digest")
        )
        with shuffle_files_go_at_the_end(self.spark):
            run.write.partitionBy("memtable").parquet(path)
        self.rows, self.schema = self.rows + n, run.drop("memtable").schema
        kept = [f"{path}/memtable={k}" for k in range(tables)]
        self.runs += [(p, None) for p in kept if exists(self.spark, p)]

    def _run(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def filters(self, bits: int) -> DataFrame:
        """(run, word, mask) of every run's filter, written once; all are of one size, after all rows of the index, so that bits are comparable."""
        for k, (path, made) in enumerate(self.runs):
            if made is None or made[0] != bits:
                at = scratch(self.spark, "run-filter")
                filter_of(self._run(path), bits).write.parquet(at)
                self.runs[k] = (path, (bits, at))
        each = [self.spark.read.schema("word long, mask long").parquet(at).withColumn("run", F.lit(k)) for k, (_, (_, at)) in enumerate(self.runs)]
        return reduce(DataFrame.unionByName, each)

    def split(self) -> tuple[DataFrame, DataFrame]:
        """The rows of all runs whose digest no other run can have, and the rest. Where rows are too many for filters to tell, all are rest."""
        if self.schema is None:
            raise ValueError("nothing was flushed")
        rows = self._run(*(p for p, _ in self.runs))
        bits = filter_bits(self.rows)
        if len(self.runs) < 2:
            return rows, rows.filter(F.lit(False))
        if (self.rows >> bits - 2) > 0:
            return rows.filter(F.lit(False)), rows
        step = lambda s, m: F.struct(s["one"].bitwiseOR(m).alias("one"), s["two"].bitwiseOR(s["one"].bitwiseAND(m)).alias("two"))
        none = F.lit(0).cast("long")
        met = F.aggregate(F.collect_list("mask"), F.struct(none.alias("one"), none.alias("two")), step, lambda s: s["two"])
        twice = self.filters(bits).groupBy("word").agg(met.alias("mask")).filter("mask <> 0")
        together, apart = split_by_filter(rows, F.col("digest"), materialize(twice, "filter"), bits)
        return apart, together

    def compact(self) -> DataFrame:
        """One run of all: per digest the smallest and largest identifier and the number of rows."""
        apart, together = self.split()
        merged = together.groupBy("digest").agg(F.min("least_id").alias("least_id"), F.max("largest_id").alias("largest_id"), F.sum("n").alias("n"))
        path = scratch(self.spark, "compacted")
        with shuffle_files_go_at_the_end(self.spark):
            apart.unionByName(merged).sortWithinPartitions("digest").write.parquet(path)
        self.runs = [(path, None)]
        return self._run(path)


def bit_of(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(1 << bits))


def filter_bits(digests: int) -> int:
    """The power of two for so many digests."""
    return min(MOST_BITS, max(LEAST_BITS, (BITS_A_DIGEST * digests).bit_length()))


def filter_of(digests: DataFrame, bits: int) -> DataFrame:
    """The bits of the column digest as (word, mask): at most 2**(bits - 6) rows, whatever the input."""
    bit = bit_of(F.col("digest"), bits)
    return digests.groupBy((bit / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("mask"))


def split_by_filter(df: DataFrame, digest: Column, words: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose bit is set, and the others. The words are bounded by the number of bits, so they are broadcast and no row moves."""
    bit, words = bit_of(digest, bits), words.toDF(word := fresh("word", df), mask := fresh("mask", df))
    hit = ((bit / 64).cast("long") == F.col(word)) & (F.call_function("shiftrightunsigned", F.col(mask), (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return df.join(F.broadcast(words), hit, "left_semi"), df.join(F.broadcast(words), hit, "left_anti")


def without(df: DataFrame, keys: dict[str, Column], gone: DataFrame) -> DataFrame:
    """The rows of df whose keys (name in gone -> column of df) no row of gone has; null keys equal null.

    A filter of the keys that go lets most rows of df pass where they are; only
    those that it holds, the rows of gone and about one other in BITS_A_DIGEST, are
    joined exactly. Where there are more such keys than the largest filter can tell
    apart, the join takes all rows.
    """
    gone = gone.select(*keys).distinct()
    n = gone.count()
    if not n:
        return df
    names = {k: fresh(f"_{k}", df) for k in keys}
    right = gone.toDF(*names.values())
    same = [df_key.eqNullSafe(F.col(names[k])) for k, df_key in keys.items()]
    bits = filter_bits(n)
    if (n >> bits - 2) > 0:  # under four bits a key it lets nearly all rows through
        return df.join(right, same, "left_anti")
    words = materialize(filter_of(gone.select(F.xxhash64(*keys).alias("digest")), bits), "filter")
    hits, misses = split_by_filter(df, F.xxhash64(*keys.values()), words, bits)
    return misses.unionByName(hits.join(right, same, "left_anti"))


def split_among(df: DataFrame, keys: dict[str, Column], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose keys some row of wanted has and about one other in BITS_A_DIGEST, and the rest; no row moves.
    Where there are more keys than the largest filter can tell apart, all rows come first and none is left."""
    wanted = wanted.select(F.xxhash64(*keys).alias("digest")).distinct()
    n = wanted.count()
    bits = filter_bits(n)
    if (n >> bits - 2) > 0:
        return df, df.filter(F.lit(False))
    return split_by_filter(df, F.xxhash64(*keys.values()), materialize(filter_of(wanted, bits), "filter"), bits)


def maybe_among(df: DataFrame, keys: dict[str, Column], wanted: DataFrame) -> DataFrame:
    """The first part of split_among."""
    return split_among(df, keys, wanted)[0]


def duplicate_groups(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "largest", digest=sha256, bits: int | None = None
) -> DataFrame:
    """One row per row of df: id, digest, keep_id, group_size, kept.

    Texts are equal if identical; a null text counts as empty. Of equal texts the
    row with the largest (keep="smallest": the smallest) id stays. A null id loses
    to any other; of several rows with the id that stays and the same text one is
    kept. Texts with equal digests count as equal only if their bytes are: digest may
    be any function of the text. Other columns of df, whatever their names, play no
    part. Texts of any length are read whole. bits sets the size of the filter
    (by default after the number of repeated digests). An empty df gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("id"), text_or_empty(text).alias("_text")).withColumn("digest", digest(F.col("_text")))
    narrow = materialize(rows.select("id", "digest"), "digests")
    index = DigestIndex(spark)
    index.flush(narrow)
    compacted = index.compact()
    pick = "largest_id" if keep == "largest" else "least_id"

    # Byte verification: hits meet by digest and text, aggregated before the shuffle.
    suspects = compacted.filter("n > 1").select("digest")
    bits = bits or filter_bits(suspects.count())
    words = materialize(filter_of(suspects, bits), "filter")
    hits = split_by_filter(rows, F.col("digest"), words, bits)[0].join(suspects, "digest", "left_semi")
    best = F.max if keep == "largest" else F.min
    classes = materialize(
        hits.groupBy("digest", "_text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("_key", F.sha2("_text", 512)).drop("_text"), "classes"
    )
    collided = materialize(classes.groupBy("digest").count().filter("count > 1").select("digest"), "collided")

    plain = narrow.join(compacted.select("digest", F.col(pick).alias("keep_id"), F.col("n").alias("group_size")), "digest")
    if not collided.isEmpty():  # equal digests of unequal texts: these rows are told apart by their texts
        told = rows.join(collided, "digest", "left_semi").select("id", "digest", F.sha2("_text", 512).alias("_key"))
        told = told.join(classes, ["digest", "_key"]).select("digest", "id", "keep_id", "group_size", "_key")
        plain = plain.join(collided, "digest", "left_anti").withColumn("_key", F.lit(None).cast("string")).unionByName(told)
    else:
        plain = plain.withColumn("_key", F.lit(None).cast("string"))
    first = F.row_number().over(Window.partitionBy("digest", "_key", "id").orderBy(F.lit(1)))
    rest = plain.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    stay = plain.filter(F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("kept", first == 1)
    return rest.unionByName(stay).drop("_key").withColumnRenamed("id", id_column)


def keep_distinct(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of df that duplicate_groups keeps, with their columns under their names.

    Of rows that repeat both id and text (null counts as empty) one stays. Rows of
    groups that lose none aren't moved. Null ids, empty, null and very long texts,
    ties and an empty df are as in duplicate_groups.
    """
    groups = duplicate_groups(df, id_column, text, keep)
    dropped = materialize(groups.filter(~F.col("kept")).select(F.col(id_column).alias("id"), "digest", F.col(id_column).eqNullSafe(F.col("keep_id")).alias("repeat")), "dropped")
    digest = sha256(text_or_empty(df[text]))
    rest = without(df, {"id": df[id_column], "digest": digest}, dropped.filter(~F.col("repeat")))
    repeated = dropped.filter("repeat").select("digest").distinct()
    if not (n := repeated.count()):
        return rest
    key = fresh("_digest", df)
    bits = filter_bits(n)
    hits, misses = split_by_filter(rest.withColumn(key, sha256(text_or_empty(text))), F.col(key), materialize(filter_of(repeated, bits), "filter"), bits)
    return misses.unionByName(hits.dropDuplicates([id_column, key])).drop(key)
