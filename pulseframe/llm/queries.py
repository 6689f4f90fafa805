"""The registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import bpe, exact, lexical, media, mixing, phrases, prefixes, quality, repeats, secrets, simhash, tokens, urls
from pulseframe.llm.common import documents, materialize, scratch, text_or_empty


def hex_sha256(c) -> F.Column:
    return F.sha2(c.cast("binary"), 256)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        hex_sha256(shown(F.filter(spans, lambda s: s["kind"] != "entropy"))).alias("base_sha256"),
        shown(spans).alias("spans"),
        count("entropy").alias("n_entropy"),
        F.size("suppressed_spans").cast("long").alias("n_suppressed"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    stored = media.store_media(docs).select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "media")
    read = media.read_media(stored)
    payload, part = F.col("read.payload"), F.col("read")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(read.payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("pes="), F.size(part["pts"]).cast("string")),
            F.concat(F.lit("pts="), F.array_join(part["pts"].cast("array<string>"), ",")),
            F.concat(F.lit("rap="), F.array_join(part["random_access"].cast("array<string>"), ",")),
            F.concat(F.lit("cc_errors="), part["continuity_errors"].cast("string")),
        ).alias("feature"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.duplicate_groups(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_bpe": op2_bpe,
    "op3_media_columns": op3_media_columns,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filters": op5_url_filters,
}

ORACLES = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_url_filters": urls.FILTER_SQL,
}


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "tokens")
    tokens.write_tokens(documents(spark, sf_dir), at)
    read = tokens.read_tokens(spark, at).select("shard", "block", "doc_id", "ahead", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    read = read.join(tokens.block_starts(spark, at), ["shard", "block"])
    return read.select("doc_id", (F.col("first") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


QUERIES |= {"op6_token_files": op6_token_files, "op7_mixing": op7_mixing, "op9_simhash": op9_simhash}
ORACLES |= {"op7_mixing": mixing.MIX_SQL}


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES |= {"op10_quality": op10_quality}


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(documents(spark, sf_dir))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES |= {"op8_suffix_array_dedup": op8_suffix_array_dedup}


def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = phrases.remove_repeated_phrases(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept")).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialize(prefixes.ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return prefixes.prefix_trie(prefixes.rebuilt(turns), turns)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES |= {"op11_repeated_phrases": op11_repeated_phrases, "op12_prefix_trie": op12_prefix_trie, "op13_lexical_search": op13_lexical_search}
ORACLES |= {"op11_repeated_phrases": phrases.REPEATED_SQL, "op12_prefix_trie": prefixes.TRIE_SQL, "op13_lexical_search": lexical.SEARCH_SQL}
