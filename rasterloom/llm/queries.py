"""The queries opN_<name> and their SQL: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)
    return packed.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 hash shards to 16 of near-equal bytes."""
    from rasterloom.llm.sharding import reshard

    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64("doc_id", "text"), F.lit(12))
    placed = reshard(docs, old, old_shards=12, shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


@query
def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.embed import near_vectors

    found = near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


@query
def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) make pair k."""
    from rasterloom.llm.chat import preferences

    turns = table(spark, sf_dir, "conversations")
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["stop"])), ",")
    found = preferences(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1)) == 0)
    return found.select("pair_id", "has_both", "n_prompt_turns", "prompt", "chosen", spans("chosen_spans").alias("chosen_spans"), "rejected", spans("rejected_spans").alias("rejected_spans"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.round("score", 6).alias("score"),
    )


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.quality import bad_labels, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, bad_labels(labels), host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
    return found.withColumn("rejected", F.col("p_bad") > 0.4)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.suffix import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.llm.lm import score

    return score(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _texts() -> None:
    from rasterloom.llm import sql

    SQL.update(op4_preferences=sql.PREFERENCES, op6_decontamination=sql.OVERLAPS, op10_embeddings=sql.EMBEDDINGS, op9_licenses=sql.LICENSES)


_texts()
