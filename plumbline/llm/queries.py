"""The operators of this package, each over the whole of its table, with the result columns agreed for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    collocations,
    fingerprints,
    licenses,
    linededup,
    lshforest,
    mixing,
    neighbours,
    ngramjoin,
    packing,
    prefixtrie,
    secrets,
    sharding,
    toxicity,
)
from plumbline.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, its documents in one language for a repository."""
    found = secrets.scan(
        documents(spark, sf_dir), repo=F.struct("source", "lang"), owner=F.col("source")
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        F.col("live").alias("n_live"),
        F.col("copied").alias("n_copied"),
        F.coalesce(F.array_max(F.col("spans.owners")), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.col("spans.repos")), F.lit(0)).alias("most_repos"),
    )


def toxicity_lexicon(docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_lexicon(docs, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "hits",
    )


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights from the quality labels: 2 for good, 1/2 for poor, 1 without a label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", (F.col("quality") * 1.5 + 0.5).alias("weight"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("blocks")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir), dropped="n_dropped")
    n_lines = F.size(F.split("text", "\n", -1)).cast("long") + F.col("n_dropped")
    return kept.select(
        "doc_id", F.coalesce(n_lines, F.lit(0)).alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "text"
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar(documents(spark, sf_dir))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_copies(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_secrets,
        op3_toxicity,
        op4_mixing,
        op5_line_dedup,
        op6_ngram_join,
        op7_sharding,
        op8_neighbours,
        op9_licenses,
        op10_packing,
        op11_prefix_trie,
        op12_collocations,
        op13_minhash_dedup,
    )
}
