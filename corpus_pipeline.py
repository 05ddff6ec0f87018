"""A training-data pipeline over ``documents``: toxic texts go, recurring lines are dropped,
one document of each group of near copies stays, sources are mixed to target weights, and
what is taken is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import linededup, mixing, ngramjoin, packing, toxicity
from plumbline.llm.common import prepare
from plumbline.llm.queries import documents, quality_weights, tokenizer_path, toxicity_lexicon
from plumbline.session import stage

def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold."""
    return toxicity.without_toxic(docs, toxicity_lexicon(docs, sf_dir))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays, the first by (doc_id, nulls last, hash of text).

    A document is a doc_id with one text, and stays or goes with all its rows. Rows without
    a doc_id are documents of their own: of those with equal texts one row stays. Texts
    without words have no copies.
    """
    mark, key = F.xxhash64("text"), F.col("doc_id").cast("long")
    named = ngramjoin.similar(docs.select(mark.alias("mark"), "text"), key="mark").where("n_shingles > 0")
    named = stage(named.select(F.col("doc_id").alias("mark"), "component_id").distinct(), "near_marks").hint("merge")
    members = docs.select(key.alias("doc_id"), mark.alias("mark")).distinct().join(named, "mark")
    members = members.withColumn("place", F.struct(F.isnull("doc_id").alias("last"), "doc_id", "mark"))
    members = stage(members, "near_members")
    first = stage(members.groupBy("component_id").agg(F.min("place").alias("first")), "near_first").hint("merge")
    goes = members.join(first, "component_id").where(~F.col("place").eqNullSafe(F.col("first")))
    goes = stage(goes.select("doc_id", "mark"), "near_copies").alias("g").hint("merge")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.mark"))
    stay = stage(docs.alias("d").join(goes, same, "left_anti"), "near_stay")
    unnamed = stay.where("doc_id is null").select(mark.alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    unnamed = unnamed.join(named.select("mark", F.lit(True).alias("known")), "mark", "left")
    once = unnamed.where("known").groupBy("mark").agg(F.min("row").alias("row")).select("row.*")
    others = unnamed.where("known is null").select("row.*")
    return stay.where("doc_id is not null").unionByName(once).unionByName(others)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs, mixing.mix(docs, quality_weights(spark, sf_dir)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_recurring_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: The toxicity fit, the template tree and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
