"""Connected components of an edge list that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stage


def components(edges: DataFrame) -> DataFrame:
    """One row (``node``, ``component``) per node of ``edges`` (``a``, ``b``): the smallest node reached.

    In every round a node takes the smallest label among its own and its neighbours', and
    then the label of the node that its label names. Labels only get smaller and stay in
    the component; the rounds end when none changes, after a number that grows with the
    logarithm of the length of paths. The labels of each round are written to the shared
    folder, so that lineage ends there.
    """
    pairs = edges.where("a <> b").select("a", "b").distinct()
    pairs = stage(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = pairs.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("b")).select(
            "node", F.col("label").alias("before"), F.least("label", "heard").alias("label")
        )
        lower = stage(lower, "labels")
        above = lower.select(F.col("node").alias("up"), F.col("label").alias("further"))
        labels = stage(
            lower.join(above, F.col("label") == F.col("up")).select("node", "before", F.col("further").alias("label")),
            "labels",
        )
        if labels.where("label <> before").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
