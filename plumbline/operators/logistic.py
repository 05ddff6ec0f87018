"""Logistic regression by Newton steps for many models at once.

Every step is one aggregate over the rows: per model the weighted Gram matrix of the features
and the gradient, summed on the map side, so that the shuffle carries one row per task and
model. Rows are not copied to models; they are spread over the models they train while they
are read. What reaches the driver is one matrix of features x features per model; the number
of steps is fixed, so that a result does not depend on a stopping rule.

Features are standardised by each model's own training statistics; a missing value stands at
the mean. The intercept is not penalised.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import finite, logistic, total

# Newton steps, and the ridge penalty per training row.
STEPS, RIDGE = 6, 1e-3


def scales(params: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """``keys`` and arrays ``mu`` and ``sd`` over both classes, from class statistics
    (``fit_view_params``); a feature that never varies or occurs gets spread 1."""
    mu, sd = [], []
    for f in features:
        n, m, v = ([F.col(f"{f}__{k}{c}") for c in (0, 1)] for k in "nmv")
        part = [F.coalesce(n[c] * m[c], F.lit(0.0)) for c in (0, 1)]
        mean = F.coalesce((part[0] + part[1]) / F.nullif(n[0] + n[1], F.lit(0)), F.lit(0.0))
        inside = [F.when(n[c] > 1, (n[c] - 1) * v[c]).otherwise(F.lit(0.0)) for c in (0, 1)]
        apart = [F.coalesce(n[c] * (m[c] - mean) * (m[c] - mean), F.lit(0.0)) for c in (0, 1)]
        spread = (inside[0] + inside[1] + apart[0] + apart[1]) / F.nullif(n[0] + n[1] - 1, F.lit(0))
        mu.append(mean)
        sd.append(F.coalesce(F.sqrt(F.when(spread > 1e-12, spread)), F.lit(1.0)))
    return params.select(*keys, F.array(*mu).alias("mu"), F.array(*sd).alias("sd"))


def _standard(features: list[str], of: str) -> list[Column]:
    """1 and the standardised features; ``of`` has ``mu`` and ``sd``."""
    mean, spread = (lambda j, k=k: F.element_at(F.col(f"{of}.{k}"), j + 1) for k in ("mu", "sd"))
    return [F.lit(1.0), *[F.coalesce((finite(f) - mean(j)) / spread(j), F.lit(0.0)) for j, f in enumerate(features)]]


def logit(features: list[str], of: str) -> Column:
    """Log odds of class 1; ``of`` has ``mu``, ``sd`` and ``b``."""
    return total([F.element_at(F.col(f"{of}.b"), j + 1) * z for j, z in enumerate(_standard(features, of))])


def probability(features: list[str], of: str) -> Column:
    """Probability of class 1; null if the row has none of the features."""
    seen = F.coalesce(*[finite(f) for f in features]).isNotNull()
    return F.when(seen, logistic(logit(features, of)))


def _attached(rows: DataFrame, models: list[dict], keys: list[str], kind: T.StructType) -> DataFrame:
    """The models, which are few, are sent to every task: rows of one model never have to meet."""
    named = [T.StructField(f"_key_{k}", rows.schema[k].dataType) for k in keys]
    table = rows.sparkSession.createDataFrame(
        [(*[m[k] for k in keys], {n: m[n] for n in ("mu", "sd", "b")}) for m in models],
        T.StructType([*named, T.StructField("_M", kind)]),
    )
    if not keys:
        return rows.withColumn("_M", table.scalar())
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_key_{k}") for k in keys])
    return rows.join(F.broadcast(table), same).drop(*[f.name for f in named])


_MODEL = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("mu", "sd", "b")])


def fit_logistic(
    rows: DataFrame,
    params: DataFrame,
    features: list[str],
    keys: list[str],
    y: str = "y",
    steps: int = STEPS,
    ridge: float = RIDGE,
) -> DataFrame:
    """``keys``, ``mu``, ``sd`` and ``b`` (intercept first) of every model.

    ``rows`` has ``keys`` (the model a row trains), ``y`` and the features; pass each model's
    training rows only. ``params`` has the class statistics of the same rows. A model without
    both classes keeps coefficients 0.
    """
    spark = rows.sparkSession
    scaled = scales(params, features, keys)
    models = [{**r.asDict(), "b": [0.0] * (len(features) + 1)} for r in scaled.collect()]
    used = rows.where(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias("_y"), *features)
    d = len(features) + 1
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    for _ in range(steps if models else 0):
        z = {f"_z{j}": c for j, c in enumerate(_standard(features, "_M"))}
        step = _attached(used, models, keys, _MODEL)
        step = step.select(*keys, "_y", logistic(logit(features, "_M")).alias("_p"), *[c.alias(n) for n, c in z.items()])
        weight = F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum(weight * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs]
        sums += [F.sum((F.col("_y") - F.col("_p")) * F.col(f"_z{i}")) for i in range(d)]
        seen = [F.count("*").alias("n"), F.min("_y").alias("low"), F.max("_y").alias("high")]
        found = step.groupBy(*keys).agg(F.array(*sums).alias("sums"), *seen).collect()
        by_key = {tuple(str(r[k]) for k in keys): r for r in found}
        for m in models:
            r = by_key.get(tuple(str(m[k]) for k in keys))
            if r is None or r["low"] == r["high"]:
                continue
            gram, b = np.zeros((d, d)), np.array(m["b"])
            for (i, j), s in zip(pairs, r["sums"]):
                gram[i, j] = gram[j, i] = s
            penalty = np.diag([0.0] + [ridge * r["n"]] * (d - 1))
            gradient = np.array(r["sums"][len(pairs) :]) - penalty @ b
            m["b"] = (b + np.linalg.solve(gram + penalty, gradient)).tolist()
    kinds = T.StructType([scaled.schema[k] for k in keys] + list(_MODEL.fields))
    return spark.createDataFrame([tuple(m[f.name] for f in kinds.fields) for m in models], kinds)
