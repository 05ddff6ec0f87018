import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import trees
from plumbline.spec import ViewSpec

SPEC = ViewSpec({"pair": ("u", "v"), "one": ("w",), "none": ("x",)})
SCHEMA = "id long, y int, u double, v double, w double, x double"


def made(seed, n=1200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u, v, w = rng.gauss(0, 1), float(rng.randrange(4)), rng.expovariate(1)
        y = int((u > 0.5) != (v >= 2) if rng.random() < 0.9 else rng.random() < 0.5)
        rows.append((i, y if i % 50 else None, None if i % 11 == 0 else u, None if i % 13 == 0 else v, None if i % 3 == 0 else w, None))
    return rows


def grown(rows, columns):
    """One view's tree by trying every cut of every node's rows, on plain values."""
    x = np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in rows], dtype=float)
    y = np.array([-1 if r[1] is None else r[1] for r in rows])
    keep = (y >= 0) & ~np.isnan(x).all(axis=1)
    edges = []
    for j in range(len(columns)):
        values = np.sort(x[y >= 0, j][~np.isnan(x[y >= 0, j])])
        edges.append(np.quantile(values, np.arange(1, trees.BINS) / trees.BINS) if len(values) else [])
    x, y = x[keep], y[keep]
    low = np.where(np.isnan(x), -np.inf, x)
    nodes = {}

    def split(node, at):
        n, p = int(at.sum()), int(y[at].sum())
        nodes[node] = (n, p, None, None)
        if node >= 2**trees.DEPTH:
            return
        best = (0.0,)
        for j in range(len(columns)):
            for cut in [-np.inf, *edges[j]]:
                left = at & (low[:, j] <= cut)
                nl, pl = int(left.sum()), int(y[left].sum())
                if min(nl, n - nl) < trees.MIN_ROWS:
                    continue
                gain = pl**2 / nl + (p - pl) ** 2 / (n - nl) - p**2 / n
                if gain > max(best[0] + 1e-9, trees.MIN_GAIN):
                    best = (gain, j, cut, left)
        if len(best) > 1:
            nodes[node] = (n, p, best[1], best[2])
            split(2 * node, best[3])
            split(2 * node + 1, at & ~best[3])

    if len(y):
        split(1, np.ones(len(y), bool))
    return nodes


def walk(nodes, values):
    node = 1
    if not nodes or all(v is None for v in values):
        return None
    while nodes[node][2] is not None:
        x = values[nodes[node][2]]
        node = 2 * node + (x is not None and x > nodes[node][3])
    return (nodes[node][1] + 1) / (nodes[node][0] + 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    fitted = trees.fit_trees(df, SPEC)
    got = {(r["view"], r["node"]): r for r in fitted.collect()}
    expected = {"pair": grown(rows, (2, 3)), "one": grown(rows, (4,)), "none": {}}
    assert set(got) == {(v, n) for v, nodes in expected.items() for n in nodes}
    for v, nodes in expected.items():
        for n, (count, hits, feature, _) in nodes.items():
            r = got[v, n]
            assert (r["n"], r["p"], r["f"]) == (count, hits, feature)
    assert max(n for v, n in got if v == "pair") >= 4
    scored = {r["id"]: r for r in trees.score_views(df, SPEC, fitted).collect()}
    assert len(scored) == len(rows)
    for r in rows:
        for v, at in (("pair", r[2:4]), ("one", r[4:5]), ("none", r[5:6])):
            want = walk(expected[v], at)
            assert scored[r[0]][f"p_{v}"] == (None if want is None else pytest.approx(want))


def test_interactions_that_single_gaussians_miss(spark):
    """Classes differ by a combination of two features only; trees tell them apart on other rows."""
    df = spark.createDataFrame(made(3, 3000), SCHEMA)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0 and u is not null and v is not null and y is not null")
    out = trees.score_views(test, SPEC, trees.fit_trees(train, SPEC))
    right = out.select(F.avg(((F.col("p_pair") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]
    assert right > 0.8


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trees.fit_trees(empty, SPEC).count() == 0
    some = spark.createDataFrame([(1, 1, 0.5, None, None, None)], SCHEMA)
    assert trees.score_views(some, SPEC, trees.fit_trees(empty, SPEC)).first()["p_pair"] is None
    # Equal values and a single class: one leaf each, whatever the number of rows.
    same = spark.range(100).select(
        "id", F.lit(1).alias("y"), *[F.lit(2.0).alias(c) for c in "uvw"], F.lit(None).cast("double").alias("x")
    )
    nodes = trees.fit_trees(same, SPEC).collect()
    assert [(r["node"], r["n"], r["p"], r["feature"]) for r in nodes] == [(1, 100, 100, None)] * 2
    assert trees.score_views(same, SPEC, trees.fit_trees(same, SPEC)).first()["p_one"] == 101 / 102
