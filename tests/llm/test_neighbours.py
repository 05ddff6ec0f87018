import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "1 as vector", "1 as dim", "1 as shard", "1 as block", "1 as ask"
    )


def brute(rows, k):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            ok[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, v in ok.items():
        if q % 20 == 0:
            each = []
            for i, w in ok.items():
                if i != q and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v.tolist(), w.tolist()):
                        s += a * b
                    each.append((-s, i))
            out[q] = [(i, -s) for s, i in sorted(each)[:k]]
    return {q: x for q, x in out.items() if x}


def made(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * 0.4
    return [(i, x[i].astype(np.float32).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("shard, block, leaf", [(10_000, 10_000, 8), (70, 5, 4), (10_000, 10_000, 1000)])
def test_factor_one_is_exact(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", shard)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours.Tree.__init__, "__defaults__", (leaf,))
    rows = made(400, 6)
    rows += [(1000 + i, rows[7][1], 0) for i in range(60)]  # one vector of many rows
    rows += [(2000, None, 0), (2020, [0.0] * 6, 0), (2040, [float("nan")] + [1.0] * 5, 0), (2060, [None] * 6, 0)]
    rows += [(2080, [], 0), (None, rows[1][1], 0), (2100, [1.0, 2.0], 0), (2101, [3.0, 1.0], 0), rows[20]]
    got = {}
    for r in neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    assert got == brute(rows, 20)


@pytest.mark.parametrize("kind", ["binary", "one-hot", "coarse"])
def test_ties_go_to_the_smaller_id(spark, monkeypatch, kind):
    """Very many different vectors are equally near."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 250)
    rng = np.random.default_rng(4)
    x = {
        "binary": rng.integers(0, 2, (600, 12)),
        "one-hot": np.eye(300)[rng.permutation(600) % 300] * 1.0,
        "coarse": rng.integers(-2, 3, (600, 6)) / 10,
    }[kind]
    rows = [(int(i), [float(c) for c in v], 0) for i, v in zip(rng.permutation(600), x)]
    got = {}
    for r in neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, 20)


def test_relaxed_pruning_keeps_recall():
    x = np.array([v for _, v, _ in made(4000, 16, 1)])
    tree = neighbours.Tree(x, 64)
    want = np.argsort(-(x[::20] @ x.T), axis=1)[:, :20]
    for factor, least in ((1.0, 1.0), (0.8, 0.9)):
        found, _ = tree.search(x[::20], 20, factor)
        recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), want.tolist())])
        assert recall >= least


def test_few_rows(spark):
    assert neighbours.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    got = neighbours.nearest(table(spark, [(0, [1.0], 0), (20, [2.0], 0)]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 20, 2.0), (20, 0, 2.0)]
