import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing


def filled(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a cap is fixed, and the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("cells", [1, 3, 4096])
def test_against_a_plain_selection(spark, corpus, monkeypatch, cells):
    monkeypatch.setattr(mixing, "CELLS", cells)
    rng = random.Random(5)
    sources = ["b", "a", "é", None, "B", "tiny", "zz"]
    rows = []
    for i in range(300):
        s = "b" if i % 3 == 0 else sources[i % 7]
        n = 1 if s == "tiny" else rng.choice([0, 1, 5, 9, 30])
        rows.append((i, " ".join(["w"] * n) if n or i % 2 else None, s))
    quality = spark.createDataFrame([(i, [0.5, 2.0, None, -1.0][i % 4]) for i in range(0, 300, 2)], "doc_id long, weight double")
    docs = corpus(rows)
    got = {r.doc_id: r for r in mixing.mix(docs, quality).collect()}
    size = {i: len(re.findall(mixing.WORD, t or "")) for i, t, _ in rows}
    per = {}
    for i, _, s in rows:
        per[s] = per.get(s, 0) + size[i]
    target = filled(per)
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(mixing.SEED, F.col("doc_id")).alias("u")).collect()}
    q = {r.doc_id: r.weight for r in quality.collect()}
    for s in per:
        mine = [i for i, _, x in rows if x == s]
        assert {got[i].source_size for i in mine} == {per[s]}
        assert all(got[i].target == pytest.approx(target[s]) for i in mine)
        epochs = math.floor(got[mine[0]].target / per[s]) if per[s] else 0
        rest, begin = got[mine[0]].target - epochs * per[s], 0
        for i in sorted(mine, key=lambda i: -math.log(u[i]) / (q.get(i) if (q.get(i) or 0) > 0 else 1.0)):
            end = begin + size[i]
            more = end <= rest or (begin < rest and end - rest < rest - begin)
            if size[i]:
                assert got[i].copies == epochs + more, (s, i)
            begin = end
        taken = sum(got[i].taken for i in mine)
        assert abs(taken - target[s]) <= max(size[i] for i in mine) / 2 + 1e-6
    assert all(r.taken <= 3 * r.size for r in got.values())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), quality).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_rows_are_taken_as_often_as_mixed(corpus):
    docs = corpus([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(20)] + [(3, "w " * 4, "b"), (None, "x", None)])
    mixed = mixing.mix(docs)
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns
    count = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    once = {r.doc_id: r.copies for r in mixed.collect() if r.doc_id != 3}
    assert {i: n for i, n in count.items() if i != 3} == {i: n for i, n in once.items() if n}


def test_no_rows_and_no_words(corpus):
    assert mixing.mix(corpus([])).count() == 0
    (r,) = mixing.mix(corpus([(1, " ", "s")])).collect()
    assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
