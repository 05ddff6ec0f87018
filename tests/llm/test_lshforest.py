import random

import numpy as np
import pytest

from plumbline.llm import lshforest
from tests.llm.test_ngramjoin import edited, made


def sets(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    own = [(i, sets(t)) for i, t in rows]
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    least = {}
    for k, (i, s) in enumerate(own):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    name = lambda k, i, s: least.get(root(k)) if s else i
    return sorted(((i, len(s), name(k, i, s), i == name(k, i, s)) for k, (i, s) in enumerate(own)), key=str)


def found(corpus, rows):
    return sorted((tuple(r) for r in lshforest.near_copies(corpus(rows)).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("region, rows_, cluster", [(1000, 500_000, 2_000_000), (4, 50, 500)])
def test_components_against_all_pairs(corpus, monkeypatch, seed, region, rows_, cluster):
    for name, value in (("REGION", region), ("ROWS", rows_), ("CLUSTER", cluster)):
        monkeypatch.setattr(lshforest, name, value)
    rows = made(seed)
    assert found(corpus, rows) == brute(rows)


def test_dense_region(corpus, monkeypatch):
    """Texts that share a long passage but are no copies, and a few that are."""
    monkeypatch.setattr(lshforest, "REGION", 20)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(30 if i % 5 else 4)]
        rows.append((i, " ".join(edited(rng, base, 2) + own)))
    assert found(corpus, rows) == brute(rows)


def test_nulls_repeats_and_no_ids(corpus):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text + " x"), (None, "alone in the dark now"), (None, "alone in the dark now")]
    rows += [(None, None), (3, None), (2, ""), (1, " "), (9, "a b"), (8, "A b")]
    rows += [(None, f"many rows without id {i} {i + 1} {i + 2}") for i in range(30)]
    assert found(corpus, rows) == brute(rows)


def test_empty_table(corpus):
    assert found(corpus, []) == []


def test_minima_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1400).astype(np.uint64)
    a, b = lshforest.signature(pool[:1000]), lshforest.signature(pool[100:1100])
    assert abs((a == b).mean() - 900 / 1100) < 0.15
    assert (lshforest.regions(a) == lshforest.regions(b)).any()
