import random

import numpy as np
import pytest

from plumbline.llm import ngramjoin
from plumbline.llm.components import components
from tests.llm.test_words import shingles


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    names = {}
    for k, (i, s) in enumerate(sets):
        r = root(k)
        if i is not None:
            names[r] = min(i, names.get(r, i))
    return sorted((i, len(s), names.get(root(k)) if s else i) for k, (i, s) in enumerate(sets) if i is not None)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], [rng.choice("klmno")], [words[k], "zz"]])
    return words


def made(seed):
    """Groups of edited copies, a very common passage, shared words, tiny and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))
    common = [word() for _ in range(12)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            t = edited(rng, base, rng.choice([0, 0, 1, 2, 4]))
            texts.append(" ".join(common + t if rng.random() < 0.4 else t))
    texts += [None, "", " ", "a b", "A b", "b a", "a b c d e", "a b c d e f", "a b c d e f g"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("long, portion, bucket, cluster", [(32, 2_000_000, 3_000_000, 4_000_000), (3, 300, 200, 500)])
def test_components_against_all_pairs(corpus, monkeypatch, seed, long, portion, bucket, cluster):
    for name, value in (("LONG", long), ("PORTION", portion), ("BUCKET", bucket), ("CLUSTER", cluster)):
        monkeypatch.setattr(ngramjoin, name, value)
    rows = made(seed)
    # The constants are read in the tasks' process as well: small ones are set by fewer rows a portion only.
    got = ngramjoin.similar(corpus(rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_search_finds_every_link():
    rng = np.random.default_rng(0)
    for trial in range(20):
        base = rng.choice(5000, 80, replace=False)
        sets = []
        for _ in range(60):
            keep = base[rng.random(80) < rng.choice([0.8, 0.9, 0.97])] if rng.random() < 0.8 else rng.choice(5000, 70, replace=False)
            sets.append(np.unique(np.concatenate([keep, rng.choice(5000, rng.integers(0, 9))])).astype(np.int64))
        sizes = np.array([len(s) for s in sets])
        index = ngramjoin.Index(sizes, sets)
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        links = []
        for a in range(len(sets)):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if 100 * o >= 75 * (sizes[a] + sizes[b] - o):
                    links.append((a, b))
        found = list(index.links())
        assert {frozenset(x) for x in found} <= {frozenset(x) for x in links}
        for pairs in (links,):
            for a, b in pairs:
                parent[max(root(a), root(b))] = min(root(a), root(b))
        want = [root(x) for x in range(len(sets))]
        parent[:] = range(len(sets))
        for a, b in found:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert [root(x) for x in range(len(sets))] == want


def test_repeats_nulls_and_no_rows(corpus):
    rows = [(5, "one two three four five six")] * 2 + [(None, "one two three four five six"), (None, None), (7, None)]
    got = ngramjoin.similar(corpus(rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7)]
    assert ngramjoin.similar(corpus([])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200), (119, 118), (118, 119)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
