import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprints as fp
from tests.llm.test_words import shingles


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        e = t[: len(t) - m] + after[:m]
        yield i, (len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(t, e), jaccard(t, after))


@pytest.mark.parametrize("per_range", [1, 3, 4096])
def test_edits_and_likeness(corpus, monkeypatch, per_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", per_range)
    rng = random.Random(1)
    words = ["un", "deux", "trois", "é漢", "x" * 30]
    rows = [(i * 7 - 50, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(30)]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, rows[3][1]), (1004, "🙂" * 10)]
    got = {r.doc_id: r for r in fp.compare_with_edits(corpus(rows)).collect()}
    want = dict(expected(rows))
    assert got.keys() == want.keys()
    for i, (n, sha, near_edit, near_next) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        # All sets are smaller than a sketch, so the estimates are exact.
        assert r.near_edited == pytest.approx(near_edit) and r.near_next == pytest.approx(near_next)
    assert got[1003].fingerprint == got[rows[3][0]].fingerprint and got[1000].fingerprint == ""


def test_one_row_ties_nulls_and_no_rows(corpus):
    assert fp.compare_with_edits(corpus([])).count() == 0
    (r,) = fp.compare_with_edits(corpus([(5, "abcdef")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(1, "a b c"), (1, "a b c"), (None, "z"), (2, "q")]
    got = fp.compare_with_edits(corpus(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (True, 0)]


def test_estimates_of_large_sets(spark):
    a, b = np.arange(1, 9001, dtype=np.uint64), np.arange(3001, 12001, dtype=np.uint64)
    a, b = (np.sort(fp.shingle_sets.__globals__["mix"](x) >> np.uint64(16)) for x in (a, b))
    assert fp.likeness(a[:256], b[:256]) == pytest.approx(0.5, abs=0.12)
    df = spark.createDataFrame([(a[:256].tolist(), b[:256].tolist())], "a array<long>, b array<long>")
    r = df.select(
        fp.resemblance(F.col("a"), F.col("b")).alias("r"),
        fp.containment(F.col("a"), F.col("b")).alias("c"),
        fp.distinct_shingles(F.col("a")).alias("n"),
    ).first()
    assert r.r == pytest.approx(fp.likeness(a[:256], b[:256])) and r.c == pytest.approx(2 / 3, abs=0.15)
    assert r.n == pytest.approx(9000, rel=0.2)


def test_merged_sketch_is_the_sketch_of_the_union(corpus):
    rows = [(i, " ".join(f"w{(i * 37 + k) % 500}" for k in range(120)), "ab"[i % 2]) for i in range(40)]
    docs = corpus(rows, extra=False)
    sketched = fp.fingerprint(docs).join(docs.select("doc_id", "source"), "doc_id")
    merged = {r.source: r.sketch for r in fp.merge(sketched, "source").collect()}
    for s in "ab":
        union = np.unique(np.concatenate(list(fp.shingle_sets([t for _, t, x in rows if x == s]))))
        assert merged[s] == (union >> np.uint64(16)).astype(np.int64)[:256].tolist()


def test_rows_of_one_id_or_none_are_dealt_to_many_ranges(corpus, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 4)
    rows = [(None, f"nobody {i} said so") for i in range(60)] + [(7, f"seven {i} times") for i in range(60)]
    rows += [(i, f"own {i} text") for i in range(20, 80)]
    docs = corpus(rows, extra=False)
    own = fp._in_order(docs.select("doc_id", "text")).where("not guest").groupBy("range").count().toPandas()["count"]
    assert own.sum() == 180 and own.max() < 40
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        want.append((str(i), hashlib.sha256(fp.edited(text, following).encode()).hexdigest()))
    got = fp.compare_with_edits(docs).collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(want)
