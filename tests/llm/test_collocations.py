import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import collocations


def brute(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        can = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {(p[i:j], a) for p, a in can.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}
        scored = []
        for p, a in can.items():
            if (p, a) not in inside:
                s, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'x' as words", "'x' as a", "'x' as places", "'x' as phrase")


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Über", "é", "ÀB"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.5:
            words += "In The Long Run we All".split()
        if rng.random() < 0.3:
            words += ["hot", "pair", rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(1, None, "en"), (None, "", "en"), (7, "again again again", None), (7, "again again again", None)] * 3


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("bucket, portion", [(1_500_000, 6 << 20), (400, 2000)])
def test_against_brute_force(spark, monkeypatch, seed, bucket, portion):
    for name, value in (("LEAST", 5), ("BUCKET", bucket), ("PORTION", portion)):
        monkeypatch.setattr(collocations, name, value)
    rows = made(seed)
    got = collocations.mine(table(spark, rows), top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 40)


def test_heavy_prefixes_are_found(spark, monkeypatch):
    """One word has more places than a bucket holds; it is dealt by its pairs and its flow is summed."""
    for name, value in (("LEAST", 3), ("BUCKET", 100)):
        monkeypatch.setattr(collocations, name, value)
    rows = [(i, " ".join(f"the x{j} y{i % 3}" for j in range(40)), "en") for i in range(30)]
    got = collocations.mine(table(spark, rows), top=500)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 500)


def test_wide_numbers_and_one_long_text(spark):
    """Products beyond 64 bits, and a text of several megabytes."""
    rows = [(0, "alpha beta gamma. " * 300_000, "en")]
    got = collocations.mine(table(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 100, 2000)


def test_empty_table(spark):
    assert collocations.mine(table(spark, [])).collect() == []
    assert collocations.mine(table(spark, [(1, None, None)])).collect() == []
