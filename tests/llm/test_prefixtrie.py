import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    children, saved = defaultdict(list), {}
    for p, ms in members.items():
        saved[p] = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            children[p[:-1]].append(p)
    out, totals = [], {}
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        totals[p] = (sum(totals[k][0] for k in kids) or 1, saved[p] + sum(totals[k][1] for k in kids))
        ends = ",".join(str(c) for c in sorted(c for c, n in members[p] if n == len(p)))
        name = lambda q: min(c for c, _ in members[q])
        out.append(
            (name(p), len(p), name(p[:-1]) if p else None, len(members[p]), len(kids), *totals[p], hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conv", "'x' as depth", "'x' as at", "'x' as kids")
    return [tuple(r) for r in prefixtrie.prefix_trie(df).collect()]


def check(spark, rows):
    key = lambda r: (r[1], r[0])
    assert sorted(found(spark, rows), key=key) == sorted(brute(rows), key=key)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 45), -7, -20, 1000, 5000, 9000]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "a  b\tc"])))
    return rows + rows[:20] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed, cell", [(0, 4096), (1, 3)])
def test_against_brute_force(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(prefixtrie, "CELL", cell)
    check(spark, made(seed))


def test_growing_prefixes_and_a_long_conversation(spark, monkeypatch):
    """Names fall as conversations grow, so that every node of the long path has another smallest member."""
    monkeypatch.setattr(prefixtrie, "CELL", 8)
    same = [c for c in range(20, 4000) if zlib.crc32(str(c).encode()) % 4 == 0][:14]
    rows = [(c, t, "user", f"w {t}") for k, c in enumerate(reversed(same)) for t in range(1 + 3 * k)]
    check(spark, rows)


def test_many_members_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CELL", 16)
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(4)]
    check(spark, rows)


def test_turnless_conversations_and_empty_table(spark):
    alone = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    check(spark, [(alone, 0, "user", "gone")])
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []
