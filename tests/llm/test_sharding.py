import random
import zlib

import pytest

from plumbline.llm import sharding


def smallest_capacity(sizes, shards):
    def needs(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needs(mid) <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("first, more", [(14, 10), (2, 1), (1, 30)])
@pytest.mark.parametrize("hot", [0, 200])
def test_minimax_and_slots(corpus, monkeypatch, first, more, hot):
    monkeypatch.setattr(sharding, "FIRST_BITS", first)
    monkeypatch.setattr(sharding, "MORE_BITS", more)
    monkeypatch.setattr(sharding, "UNIT_ROWS", 3)
    rng = random.Random(2)
    texts = ["é" * rng.randrange(300) for _ in range(250)] + [None, "", "copy"] + ["hot text"] * hot
    got = sharding.shard(corpus(list(enumerate(texts))), shards=7).collect()
    assert len(got) == len(texts)
    groups, where = {}, {}
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        groups[r.digest] = groups.get(r.digest, 0) + r.size
        assert where.setdefault(r.digest, r.shard) == r.shard
    order = sorted(groups)
    assert [where[d] for d in order] == sorted(where.values())
    loads = {}
    for d in order:
        loads[where[d]] = loads.get(where[d], 0) + groups[d]
    assert max(loads) < 7 and max(loads.values()) == smallest_capacity([groups[d] for d in order], 7)
    for s in loads:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_few_rows(corpus):
    assert sharding.shard(corpus([])).count() == 0
    got = sharding.shard(corpus([(1, "a"), (1, "a"), (None, "b")])).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3


def test_a_third_of_all_rows_without_an_id(corpus, monkeypatch):
    """Rows of one id or none do not share a unit: no window reads them all."""
    monkeypatch.setattr(sharding, "UNIT_ROWS", 5)
    texts = {i: f"text number {i} " * (1 + i % 9) for i in range(600)}
    docs = corpus([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in texts.items()])
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == 600 and sum(r.doc_id is None for r in got) == 200
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        # Rows without an id are spread over the slots instead of standing in one run.
        none = sorted(r.slot for r in got if r.shard == s and r.doc_id is None)
        assert len(none) < 10 or none[-1] - none[0] >= 2 * len(none)
