import random
from collections import Counter, defaultdict

import pytest

from plumbline.operators import groups

SCHEMA = "record_id long, entity long, class string"


def made(seed, entities, hot=0):
    """Entities of very different sizes and mixtures; the hot one holds ``hot`` records."""
    rng = random.Random(seed)
    rows = []
    for e in range(entities):
        mix = rng.choice(["a", "ab", "abc", "c"])
        rows += [(e, rng.choice(mix)) for _ in range(rng.choice([1, 1, 2, 5, 20]))]
    rows += [(-1, rng.choice("abc")) for _ in range(hot)]
    rows += [(None, rng.choice("ab")) for _ in range(entities // 2)]
    return [(i, e, c) for i, (e, c) in enumerate(rows)]


def shares(rows, part_of, parts):
    total, inside = Counter(c for _, _, c in rows), defaultdict(Counter)
    for i, _, c in rows:
        inside[part_of[i]][c] += 1
    return {(p, c): inside[p][c] / total[c] for p in parts for c in total}


def test_no_entity_in_two_parts_and_even_classes(spark):
    rows = made(1, 3000)
    got = groups.group_split(spark.createDataFrame(rows, SCHEMA), "record_id", "entity", "class").collect()
    split = {r["record_id"]: r["split"] for r in got}
    assert len(got) == len(rows) == len(split)
    of = defaultdict(set)
    for i, e, _ in rows:
        if e is not None:
            of[e].add(split[i])
    assert max(map(len, of.values())) == 1
    found = shares(rows, split, groups.NAMES)
    for name, share in zip(groups.NAMES, groups.SHARES):
        for c in "abc":
            assert abs(found[name, c] - share) < 0.02, (name, c, found)


def test_hot_entity_goes_to_the_part_that_can_hold_it(spark):
    rows = made(2, 1500, hot=4000)
    got = groups.group_split(spark.createDataFrame(rows, SCHEMA), "record_id", "entity", "class").collect()
    split = {r["record_id"]: r["split"] for r in got}
    assert {split[i] for i, e, _ in rows if e == -1} == {"train"}
    found = shares(rows, split, groups.NAMES)
    for c in "abc":  # what the hot entity takes from train is made up for by the others
        assert abs(found["train", c] - 0.6) < 0.03
        assert abs(found["test", c] - 0.2) < 0.03


def test_folds_differ_between_repeats(spark):
    rows = made(3, 800)
    got = groups.group_folds(spark.createDataFrame(rows, SCHEMA), "record_id", "entity", "class", 4, 2).collect()
    assert len(got) == 2 * len(rows)
    fold = {(r["record_id"], r["repeat"]): r["fold"] for r in got}
    for repeat in (1, 2):
        of = defaultdict(set)
        for i, e, _ in rows:
            if e is not None:
                of[e].add(fold[i, repeat])
        assert max(map(len, of.values())) == 1
        sizes = Counter(fold[i, repeat] for i, _, _ in rows)
        assert max(sizes.values()) - min(sizes.values()) < 0.03 * len(rows)
    assert any(fold[i, 1] != fold[i, 2] for i, _, _ in rows)


@pytest.mark.parametrize("rows", [[], [(1, 1, None)], [(1, None, "a"), (2, None, None)]])
def test_few_records(spark, rows):
    got = groups.group_split(spark.createDataFrame(rows, SCHEMA), "record_id", "entity", "class").collect()
    assert sorted(r["record_id"] for r in got) == [r[0] for r in rows]
    assert {r["split"] for r in got} <= set(groups.NAMES)
