import random

import pytest

from plumbline.llm import toxicity as tox

CLEAN = [f"{a}{b}" for a in ("mo", "ri", "ta", "su", "ke", "pla") for b in ("ren", "dol", "vis", "mak", "ton")]


def made(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grubnak", "grubnaks", "zworfel", "zwоrfel", "gru6nak".replace("6", "b")])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learned_lexicon_holds_on_held_out_rows(spark, corpus):
    rows, labels = made(900)
    docs = corpus(rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = tox.fit(docs, lab)
    assert any(t.startswith(" gru") for t in lexicon.terms) and any(t.startswith(" zwo") for t in lexicon.terms)
    got = {r.doc_id: r.score for r in tox.score(docs, lexicon).collect()}
    held = {r.doc_id for r in docs.where(tox.held_out(docs.doc_id)).collect()}
    assert 200 < len(held) < 400
    right = [(got[i] >= tox.THRESHOLD) == bool(t) for i, _, t in labels if i in held]
    assert sum(right) / len(right) > 0.97
    kept = {r.doc_id for r in tox.without_toxic(docs, lexicon).collect()}
    assert kept == {i for i, s in got.items() if s < tox.THRESHOLD}
    # Held-out labels do not matter.
    flipped = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], lab.schema)
    assert tox.fit(docs, flipped).terms == lexicon.terms


def test_folding():
    assert tox.fold("IDI0T ｉｄｉｏｔ іdiоt id​iot, 1d1ot!") == ["idiot"] * 5
    assert tox.fold("é-Ü 漢字") == ["é", "ü", "漢字"] and tox.fold("") == []


def test_weights_lengths_and_exceptions():
    lexicon = tox.Lexicon({" trash": 3.0, " idiot ": 2.0}, ["trash can"], (-4.0, 1.0, 1.0))
    assert lexicon.match("the trash can is full") == (0.0, 0, 5)
    assert lexicon.match("trash idiot idiots") == (5.0, 2, 3)
    assert lexicon.match("trash can trashy") == (3.0, 1, 3)
    import numpy as np

    short, long = (lexicon.match("trash " + "word " * n) for n in (5, 500))
    s = lexicon.score(np.array([short, long], float))
    assert s[0] > s[1]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, None), (None, 1, 0)]])
def test_no_labels_of_a_class_nulls_and_repeats(spark, corpus, labels):
    docs = corpus([(1, None), (1, None), (2, ""), (None, "idiot")])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tox.score(docs, tox.fit(docs, lab)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0}
    assert tox.score(corpus([]), tox.fit(corpus([]), lab)).count() == 0
