import math
import random
import re

from plumbline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None,
    "",
    "plain text",
    "MIT License\nmit-license, MIT  LICENSES and xmit license éMIT License",
    "apache\nlicense GNU General\tPublic\x00License CC BY 4.0",
    "Licensed under the Apache License, Version 2.0.\nmore",
    "the version 2 0 of licensed apache under",  # a template's words in another order
    "cc by cc by",
    "All rights reserved",
]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w, at, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def met(text, threshold):
    """Best share of each template over all windows of words, tried one by one."""
    w, out = words(text), {}
    for name, template in licenses.TEMPLATES.items():
        t = words(template)
        width, size = math.ceil(licenses.STRETCH * len(t) - 1e-9), len(set(t))
        for i in range(max(1, len(w) - width + 1)):
            share = len(set(t) & set(w[i : i + width])) / size
            if share > 0 and share >= threshold - 1e-9:
                out[name] = max(out.get(name, 0), share)
    return out


def test_against_brute_force(corpus):
    rows = list(enumerate(TEXTS))
    for threshold in (0.4, licenses.THRESHOLD, 1.0):
        for r in licenses.scan(corpus(rows), threshold=threshold).collect():
            t = TEXTS[r.doc_id]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
            own = met(t, threshold)
            assert r.labels == ",".join(sorted(set(own) | set(filter(None, r.base_labels.split(",")))))
            best = {}
            for b in r.blocks:
                assert 0 <= b.start < b.end <= r.n_words
                best[b.template] = max(best.get(b.template, 0), b.share)
            assert best == own and r.score == (1.0 if r.n_base else max(own.values(), default=0.0))


def test_order_is_by_corpus_frequency(corpus):
    vocabulary = licenses.Matcher(licenses.TEMPLATES, {}, 0.8).vocabulary
    docs = corpus([(1, "mit mit\nmit gnu\nother"), (2, None), (2, "mit")])
    counts = licenses.word_frequency(docs.select("text"), vocabulary)
    assert sorted(c for c in counts.values() if c) == [1, 1, 4]  # gnu, other, mit


def test_no_rows_and_repeats(corpus):
    assert licenses.scan(corpus([])).count() == 0
    got = licenses.scan(corpus([(1, "mit license"), (1, "mit license"), (None, "x")])).collect()
    assert sorted(r.n_base for r in got) == [0, 1, 1]


def test_wrapped_notices_bodies_with_edits_and_far_words(corpus):
    filler = "grass river seven mountain " * 500
    wrapped = "/*\n * Redistribution and use in source and binary forms,\n * with or without modification, are permitted\n */"
    body = licenses.TEMPLATES["mit-body"].replace("software", "library").replace("hereby", "").upper()
    header = filler + "This Source Code Form is subject to the terms of the Mozilla\n// Public License, v. 2.0. If a copy of the MPL was not\n// distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/." + filler
    far = f"all {filler} rights {filler} reserved"
    got = {r.doc_id: r for r in licenses.scan(corpus([(1, wrapped), (2, body), (3, header), (4, far), (5, filler)])).collect()}
    assert got[1].labels == "bsd-notice" and got[3].labels == "mpl-header"
    assert got[2].labels == "mit-body" and 0.8 <= got[2].score < 1
    assert [(b.start, b.template) for b in got[3].blocks] == [(2000, "mpl-header")]
    assert got[4].labels == got[5].labels == "" and got[4].score == 0


def test_windows_of_random_words(corpus):
    """Texts of template words in any order, with others between: every window is found."""
    rng = random.Random(4)
    pool = [w for t in licenses.TEMPLATES.values() for w in t.split()] + ["x", "y"] * 20
    texts = []
    for _ in range(60):
        part = rng.choice(list(licenses.TEMPLATES.values())).split()
        part = [w for w in part if rng.random() > 0.15]
        for _ in range(rng.randrange(1 + len(part) // 3)):
            part.insert(rng.randrange(len(part) + 1), rng.choice(pool))
        texts.append(" ".join(rng.choices(pool, k=rng.randrange(30)) + part + rng.choices(pool, k=rng.randrange(30))))
    for r in licenses.scan(corpus(list(enumerate(texts)))).collect():
        own = met(texts[r.doc_id], licenses.THRESHOLD)
        assert {b.template for b in r.blocks} == set(own)
        assert r.score == (1.0 if r.n_base else max(own.values(), default=0.0))


def test_no_templates(corpus):
    (r,) = licenses.scan(corpus([(1, "mit license")]), templates={}).collect()
    assert r.labels == "mit" and r.blocks == []
