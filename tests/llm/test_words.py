import random

from plumbline.llm.words import NON_WORD, SPACE, chunks, shingle_sets, word_hashes


def spaced(text):
    return [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = spaced(lower(text or ""))
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def test_equal_words_have_equal_hashes_wherever_they_stand():
    texts = ["The cat  sat", "", "cat\tTHE", " sat ", "é é"]
    hashes, first = word_hashes(texts)
    assert first.tolist() == [0, 3, 3, 5, 6, 7]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and hashes[2] == hashes[5]
    assert len(set(hashes.tolist())) == 4


def test_separators():
    hashes, first = word_hashes(["a-b.c", "a b c", "naïve"], NON_WORD)
    assert first.tolist() == [0, 3, 6, 7] and (hashes[:3] == hashes[3:6]).all()
    assert word_hashes(["a-b"], SPACE)[1].tolist() == [0, 1]


def test_words_longer_than_a_piece():
    long = "x" * 400_000
    hashes, first = word_hashes([f"a {long} b", f"{long} b {long}y"])
    assert first.tolist() == [0, 3, 6] and hashes[1] == hashes[3] and hashes[2] == hashes[4] != hashes[5]


def test_shingle_sets_against_sets_of_tuples():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d e F f é 漢").split() or ["x"]) for _ in range(5)]
    texts = [" ".join(rng.choice(["a", "B", "b", "é", "\n", "漢 x"]) for _ in range(n)) for n in range(40)]
    texts += [None, "", " \n", "one two", "One TWO", "two one"]
    got = list(shingle_sets(texts))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(shingles(a) & shingles(b))


def test_chunks_cover_everything_once():
    texts = ["a" * n for n in (5, 0, 100, 3, 3)]
    assert [i for a, b in chunks(texts, 6) for i in range(a, b)] == list(range(5))
    assert list(chunks([])) == []
