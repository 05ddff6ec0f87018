import random
import zlib

import numpy as np
import pytest

from plumbline.llm import packing

public = pytest.importorskip("public_tokenizers")


def tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(got, texts):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids, at = tokens(texts[i]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    odd = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        odd += at & (at - 1) != 0
    return odd


@pytest.mark.parametrize("portion", [500, 2_000_000])
def test_round_trip(corpus, monkeypatch, portion):
    monkeypatch.setattr(packing, "PORTION", portion)
    monkeypatch.setattr(packing, "MEMO", 50)
    rng = random.Random(4)
    words = ["Hello", "hello", "it's", "l'été", "12:30", "ﬁn", "é", "漢字", "\tx　y", "a\r\nb", "<|endoftext|>", "…"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80, 700, 3000]))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "x" * 5000, 103: "é ́e", 104: " "}
    docs = corpus(list(texts.items())).coalesce(2)
    got = packing.pack(docs, public.path("word_bpe_49k.json")).collect()
    assert check(got, texts) <= 2  # one sequence per partition may be padded


def test_new_words_are_encoded_many_to_a_text(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 300)
    monkeypatch.setattr(packing, "WORDS", 100)
    coder, rng, seen = packing.Encoder(public.path("word_bpe_49k.json")), random.Random(5), []
    plain = coder.encode
    monkeypatch.setattr(coder, "encode", lambda texts: seen.append(len(texts)) or plain(texts))
    odd = ["\x01", "a\x01b", "́x", "'s", "\t|", "…", "<|endoftext|>", "\x02\x01"]
    for call in range(6):
        words = ["".join(rng.choice("abcé1.'") for _ in range(rng.randint(1, 9))) for _ in range(400)]
        texts = [" ".join(words[i : i + 50]) for i in range(0, 400, 50)] + ["", " \n "]
        texts += [" ".join(odd)] if call % 2 else []
        got = coder(texts)
        assert got == [plain([t])[0].tobytes() for t in texts]
        assert len(coder.keys) <= 300 + 400 + len(odd)
        if not call:
            assert sum(seen) <= 8


def test_step_groups_are_even(corpus):
    texts = {i: "word " * (i * 13 % 900) for i in range(200)}
    docs = corpus(list(texts.items())).coalesce(1)
    got = packing.pack(docs, public.path("word_bpe_49k.json"), step_tokens=8192).collect()
    loads = {}
    for r in got:
        loads[r.step_group] = loads.get(r.step_group, 0) + r.length
    assert max(loads.values()) - min(loads.values()) <= 2048


def test_repeats_and_no_rows(corpus):
    assert packing.pack(corpus([]), public.path("word_bpe_49k.json")).count() == 0
    got = packing.pack(corpus([(1, "a"), (1, "a"), (None, "b")]), public.path("word_bpe_49k.json")).collect()
    assert sorted(r.length for r in got) == [2, 2, 2]
