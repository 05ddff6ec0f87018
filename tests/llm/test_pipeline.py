import random

import pytest

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def written(spark, tmp_path_factory):
    """Documents of three sources: toxic ones, near copies, a shared passage, and clean ones."""
    rng = random.Random(8)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    docs, labels, kind = [], [], {}
    for i in range(400):
        body = text(rng.randrange(60, 120)) + "\n" + text(100)
        kind[i] = "clean"
        if i % 4 == 1:
            words = body.split(" ")
            for k in range(5, len(words), 12):
                words[k] = rng.choice(["grumpfwort", "zwackelig"])
            body, kind[i] = " ".join(words), "toxic"
        elif i % 20 == 2:
            body, kind[i] = body + "\n" + passage, "passage"
        docs.append((i, body))
        labels.append((i, 1, int(kind[i] == "toxic")))
    for j, i in enumerate(range(0, 120, 12)):
        words = docs[i][1].split(" ")
        words[7] = "changed"
        docs.append((1000 + j, " ".join(words)))
        docs.append((2000 + j, docs[i][1]))
        kind[1000 + j] = kind[2000 + j] = "copy"
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t)) for i, t in docs]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(docs), kind, passage


def test_each_stage_on_planted_cases(spark, tmp_path_factory):
    folder, texts, kind, passage = written(spark, tmp_path_factory)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, folder)
        path = str(tmp_path_factory.mktemp("stage") / "out")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
        seen.append(docs)
    clean, dropped, single, mix, packed = seen
    left = {r.doc_id for r in clean.collect()}
    assert sum(kind[i] == "toxic" for i in left) <= 2
    assert left >= {i for i, k in kind.items() if k != "toxic"}
    lines = {r.doc_id: r.text for r in dropped.collect()}
    assert lines.keys() == left and sum(passage in t for t in lines.values()) == 1
    assert all(lines[i] == texts[i] for i in left if kind[i] in ("clean", "copy"))
    stay = [r.doc_id for r in single.collect()]
    assert len(stay) == len(set(stay)) and set(stay) == {i for i in left if kind[i] != "copy"}
    taken = [r.doc_id for r in mix.collect()]
    assert set(taken) <= set(stay) and len(taken) > len(set(taken)) > 0.5 * len(stay)
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == set(taken)
    assert sum(r.length for r in pieces if r.start == 0) > 0


def test_near_copies_go_by_document_also_without_or_with_repeated_ids(spark, corpus):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    near = lambda name: text(name) + " other end"
    rows = [(1, text("a")), (None, near("a")), (None, text("b")), (None, ""), (None, ""), (None, None)]
    rows += [(2, near("c")), (2, text("d")), (0, text("c"))]  # one id, two texts, one of them a copy
    rows += [(None, text("e"))] * 3 + [(None, near("f")), (None, text("f"))]
    rows += [(7, text("g"))] * 2
    out = corpus_pipeline.without_near_copies(spark, corpus(rows), "").collect()
    got = [(r.doc_id, r.text) for r in out]
    f = [x for x in got if x[1] in (text("f"), near("f"))]
    want = [rows[0], *rows[2:6], rows[7], rows[8], rows[9], *rows[-2:]]
    assert len(f) == 1 and sorted(map(str, got)) == sorted(map(str, want + f))


def test_run_is_the_stages_in_a_row(spark, tmp_path_factory):
    folder, *_ = written(spark, tmp_path_factory)
    out = entry.queries()["pipeline"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
    key = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert key(out) == key(docs)


def test_every_dealt_query_is_registered_once():
    names = list(entry.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(entry.oracle_sql()) <= set(names)
