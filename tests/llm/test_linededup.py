import numpy as np
import pytest

from plumbline.llm import linededup as ld


def own(i, n=12):
    return " ".join(f"own{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + k)}" for k in range(n))


PASSAGE = " ".join("pass" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(55))


def run(docs, **kw):
    return {r.doc_id: r for r in ld.dedup_lines(docs, dropped="gone", **kw).collect()}


def test_recurring_lines_stay_in_the_first_document_only(corpus):
    rows = [(i, f"{own(i, 90)}\nVisit page {i * 17} of our site today\n{own(i + 200, 60)}\n{PASSAGE}\n\nend") for i in range(9)]
    rows += [(50 + i, f"{own(i + 400, 40)}\nrare line number one here") for i in range(4)]
    got = run(corpus(rows))
    assert got[0].text == rows[0][1] and got[0].gone == 0
    for i, t in rows[1:9]:
        lines = t.split("\n")
        assert got[i].text == "\n".join([lines[0], lines[2], "", "end"]) and got[i].gone == 2
        assert got[i].n_chars == len(got[i].text)
    for i, t in rows[9:]:  # four documents are fewer than MIN_DOCS
        assert got[i].text == t and got[i].gone == 0


def test_copies_as_a_whole_are_left_to_document_dedup(corpus):
    text = "\n".join(own(k, 20) for k in range(6))
    rows = [(i, text + f"\n{own(300 + i)}") for i in range(8)]
    got = run(corpus(rows))
    assert all(got[i].text == t for i, t in rows)


def test_leaves_that_are_too_large_are_parsed_deeper(corpus, monkeypatch):
    monkeypatch.setattr(ld, "LEAF_LINES", 3)
    rows = [(i, f"{own(i, 80)}\na b c d e f g {own(i, 3)}\nsame lead words and then always this") for i in range(12)]
    got = run(corpus(rows))
    assert all(r.text.count("always this") == (i == 0) for i, r in got.items())


def test_templates_of_a_leaf():
    rows = np.array([[1, 2, 3, 4], [1, 2, 3, 5], [9, 9, 9, 9], [1, 2, 3, 4], [1, 2, 7, 5]], dtype=np.uint32)
    assert ld.leaf_templates(rows, 0.7).tolist() == [0, 0, 2, 0, 4]


def test_nulls_repeats_and_no_rows(corpus):
    docs = corpus([])
    assert ld.dedup_lines(docs).columns == docs.columns and ld.dedup_lines(docs).count() == 0
    line = "a line that everyone has got"
    rows = [(i, f"{own(i, 40)}\n{line}") for i in range(1, 8)]
    rows += [(3, f"{own(3, 40)}\n{line}"), (None, f"{own(90, 40)}\n{line}"), (70, None), (71, "")]
    out = ld.dedup_lines(corpus(rows)).collect()
    assert len(out) == len(rows)
    has = sorted((r.doc_id or 0) for r in out if r.text and line in r.text)
    assert has == [1] and [r.text for r in out if r.doc_id == 70] == [None]
    # Fewer documents than rows: repeated rows are one.
    again = [(1, f"{own(1, 40)}\n{line}")] * 6
    assert all(line in r.text for r in ld.dedup_lines(corpus(again)).collect())


@pytest.mark.parametrize("text", ["a\n\nb", "", "\n", "x"])
def test_lines_go_by_number(spark, text):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text, [1])], "t string, d array<int>")
    want = "\n".join(x for k, x in enumerate(text.split("\n")) if k != 1)
    assert df.select(ld.without_lines(F.col("t"), F.col("d"))).first()[0] == want


def test_documents_that_are_no_copies_lose_their_recurring_lines_however_large_the_part(corpus):
    passage = " ".join("long" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60))
    short = "\n".join(f"{x} one two three four" for x in ("header", "menu", "footer"))
    rows = [(i, f"{own(i, 40)}\n{passage}") for i in range(8)]
    rows += [(20 + i, f"{own(100 + i, 35)}\n{short}") for i in range(8)]
    rows += [(40 + i, f"{PASSAGE}\nas ever\n{own(200 + i, 3)}") for i in range(6)]  # near copies
    got = run(corpus(rows))
    assert got[0].text == rows[0][1] and got[20].text == rows[8][1]
    assert all(got[i].text == own(i, 40) for i in range(1, 8))
    assert all(got[20 + i].text == own(100 + i, 35) for i in range(1, 8))
    assert all(got[i].text == t for i, t in rows[16:])


def test_large_leaves_find_the_templates_that_small_ones_find(corpus, monkeypatch):
    monkeypatch.setattr(ld, "LEAF_LINES", 3)
    rows = [(i, f"{own(i, 80)}\nplease do welcome guest {own(i, 1)} to the evening show tonight") for i in range(14)]
    assert all(("evening" in r.text) == (i == 0) for i, r in run(corpus(rows)).items())


def test_long_lines_with_a_few_free_words_share_a_template(corpus):
    words, rows = PASSAGE.split(), []
    for i in range(8):
        line = list(words)
        for k in range(8):  # 47 of 55 words are equal
            line[5 + 6 * k] = own(i, 9).split()[k]
        rows.append((i, f"{own(i, 90)}\n{' '.join(line)}"))
    got = run(corpus(rows))
    assert got[0].text == rows[0][1] and all(got[i].text == own(i, 90) for i in range(1, 8))
