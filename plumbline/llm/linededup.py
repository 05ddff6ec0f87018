"""Line dedup: lines are parsed into templates by a log-template tree; recurring ones are dropped.

A line's tokens are its lower-cased words; tokens with a digit are variable fields. The
tree has a fixed depth: number of tokens, then the leading tokens. In a leaf, lines that
agree in at least ``SIMILAR`` of their fields share a template, in which the fields that
differ have become variable, too; a field is a token, whatever the line's length. A template
that occurs in at least ``MIN_DOCS`` documents recurs: its lines are dropped from all
documents but the one with the smallest doc_id.

A document of which recurring templates make up a large part, and which the n-gram join
links with another one that has such a part, is a copy as a whole. It is left as it is:
whether to keep it is a question for document dedup, which would not recognise its remains.
Without such a link it loses its recurring lines, however large their part is.

Lines that recur are pre-aggregated to distinct lines before they meet in a leaf, and only
these bring their tokens, in a second reading of the texts that a bitmap of the leaves in
which enough lines meet restricts. The leaf is the same at every size. One with too many
distinct lines is dealt to blocks; the templates found in a block then meet those of every
other block, as lines with variable fields, in pairs of blocks of bounded size, and those
that agree are one template. So no task gets an unbounded leaf and no two lines are kept
apart by a leaf's size. The pairs of blocks grow with the square of a leaf's templates, not
of its lines.

Defined cases: a null text stays null; lines of fewer than ``MIN_WORDS`` words always
stay; repeated rows are one document and are treated alike; rows with a null doc_id are
one document, the last; an empty table gives an empty result; columns beside text (and
n_chars, which follows it) are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import ngramjoin
from plumbline.llm.common import prepare, tidy, tidy_group
from plumbline.llm.components import components
from plumbline.llm.words import SPACE, Words, chunks, mix
from plumbline.session import stage

#: Leading tokens of a leaf's path.
DEPTH = 3
#: Distinct lines of a block of a leaf, about; share of tokens in which lines of a template agree.
LEAF_LINES, SIMILAR = 4096, 0.7
#: Documents in which a template recurs, words of a line that may be dropped.
MIN_DOCS, MIN_WORDS = 5, 3
#: A document may be a copy as a whole if recurring lines hold this share of its words, or,
#: with MANY of them, the smaller share; it is one if the n-gram join links it, too.
WHOLE, PART, MANY = 0.5, 0.25, 3
#: Bytes of distinct lines that one task clusters, about.
TASK_BYTES = 16_000_000
#: Bits of a filter; rows that pass it by chance only make work.
FILTER = 1 << 22

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = mix(np.arange(1, DEPTH + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
#: Hash of a token with a digit; field of a template that varies.
_VARIABLE, _FIELD = np.uint64(0x5851F42D4C957F2D), np.uint32(0)


def _parsed(lines: list[str]) -> tuple[np.ndarray, ...]:
    """Words per line, fields of all lines, where each line's begin, and per line its path
    and its digest."""
    w = Words(lines, SPACE)
    data = np.frombuffer(w.bytes, dtype=np.uint8)
    digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39), dtype=np.int64)])
    tokens = mix(w.hashes | np.uint64(1))
    tokens[digits[w.ends] > digits[w.starts]] = _VARIABLE
    first, counts = w.first[:-1], np.diff(w.first)
    path = counts.astype(np.uint64) * _STEP
    for k in range(DEPTH):
        some = counts > k
        path[some] += tokens[first[some] + k] * _SHIFT[k]
    place = np.arange(len(tokens)) - np.repeat(first, counts)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * mix(place.astype(np.uint64) + _STEP))])
    digest = mix(total[w.first[1:]] - total[first] + counts.astype(np.uint64))
    return counts, np.maximum((tokens >> np.uint64(32)).astype(np.uint32), 1), w.first, mix(path), digest


_LINES = "doc_id long, mark long, line int, words int, of int, path long, digest long"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text that are long enough; ``of`` is the number of words of the text."""
    for b in batches:
        keys, marks, texts = (c.to_pylist() for c in b.columns)
        texts = [t or "" for t in texts]
        for begin, end in chunks(texts):
            split = [t.split("\n") for t in texts[begin:end]]
            sizes = np.array([len(s) for s in split])
            counts, _, _, path, digest = _parsed([x for s in split for x in s])
            doc = np.repeat(np.arange(begin, end), sizes)
            line = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            of = np.bincount(doc - begin, weights=counts, minlength=end - begin).astype(np.int32)
            at = np.flatnonzero(counts >= MIN_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in doc[at].tolist()], pa.int64()),
                    pa.array([marks[i] for i in doc[at].tolist()], pa.int64()),
                    pa.array(line[at].astype(np.int32)),
                    pa.array(counts[at].astype(np.int32)),
                    pa.array(of[doc[at] - begin]),
                    *(pa.array(x[at].view(np.int64)) for x in (path, digest)),
                ],
                [c.split()[0] for c in _LINES.split(", ")],
            )


_FIELDS = "path long, digest long, n long, fields binary"


def _fields(bits: np.ndarray):
    """Distinct lines of a portion, with their fields, whose paths pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for begin, end in chunks(texts):
                counts, fields, first, path, digest = _parsed([x for t in texts[begin:end] for x in t.split("\n")])
                path = path.view(np.int64)
                at = np.flatnonzero((counts >= MIN_WORDS) & _passes(bits, path))
                digest, one, n = np.unique(digest[at], return_index=True, return_counts=True)
                at = at[one]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(path[at]),
                        pa.array(digest.view(np.int64)),
                        pa.array(n.astype(np.int64)),
                        pa.array([fields[first[i] : first[i + 1]].tobytes() for i in at.tolist()], pa.binary()),
                    ],
                    [c.split()[0] for c in _FIELDS.split(", ")],
                )

    return run


def _templates(lines: np.ndarray, similar: float) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Row of ``lines`` that founded each row's template, and the template of each such row."""
    founders: list[int] = []
    templates = np.empty_like(lines)
    out = np.empty(len(lines), dtype=np.int64)
    for i, line in enumerate(lines):
        n = len(founders)
        if n:
            share = ((templates[:n] == line) & (line != _FIELD)).mean(axis=1)
            best = int(share.argmax())
            if share[best] >= similar:
                templates[best][templates[best] != line] = _FIELD
                out[i] = founders[best]
                continue
        templates[n] = line
        founders.append(i)
        out[i] = i
    return out, dict(zip(founders, templates))


def leaf_templates(lines: np.ndarray, similar: float) -> np.ndarray:
    """Row of ``lines`` (fields of the lines of one leaf, most frequent first) that founded each row's template."""
    return _templates(lines, similar)[0]


_TEMPLATES = "path long, digest long, template long, n long, fields binary"


def _cluster(similar: float):
    """Each line's template; a founder, and a line of a size of its own, has the template's fields."""

    def run(group: pa.Table) -> pa.Table:
        path, block, digest, n = (group.column(c).to_numpy() for c in ("path", "block", "digest", "n"))
        fields = group.column("fields").to_pylist()
        sizes = np.array([len(f) for f in fields], dtype=np.int64)
        template, own = digest.copy(), [None] * len(fields)
        order = np.lexsort((digest, -n, sizes, block, path))
        keys = np.stack([x[order] for x in (path, block, sizes)])
        begins = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for at in np.split(order, begins) if len(order) else ():
            rows = np.frombuffer(b"".join(fields[i] for i in at), dtype=np.uint32).reshape(len(at), -1)
            founder, found = _templates(rows, similar)
            template[at] = digest[at][founder]
            for i, pattern in found.items():
                own[at[i]] = pattern.tobytes()
        columns = {"path": path, "digest": digest, "template": template, "n": n}
        return pa.table({**columns, "fields": pa.array(own, pa.binary())})

    return run


def _blocks() -> Column:
    """Number of blocks of a leaf of ``lines`` lines of ``words`` words."""
    most = F.least(F.lit(LEAF_LINES), F.greatest(F.lit(1), F.floor(TASK_BYTES / (4 * F.col("words")))))
    return F.ceil(F.col("lines") / most).cast("int")


def _clustered(lines: DataFrame, similar: float) -> DataFrame:
    """``_cluster`` over tasks of bounded size; a unit of it is one ``block`` of one ``path``."""
    size = lines.agg(F.sum(F.octet_length("fields"))).first()[0] or 0
    parts = max(1, -(-size // TASK_BYTES))
    task = F.pmod(F.xxhash64("path", "block"), F.lit(parts))
    return lines.withColumn("task", task).groupBy("task").applyInArrow(tidy_group(_cluster(similar)), _TEMPLATES)


def line_templates(rows: DataFrame, leaves: DataFrame, similar: float) -> DataFrame:
    """digest and template (the digest of one of its lines) of each distinct line of ``leaves``."""
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    tokens = rows.select("text").mapInArrow(tidy(_fields(_filter(leaves, "path"))), _FIELDS)
    tokens = tokens.groupBy("path", "digest").agg(F.first("fields").alias("fields"), F.sum("n").alias("n"))
    sample = tokens.join(leaves.hint("merge"), "path").withColumn("blocks", _blocks())
    sample = stage(sample.select("path", own.cast("string").alias("block"), "digest", "n", "fields", "blocks"), "leaf_samples")
    found = stage(_clustered(sample.drop("blocks"), similar), "templates")
    large = stage(sample.where("blocks > 1").select("path").distinct(), "large_leaves")
    if large.isEmpty():
        return found.select("digest", "template")
    # Templates of the blocks of a leaf meet in pairs of blocks; those that agree are tied.
    again = stage(found.where("fields is not null").join(large.hint("merge"), "path"), "block_templates")
    counts = again.groupBy("path").agg(F.count("*").alias("lines"), F.max(F.octet_length("fields") / 4).alias("words"))
    again = again.drop("template").join(counts.hint("merge"), "path").withColumn("blocks", _blocks())
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = again.select("*", own.alias("own")).select("*", other)
    block = F.concat_ws(":", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    pairs = stage(pairs.select("path", block.alias("block"), "digest", "n", "fields"), "block_pairs")
    ties = components(_clustered(pairs, similar).select(F.col("digest").alias("a"), F.col("template").alias("b")))
    named = found.select("digest", "template").join(ties.hint("merge"), F.col("template") == F.col("node"), "left")
    return named.select("digest", F.coalesce("component", "template").alias("template"))


def _filter(values: DataFrame, column: str) -> np.ndarray:
    """Which numbers modulo ``FILTER`` occur in a column of hashes; its size does not depend on theirs."""
    words = values.selectExpr(
        f"shiftright(pmod(`{column}`, {FILTER}L), 6) AS at", f"shiftleft(1L, cast(pmod(`{column}`, 64L) AS int)) AS bit"
    )
    bits = np.zeros(FILTER // 64, dtype=np.int64)
    for at, word in words.groupBy("at").agg(F.bit_or("bit")).collect():
        bits[at] = word
    return bits


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (FILTER - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _with_marks(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_passes(bits, b.column(0).to_numpy())))

    return run


def _copies(rows: DataFrame, per_row: DataFrame) -> DataFrame:
    """The marks of ``per_row`` whose texts are near copies of others of it."""
    marks = stage(per_row.groupBy("mark").agg(F.count("*").alias("docs")), "copy_marks")
    if marks.isEmpty():
        return marks.select("mark")
    near = rows.select("mark", "text").mapInArrow(tidy(_with_marks(_filter(marks, "mark"))), "mark long, text string")
    near = stage(near.dropDuplicates(["mark"]).join(marks.hint("merge"), "mark"), "copy_texts")
    named = ngramjoin.similar(near, key="mark").select(F.col("doc_id").alias("mark"), "component_id")
    named = stage(named.join(marks.hint("merge"), "mark"), "copy_names")
    groups = named.groupBy("component_id").agg(F.sum("docs").alias("members")).where("members > 1")
    return named.join(groups.hint("merge"), "component_id").select("mark")


def recurring_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    similar: float = SIMILAR,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Rows that lose lines: doc_id, mark (a hash of the text), ``drop`` (numbers of the lines)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    lines = stage(rows.mapInArrow(tidy(_lines), _LINES), "lines")
    # Leaves in which enough lines meet, and their numbers of distinct lines.
    distinct = lines.groupBy("path", "digest").agg(F.count("*").alias("n"), F.max("words").alias("words"))
    leaves = distinct.groupBy("path").agg(
        F.count("*").alias("lines"), F.max("words").alias("words"), F.sum("n").alias("n")
    )
    leaves = stage(leaves.where(F.col("n") >= min_docs).drop("n"), "leaves")
    # Merge joins at every size: the adaptive skew join splits hot paths, templates and lines.
    some = stage(lines.join(leaves.select("path").hint("merge"), "path").drop("path"), "leaf_lines")
    named = some.join(stage(line_templates(rows, leaves, similar), "line_templates").hint("merge"), "digest")
    named = stage(named.dropDuplicates(["doc_id", "mark", "line"]), "named_lines")
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    per_doc = named.groupBy("template", "doc_id").agg(F.lit(1).alias("one"))
    again = (
        per_doc.groupBy("template")
        .agg(F.count("*").alias("docs"), F.min(order).alias("first"))
        .where(F.col("docs") >= min_docs)
        .select("template", "first")
    )
    found = named.join(stage(again, "recurring").hint("merge"), "template")
    per_row = found.groupBy("doc_id", "mark").agg(
        F.sum("words").alias("words"),
        F.max("of").alias("of"),
        F.count_distinct("template").alias("templates"),
        F.collect_list(F.when(order != F.col("first"), F.col("line"))).alias("drop"),
    )
    share = F.col("words") / F.col("of")
    whole = (share >= WHOLE) | ((F.col("templates") >= MANY) & (share >= PART))
    per_row = stage(per_row.withColumn("share", share).withColumn("whole", whole), "recurring_rows")
    # A partner that has the recurring lines, too, has at least this share.
    partners = per_row.where(F.col("share") >= PART * ngramjoin.PERCENT / 100)
    copies = stage(_copies(rows, partners), "copies").withColumn("copy", F.lit(True))
    per_row = per_row.where(F.size("drop") > 0).join(copies.hint("merge"), "mark", "left")
    return per_row.where(~F.col("whole") | F.col("copy").isNull()).select("doc_id", "mark", "drop")


def without_lines(text: Column, drop: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(drop, i))
    return F.when(drop.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR, dropped: str | None = None
) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``; ``dropped`` names a column for their number."""
    prepare(docs.sparkSession)
    drops = stage(recurring_lines(docs, min_docs, similar), "drops").alias("r")
    d = docs.alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.mark"))
    text = without_lines(F.col("d.text"), F.col("r.drop"))
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        size = F.when(F.col("r.drop").isNull(), F.col("d.n_chars")).otherwise(F.char_length(text))
        changed["n_chars"] = size.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    out = [changed.get(c, F.col(f"d.`{c}`")) for c in docs.columns]
    if dropped:
        out.append(F.coalesce(F.size("r.drop"), F.lit(0)).alias(dropped))
    return d.join(drops.hint("merge"), same, "left").select(*out)
