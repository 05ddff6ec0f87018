"""Secret scans: candidates by pattern, judged by how widely the corpus owns them.

Every text gives base spans (assigned values, access keys, long hex runs) and generic
candidates, long strings that mix letters and digits. All are hashed and counted over the
whole corpus by distinct repositories and owners. A value that many owners have, or that
stands in many repositories of few owners, is an example that was copied; one that few owners
have in few repositories is specific to them and looks live. Generic candidates are added as
spans only if they look live; base spans always stay. Every span carries both counts.

Everything is made of Spark's functions. A span's place is the length of the text before
it: the pieces between matches (``split``) and the matches (``regexp_extract_all``) are
added up. Positions are code points, ends exclusive.

Defined cases: a null text is empty; a null repository or owner counts as one of its own;
repeated rows each get their result; spans of a kind do not overlap, spans of different
kinds may; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import prepare
from plumbline.session import stage

# The base patterns and the least length of what they must hold. ASCII
# letters in either case are spelled out, so that no other character can match.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
# The last two give the same spans as searching runs of any length and dropping the short
# ones: a run is matched whole, and what begins inside a short one is shorter.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A generic candidate: a run of this length with both letters and digits.
GENERIC = r"[A-Za-z0-9_-]{20,}"
#: A value with more owners, or in more repositories, than this is a copied example.
MOST_OWNERS, MOST_REPOS = 2, 6
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "generic")

SPAN = "struct<start:int,end:int,kind:string,value:string>"


def _places(text: Column, pattern: str, kind: str, keep, value_group: int = 0) -> Column:
    """Spans of the matches that ``keep`` allows. ``keep`` sees the value, a group of the match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    found = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))
    empty = F.array().cast(f"array<{SPAN}>")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
        F.when(
            x["m"].isNotNull() & keep(x["v"]),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("end"),
                        F.lit(kind).alias("kind"),
                        x["v"].alias("value"),
                    )
                ),
            ),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(found, start, step, lambda acc: acc["spans"])


def _spans(text: Column, pattern: str, kind: str, keep, value_group: int = 0) -> Column:
    """As ``_places``; most texts have no match and are searched once."""
    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), _places(text, pattern, kind, keep, value_group)).otherwise(empty)


def candidates(text: Column) -> Column:
    """All base spans and generic candidates of a text."""
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.concat(
        _spans(text, ASSIGN, "assign", lambda v: F.length(v) >= ASSIGN_LEAST, 2),
        _spans(text, ACCESS, "access", lambda v: F.lit(True)),
        _spans(text, HEX, "hex", lambda v: F.lit(True)),
        _spans(text, GENERIC, "generic", mixed),
    )


def _covered(span: Column) -> Column:
    """Whether a generic candidate meets a base span, which says the same and stays."""
    meets = lambda b: (b["kind"] != "generic") & (b["start"] < span["end"]) & (span["start"] < b["end"])
    return (span["kind"] == "generic") & F.exists("found", meets)


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each hash: ``found`` has h, repo, owner.

    Repeats of one hash in one repository end on the map side, so a value that a third of
    all rows hold reaches the second step as one row per repository and owner.
    """
    each = found.select("h", "repo", "owner").distinct()
    owners = each.groupBy("h", "owner").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("owners"))
    repos = each.groupBy("h", "repo").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("repos"))
    return owners.join(repos, "h")


def scan(
    docs: DataFrame,
    repo: Column,
    owner: Column,
    text: str = "text",
    key: str = "doc_id",
    most_owners: int = MOST_OWNERS,
    most_repos: int = MOST_REPOS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``base`` and ``spans`` (arrays of spans in order, each
    with the owners and repositories of its value), ``live`` and ``copied`` (how many distinct
    values look live or copied)."""
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(repo.cast("string"), F.lit("\0")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("\0")).alias("owner"),
        candidates(F.coalesce(F.col(text), F.lit(""))).alias("found"),
    )
    rows = rows.withColumn("found", F.filter("found", lambda s: ~_covered(s)))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "secret_rows")
    values = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.inline("found"))
    values = values.withColumn("h", F.sha2("value", 256))
    counts = ownership(values.select("h", "repo", "owner"))
    # A hot value is in many rows: they are joined by value and a part of the row number.
    parts = F.lit(16)
    spread = counts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    judged = (
        values.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
        .join(spread, ["h", "part"])
        .withColumn("live", (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos))
    )
    span = F.struct("start", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("nth"), "end", "kind", "owners", "repos")
    keep = (F.col("kind") != "generic") | F.col("live")
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(keep, span))).alias("spans"),
        F.count_distinct(F.when(F.col("live"), F.col("h"))).alias("live"),
        F.count_distinct(F.when(~F.col("live"), F.col("h"))).alias("copied"),
    )
    base = F.filter("spans", lambda s: s["kind"] != "generic")
    none = F.array().cast("array<struct<start:int,nth:bigint,end:int,kind:string,owners:bigint,repos:bigint>>")
    return (
        rows.select("row", "doc_id")
        .join(per_row, "row", "left")
        .select(
            "doc_id",
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("live", F.lit(0)).alias("live"),
            F.coalesce("copied", F.lit(0)).alias("copied"),
        )
        .withColumn("base", base)
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
