"""Flow CSV files as typed records with their file and dataset."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def decoded(path: str | Column) -> Column:
    """File paths are percent-encoded; a literal plus sign is not."""
    return F.url_decode(F.replace(F.col(path) if isinstance(path, str) else path, F.lit("+"), F.lit("%2B")))


def _layouts(spark: SparkSession, path: str | list[str], deep: bool) -> list[tuple[list[str], list[str]]]:
    """Column names and files of every header that occurs.

    Reads the first split of each file and keeps its first line; what is collected
    is one row per header with its files, which the driver lists anyway.
    """
    lines = spark.read.option("recursiveFileLookup", deep).text(path).select(
        decoded(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.struct(F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")).alias("first"),
    )
    heads = lines.where("start = 0").groupBy("file").agg(F.min("first").alias("first"))
    found = heads.groupBy(F.col("first.line").alias("head")).agg(F.collect_list("file").alias("files")).collect()
    return [(next(csv.reader([r["head"].removeprefix("﻿")]), []), r["files"]) for r in found]


def read_flows(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    mapping: dict[str, str] | None = None,
    header: bool = True,
    escape: str = '"',
    deep: bool = False,
) -> DataFrame:
    """CSV with a declared schema; no inference pass.

    Columns are bound by the names in each file's header, whatever their order;
    others are ignored, and a file that lacks a declared column is an error.
    ``mapping`` renames file columns. Lines that do not fit the schema keep their
    text in ``_corrupt_record`` and their good cells, and so do repeated header
    lines. A quote inside a quoted cell is doubled unless ``escape`` says otherwise.
    ``file`` is the source path.
    """
    declared = {f.name: f for f in schema.fields}
    corrupt = T.StructField(CORRUPT, T.StringType())
    names = mapping or {}

    def read(fields: list[T.StructField], files: str | list[str]) -> DataFrame:
        df = (
            spark.read.schema(T.StructType([*fields, corrupt]))
            .options(
                header=header,
                mode="PERMISSIVE",
                columnNameOfCorruptRecord=CORRUPT,
                enforceSchema=True,
                escape=escape,
                recursiveFileLookup=deep,
            )
            .csv(files)
        )
        bad = F.col(CORRUPT)
        texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
        if header and len(texts) == len(fields):  # nothing in a repeated header line is of a wrong type
            same = reduce(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.lit(n)) for n in texts])
            bad = F.when(same, F.lit(",".join(texts))).otherwise(bad)
        return df.select(
            F.col("_metadata.file_path").alias("file"),
            *[F.col(f"`{n}`").alias(names.get(n, n)) for n in declared],
            bad.alias(CORRUPT),
        )

    if not header:
        return read(schema.fields, path)
    parts = []
    for head, files in _layouts(spark, path, deep):
        lacking = sorted(declared.keys() - set(head))
        if lacking:
            raise ValueError(f"{files[0]} has no column {', '.join(lacking)}")
        fields, seen = [], set()
        for j, name in enumerate(head):
            known = name in declared and name not in seen
            seen.add(name)
            fields.append(declared[name] if known else T.StructField(f"_other_{j}", T.StringType()))
        plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]
        parts.append(read(fields, plain))
    return reduce(DataFrame.unionByName, parts) if parts else read(schema.fields, path)


def read_datasets(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    mapping: dict[str, str] | None = None,
    header: bool = True,
) -> DataFrame:
    """All files under ``root/<dataset>/``, however deep, tagged with that directory's name."""
    df = read_flows(spark, root, schema, mapping, header, deep=True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath()
    depth = len([p for p in full.split("/") if p])
    inside = F.regexp_replace("file", "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    folder = F.split_part(inside, F.lit("/"), F.lit(depth + 2))
    return df.withColumn("dataset", decoded(folder))
