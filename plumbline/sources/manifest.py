"""SHA-256 manifest of source files (S3), and hash trees over their blocks.

A digest over a whole file is sequential. The tree is not: every block is read and hashed by
a task of its own, and digests are combined level by level in groups of bounded size. Equal
roots mean equal files; where roots differ, the blocks say where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20


#: Bytes of a block, digests that one node of the tree combines.
BLOCK, FANOUT = 8 << 20, 256


def _located(uri: str):
    """File system and path of a local path or any URI pyarrow knows."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def sha256_of(uri: str) -> str:
    digest = hashlib.sha256()
    system, path = _located(uri)
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _digest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(sha256=[sha256_of(uri) for uri in batch["file"]])


def _listed(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """File and length of every file under ``path`` that is not empty; Spark lists them without reading them."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.load(path).select(F.col("_metadata.file_path").alias("file"), "length")


def build_manifest(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """File, length and SHA-256 of every file under ``path``.

    Spark lists the files without reading their content. Each task streams its
    files in 1 MiB chunks, so memory does not depend on file size; a digest over
    one file is sequential by definition, and files spread over all tasks.
    """
    width = spark.sparkContext.defaultParallelism * 4
    spread = _listed(spark, path, pattern).repartition(width, "file")
    return spread.mapInPandas(_digest_batches, "file string, length long, sha256 string")


def _hash_blocks(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for uri, part in zip(batch["file"], batch["part"]):
                digest, (system, path) = hashlib.sha256(), _located(uri)
                with system.open_input_file(path) as data:
                    data.seek(int(part) * size)
                    left = size
                    while left and (chunk := data.read(min(CHUNK, left))):
                        digest.update(chunk)
                        left -= len(chunk)
                digests.append(digest.hexdigest())
            yield batch.assign(sha256=digests)

    return run


def block_digests(spark: SparkSession, path: str | list[str], pattern: str = "*", size: int = BLOCK) -> DataFrame:
    """file, part (number of the block, from 0) and SHA-256 of every block of ``size`` bytes.

    Blocks of one large file spread over all tasks. Spark lists no empty files: a file that
    was emptied counts as missing.
    """
    last = (F.ceil(F.col("length") / size) - 1).cast("long")
    blocks = _listed(spark, path, pattern).select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    spread = blocks.repartition(spark.sparkContext.defaultParallelism * 4, "file", "part")
    return spread.mapInPandas(_hash_blocks(size), "file string, part long, sha256 string")


def merkle_roots(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file and SHA-256 of its tree's root; the root of a file of one block is that block's digest.

    A node is the digest of its children's digests (hexadecimal, in order, joined). There are
    as many rounds as the largest file has levels, and no group exceeds ``fanout`` rows.
    """
    most = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while most > 1:
        size = F.col("part_count")
        counted = blocks.groupBy("file").agg(F.count("*").alias("part_count"))
        children = F.array_sort(F.collect_list(F.struct("part", "sha256")))
        joined = F.sha2(F.array_join(F.transform(children, lambda c: c["sha256"]), ""), 256)
        nodes = blocks.join(counted, "file").groupBy("file", "part_count", F.floor(F.col("part") / fanout).alias("part")).agg(
            F.when(F.first(size) > 1, joined).otherwise(F.first("sha256")).alias("sha256")
        )
        blocks = nodes.drop("part_count")
        most = -(-most // fanout)
    return blocks.select("file", "sha256")
