"""A table kept equal to a folder of files: new files are added, changed ones replace their own rows, removed ones go.

The manifest remembers length, modification time and, if wanted, the digest of every file whose rows are in the table. Only files
that differ from it are read. The table is partitioned by file, and dynamic overwriting replaces just the partitions
written. The manifest is written after the rows, so a run that broke off is done again with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

FILE = "SourceFile"
_MANIFEST = "file string, length long, modified timestamp, digest string"


@dataclass(frozen=True)
class Refreshed:
    """Names of the files that were read, found unchanged by digest, and removed."""

    read: list[str]
    touched: list[str]
    removed: list[str]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _drop_partition(spark: SparkSession, table: str, file: str) -> None:
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(file)
    place = jvm.org.apache.hadoop.fs.Path(f"{table}/{FILE}={name}")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _only(path: str) -> str:
    """The pattern that matches the file of this path alone."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def folder_state(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, file, length, modified)`` of the files in ``folder``, from its listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.col("modificationTime").alias("modified"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last manifest, or an empty one."""
    found = spark.read.schema(_MANIFEST).json(f"{path}/manifest") if _exists(spark, f"{path}/manifest") else spark.createDataFrame([], _MANIFEST)
    return found


def refresh(
    spark: SparkSession,
    folder: str,
    path: str,
    read: Callable[[SparkSession, list[str]], DataFrame],
    change: Callable[[DataFrame], DataFrame] = lambda df: df,
    pattern: str = "*",
    digest: bool = False,
) -> Refreshed:
    """Bring the table at ``path`` up to date with ``folder``.

    ``read`` reads the given paths; ``change`` must keep the column ``SourceFile`` and not mix rows of different files. With ``digest``, files whose
    listing changed but whose content did not are not read again (their bytes are, for the digest). The names of changed
    files reach the driver, as those of any scan do.
    """
    now, before = folder_state(spark, folder, pattern), read_manifest(spark, path).cache()
    same = ["file", "length", "modified"]
    differ = now.join(before, same, "left_anti")
    if digest:
        content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        digests = content.select("path", F.sha2("content", 256).alias("digest")).join(differ.select("path"), "path", "left_semi")
        differ = differ.join(digests, "path")
    else:
        differ = differ.withColumn("digest", F.lit(None).cast("string"))
    differ = differ.join(before.select("file", F.col("digest").alias("known")), "file", "left").orderBy("file").collect()
    touched = [r["file"] for r in differ if r["digest"] is not None and r["digest"] == r["known"]]
    wanted = [r for r in differ if r["file"] not in set(touched)]
    removed = [r["file"] for r in before.join(now, "file", "left_anti").orderBy("file").collect()]
    if wanted:
        literal = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # metadata is encoded
        rows = change(read(spark, [_only(r["path"]) for r in wanted]).withColumn(FILE, literal))
        for r in wanted:  # a changed file may have no rows left, and overwriting leaves partitions without rows alone
            _drop_partition(spark, f"{path}/rows", r["file"])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FILE).parquet(f"{path}/rows")
    for file in removed:
        _drop_partition(spark, f"{path}/rows", file)
    new = spark.createDataFrame([(r["file"], r["length"], r["modified"], r["digest"]) for r in differ], _MANIFEST)
    gone = spark.createDataFrame([(f,) for f in removed], "file string")
    kept = before.join(new, "file", "left_anti").join(gone, "file", "left_anti").unionByName(new)
    following = f"{path}/manifest-next"
    kept.coalesce(1).write.mode("overwrite").json(following)
    jvm = spark.sparkContext._jvm
    old, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}/manifest", following))
    fs = fresh.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(fresh, old)
    before.unpersist()
    return Refreshed([r["file"] for r in wanted], touched, removed)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, with their file in ``SourceFile``."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
