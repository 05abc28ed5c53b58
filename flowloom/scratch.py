"""Durable intermediate tables.

Operators that need a fixed row order or a lineage cut write a parquet table
under the shared folder the cluster names in ``spark.checkpoint.dir``. The
table survives the loss of any executor and is read back column-pruned.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}
_written: list[str] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only for local sessions without the setting."""
    sc = spark.sparkContext
    root = sc.getConf().get(_CONF) or spark.conf.get(_CONF, None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder all executors can reach")
    app = sc.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="flowloom-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other call will be given."""
    path = f"{scratch_root(spark)}/flowloom-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame over the written files."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(staged: DataFrame) -> None:
    """Delete the table that ``stage`` returned as ``staged``; only what was written from it may still be read."""
    path = _path_of.pop(staged)
    if path in _written:
        _written.remove(path)
        _delete(staged.sparkSession, path)


def written() -> int:
    """The number of tables that this process has staged and not released."""
    return len(_written)


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Delete the tables this process staged, or those from number ``first`` to before ``last``; call it when no result still reads them."""
    paths = _written[first:last]
    del _written[first:last]
    return sum(_delete(spark, path) for path in paths)
