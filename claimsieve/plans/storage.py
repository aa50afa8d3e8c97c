"""Tables written to the shared folder, to cut lineage and to reuse costly results.

The folder is the one that the cluster names in ``spark.checkpoint.dir``. Where it is unset, as in tests on one machine,
a fresh folder below ``/tmp/checkpoints`` is used; on a cluster that is an error, since executors do not share ``/tmp``.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_ROOT = "/tmp/checkpoints"


class _Named(threading.local):
    """Paths that a thread of the driver has named, the oldest first, until they are deleted."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_NAMED = _Named()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{LOCAL_ROOT}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _NAMED.paths.append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the result survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``new_path`` named and that is no longer read."""
    if path in _NAMED.paths:
        _NAMED.paths.remove(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """Where this thread's list of paths stands, for ``delete_since``."""
    return len(_NAMED.paths)


def delete_since(spark: SparkSession, at: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove all tables that this thread named since a mark, but for some, once what was made of them is written."""
    for path in [p for p in _NAMED.paths[at:] if p not in keep]:
        delete_path(spark, path)
