"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables of this process, by path, and the session that wrote each.
_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a temporary one is taken on a local master, whose tasks see the driver's disk. On a
    cluster executors would write to their own disks and rows would vanish, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tephra-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back, for plans that use it several times.

    Unlike a cache it survives lost executors and leaves no storage behind in them. The table is deleted by :func:`discard`,
    or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(discard_all)
    _kept[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tephra_path = path
    return out


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside the block are deleted at its end, but for those behind frames that are given to ``keep``.

    For steps that write several tables and return a plan over the last of them. After an error all stay, for the driver's end.
    """
    before, kept = set(_kept), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_tephra_path", None))
        return df

    yield keep
    for path in [x for x in _kept if x not in before and x not in kept]:
        _delete(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`materialized`; nothing that reads it may run afterwards."""
    _delete(getattr(df, "_tephra_path", None))


def discard_all() -> None:
    """Delete all tables of this process that are left."""
    for path in list(_kept):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - a session that has stopped can't delete any more; its folder is the owner's
            return


def _delete(path: str | None) -> None:
    spark = _kept.pop(path, None)
    if spark is None:
        return
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
