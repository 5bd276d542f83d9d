"""Stage tables: what several queries build on is written once for each input and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, tuple[str, object]] = {}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one on a local master, else RuntimeError."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pitloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Paths (of folders: all files in them) with their sizes and times of change, as far as the file system tells."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        inside = system.listFiles(path, True)
        while inside.hasNext():
            status = inside.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def forget(spark: SparkSession, name: str) -> None:
    """The table of that name is built anew when it is next asked for."""
    for key in [k for k in _WRITTEN if k[:2] == (spark.sparkContext.applicationId, name)]:
        del _WRITTEN[key]


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted when it ends, not whenever the driver collects its garbage: nothing reads them again once a table is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table under this key, built and written as Parquet unless this application has done so.

    Cuts the lineage: plans on top stay small, and what follows is recomputed from files that outlive executors.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _WRITTEN:
        with without_leftovers(spark):
            df, path = build(), shared_folder(spark)
            df.write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path, df.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)
