"""Tables written on the way: they cut the lineage, and a lost executor costs no work done before them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the setting is missing (one machine, tests) a local folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='seqlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def claim(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted at the driver's end."""
    path = f"{shared_dir(spark)}/seqlake-{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_drop_all)
    _LEFT[path] = spark
    return path


@contextlib.contextmanager
def _freed(spark: SparkSession):
    """What is run meanwhile takes its shuffle files away as soon as it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back. The table stays until ``drop`` or the driver's end."""
    spark, path = df.sparkSession, claim(df.sparkSession, name)
    with _freed(spark):
        df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back._seqlake_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        _delete(getattr(df, "_seqlake_path", ""))


def _delete(path: str) -> None:
    spark = _LEFT.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    for path in list(_LEFT):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)
