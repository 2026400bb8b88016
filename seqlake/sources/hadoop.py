"""Windows on any file system that Spark reads: files come as bytes through Spark's own reader, and are parsed in its tasks."""

from __future__ import annotations

import io
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.sources.store import SUFFIX
from seqlake.sources.tapefile import RECORDS, parts_of, read_records

WIDE = pa.decimal128(20, 0)


def read_window(spark: SparkSession, root: str, *, symbol: str | None = None, date: str | None = None, hour: str | None = None) -> DataFrame:
    """The records below ``root`` (``s3a://``, ``hdfs://``, ``viewfs://``, a path), as ``format("tapelog")`` has them, both formats.

    Listing, credentials and reading are Hadoop's; a file is parsed where it is read. Only files of the given partitions are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SUFFIX}").load(root)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    path = F.when(F.col("path") == base, F.element_at(F.split("path", "/"), -1)).otherwise(F.expr(f"substring(path, {len(base) + 2})"))
    listed = files.select("path", path.alias("file")).withColumn("symbol", F.regexp_extract("file", "symbol=([^/]*)/", 1))
    order = Window.partitionBy("symbol").orderBy(F.col("file").cast("binary"))
    listed = listed.withColumn("file_idx", F.row_number().over(order) - 1)
    for name, value in (("symbol", symbol), ("date", date), ("hour", hour)):
        if value is not None:
            listed = listed.where(F.col("file").contains(f"{name}={value}/"))
    if not listed.limit(1).count():
        raise FileNotFoundError(f"{root} holds no {SUFFIX} file")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, index, content in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                rows = [(*parts_of(name), name, index, rec, *r.row()) for rec, r in enumerate(read_records(io.BytesIO(content)))]
                for lo in range(0, len(rows), 4096):
                    cols = list(zip(*rows[lo : lo + 4096], strict=True))
                    kinds = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), WIDE, WIDE, WIDE, pa.string()]
                    wide = lambda c: [None if v is None else Decimal(v) for v in c]
                    yield pa.RecordBatch.from_arrays([pa.array(wide(c) if k == WIDE else c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return files.select("path", "content").join(listed.drop("symbol"), "path").select("file", "file_idx", "content").mapInArrow(parse, RECORDS)
