"""What the operators share: tables, written cuts of the lineage, worker-side rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.sources.staging import cut, drop, shared_dir

__all__ = ["arrow_schema", "column", "crc32_mod", "cut", "drop", "forget", "kept", "map_batches", "map_rows", "shared_dir", "small_side", "spread", "table", "texts", "trim"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: long texts must not add up to what a worker can't hold. Rows up to which a table of a few numbers a
#: row is broadcast: some 20 MB.
BATCH_BYTES, SMALL = 4 << 20, 200_000


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; else it is joined by shuffling."""
    return F.broadcast(df) if df.count() <= SMALL else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly when a table comes in fewer splits than there are cores (one small file); otherwise leave it alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def crc32_mod(id_col: str, n: int) -> F.Column:
    """crc32 of the id written as decimal text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def map_rows(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict], schema: T.StructType | str, key: str = "") -> DataFrame:
    """``mapInArrow`` for a function from a batch to columns (name to list or array); ``key`` names what it keeps in workers."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = per_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, struct, key)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, key: str = "") -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes; a task gives back what other operators kept in its worker, and its own scratch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(key)
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(task, schema)


def arrow_schema(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Cache(dict):
    """What ``find`` returns for a key. Of ``most`` keys and more, those that were not asked for since the last ``most`` are let go.

    Keys longer than ``longest`` are not kept.
    """

    def __init__(self, find: Callable, most: int, longest: int):
        super().__init__()
        self.find, self.most, self.longest, self.older = find, most, longest, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once per Python worker for ``key``; only the latest key stays."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget(key: str = "") -> None:
    """Drop what the worker keeps for other keys."""
    if _KEPT and key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the machine: an idle worker would hold it beside the next operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
