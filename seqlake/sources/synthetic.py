"""Feeds that are made up: scripted numbers as a table and as a stream, and a recorded feed with a cut in it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "arrival long, kind string, seq long, recv_ns long, raw string, reason string"
FRAME = '{{"type":"match","product_id":"{product}","sequence":{seq},"time":"2033-05-18T03:33:20.{part:06d}Z","side":"{side}","price":"{price}.25","size":"0.5"}}'


def frames(spark: SparkSession, *, count: int, start: int = 1, step: int = 1, skip_after: Mapping[int, int] | None = None, sever_after: Sequence[int] = (), product: str = "SYN", begin_ns: int = 2_000_000_000 * 10**9, pace_ns: int = 1_000_000) -> DataFrame:
    """``arrival, kind, seq, recv_ns, raw, reason``: ``count`` frames whose numbers go up by ``step`` from ``start``.

    After frame i ``skip_after[i]`` more numbers are lost; a reseed comes first, and after each frame of ``sever_after``.
    """
    skipped = F.lit(0).cast("long")
    for i, n in (skip_after or {}).items():
        skipped = skipped + F.when(F.col("id") > i, n).otherwise(0)
    severed = F.lit(0).cast("long")
    for i in sever_after:
        severed = severed + F.when(F.col("id") > i, 1).otherwise(0)
    at = F.col("id")
    data = spark.range(count).select((at + 1 + severed).alias("arrival"), F.lit("data").alias("kind"), (F.lit(start) + at * step + skipped).cast("long").alias("seq"), (F.lit(begin_ns) + at * pace_ns).alias("recv_ns"), at)
    part = F.lpad((at % 1_000_000).cast("string"), 6, "0")
    raw = F.concat(F.lit(f'{{"type":"match","product_id":"{product}","sequence":'), F.col("seq").cast("string"), F.lit(',"time":"2033-05-18T03:33:20.'), part, F.lit('Z","side":"'), F.when(at % 2 == 0, "buy").otherwise("sell"), F.lit('","price":"'), (at + 100).cast("string"), F.lit('.25","size":"0.5"}'))
    data = data.select("arrival", "kind", "seq", "recv_ns", raw.alias("raw"), F.lit(None).cast("string").alias("reason"))
    breaks = [(0, begin_ns, "subscribed"), *[(i + 2 + k, begin_ns + i * pace_ns, "connected again") for k, i in enumerate(sorted(sever_after))]]
    rows = spark.createDataFrame([(a, "reseed", None, t, None, why) for a, t, why in breaks], SCHEMA)
    return data.unionByName(rows)


def severed(records: DataFrame, first: int, last: int) -> DataFrame:
    """Recorded records without those of arrival ``first`` to ``last``, and a reseed in the place of the first."""
    lost = records.where(F.col("arrival") == first)
    own = {"kind": F.lit("reseed"), "product": F.lit(""), "seq": F.lit(None).cast("long"), "exch_us": F.lit(None).cast("long"), "raw": F.lit(None).cast("string"), "reason": F.lit("connected again"), "channel": F.lit("control"), "bad": F.lit(0)}
    put = lost.withColumns({k: v.cast(records.schema[k].dataType) for k, v in own.items() if k in records.columns})
    return records.where(~F.col("arrival").between(first, last)).unionByName(put)


class _Steps(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class SyntheticStream(DataSourceStreamReader):
    """A stream of frames, a bounded number for each micro-batch: the queue behind a source is what a trigger takes.

    Every row carries the reseeds up to it as ``epoch``: they concern all products, and state is kept by product.
    """

    def __init__(self, options: dict[str, str]):
        number = lambda k, default: int(options.get(k, default))
        self.count, self.start, self.step, self.batch, self.products = number("count", 1000), number("start", 1), number("step", 1), number("batch", 250), number("products", 2)
        pairs = [p.split(":") for p in options.get("skip_after", "").split(",") if p]
        self.skips = {int(a): int(b) for a, b in pairs}
        self.severs = sorted(int(x) for x in options.get("sever_after", "").split(",") if x)
        self.at = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.batch, self.count)
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["at"])
        return [_Steps(start["at"], end["at"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last = partition.value
        for i in range(first, last):
            epoch = 1 + sum(s < i for s in self.severs)
            if i == 0 or i - 1 in self.severs:
                yield (2 * i, "reseed", "", None, epoch, 2_000_000_000 * 10**9 + i * 10**6, None, "subscribed" if i == 0 else "connected again")
            product = f"S{i % self.products}"
            seq = self.start + (i // self.products) * self.step + sum(n for s, n in self.skips.items() if s < i)
            raw = FRAME.format(product=product, seq=seq, part=i % 10**6, side="sell" if i % 2 else "buy", price=100 + i)
            yield (2 * i + 1, "message", product, seq, epoch, 2_000_000_000 * 10**9 + i * 10**6, raw, None)

    def commit(self, end: dict) -> None:
        """What was taken needs no keeping: frames can be made again."""


class SyntheticFeed(DataSource):
    """``spark.dataSource.register(SyntheticFeed)``, then ``spark.readStream.format("synthetic").load()``."""

    @classmethod
    def name(cls) -> str:
        return "synthetic"

    def schema(self) -> str:
        return "arrival long, kind string, product string, seq long, epoch long, recv_ns long, raw string, reason string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SyntheticStream(dict(self.options))
