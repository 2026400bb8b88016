"""Commands: ``python -m seqlake.cli capture | replay | verify | stat | bench``. Exit codes: 2 for wrong usage, 1 for an error."""

from __future__ import annotations

import argparse
import hashlib
import os
import re
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions import text as T
from seqlake.functions.scalars import time_text
from seqlake.operators import canonical, policies, replay, storage, summaries
from seqlake.operators.window import window_records
from seqlake.sources import columnar, synthetic, tapefile

FORMATS = {"raw": tapefile.ROWS_VERSION, "columnar": columnar.VERSION}


def session() -> SparkSession:
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = f"{here}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.dataSource.register(tapefile.TapeSource)
    return spark


def load(spark: SparkSession, args: argparse.Namespace, mode: str = "records") -> DataFrame:
    options = {k: getattr(args, k) for k in ("symbol", "date", "hour") if getattr(args, k, None)}
    return spark.read.format("tapelog").options(mode=mode, **options).load(args.window)


def summary_lines(records: DataFrame) -> list[str]:
    one = records.agg(F.count("*").alias("n"), *[summaries.count_if(F.col("kind") == k).alias(k) for k in ("message", "gap", "reseed")], F.min("recv_ns").alias("a"), F.max("recv_ns").alias("b")).first()
    return [f"records {one.n}", f"messages {one.message}", f"gaps {one.gap}", f"reseeds {one.reseed}", f"span {((one.b or 0) - (one.a or 0)) / 1e9:.3f}s"]


def run_capture(spark: SparkSession, args: argparse.Namespace) -> int:
    """A synthetic feed through the tracker into window files: there is no network here."""
    from seqlake.streaming import capture as C

    spark.dataSource.register(synthetic.SyntheticFeed)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.format("synthetic").options(count=args.count, batch=args.buffer, skip_after=args.skip_after, sever_after=args.sever_after).load()
    with tempfile.TemporaryDirectory() as work:
        run = C.capture(stream, f"{work}/out", f"{work}/checkpoint", mode=args.mode, policy=args.policy, depth=args.buffer, window_s=args.window_s, trigger={"processingTime": "0 seconds"})
        done = run.finish()
        folders = sorted(f"{work}/out/{d}" for d in os.listdir(f"{work}/out") if d.startswith("batch="))
        rows = spark.read.option("basePath", f"{work}/out").parquet(*folders)
        wide = lambda c: F.col(c).cast("decimal(20,0)").alias(c)
        out = rows.select(F.lit(args.symbol).alias("symbol"), "kind", "recv_ns", F.col("raw").cast("binary").alias("raw"), wide("expected"), wide("got"), wide("dropped"), "reason", "arrival", "sub", F.floor(F.col("recv_ns") / (args.window_s * 10**9)).alias("w"))
        dealt = out.repartition("w").sortWithinPartitions("w", "arrival", "sub").drop("arrival", "sub", "w")
        dealt.write.format("tapelog").mode("append").options(version=FORMATS[args.format], window_ns=args.window_s * 10**9).save(args.dir)
    print(f"messages {done.messages}, records {done.records}, gaps {done.gaps}, reseeds {done.reseeds}, stale {done.stale}, dropped {done.dropped}", file=sys.stderr)
    return 0


def run_replay(spark: SparkSession, args: argparse.Namespace) -> int:
    got = replay.replay(window_records(load(spark, args)), continue_on_gap=args.continue_on_gap, reorder=args.reorder)
    if args.pretty:
        nano = got.delivered.withColumns({c: F.expr(f"{c} div 1000") for c in ("exch_us", "recv_us")})
        lines = nano.select("i", T.pretty(args.width).alias("line"))
    else:
        lines = canonical.lines(got.delivered)
    if not args.quiet:
        with open(args.out, "w", encoding="utf-8") if args.out else os.fdopen(os.dup(1), "w", encoding="utf-8") as out:
            for r in lines.orderBy("i").select("line").toLocalIterator():
                out.write(r.line + "\n")
    print("; ".join(summary_lines(got.delivered)), file=sys.stderr)
    if got.error:
        print(got.error, file=sys.stderr)
        return 1
    return 0


def run_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    got = replay.replay(window_records(load(spark, args)), continue_on_gap=True, reorder=args.reorder)
    digest, size = hashlib.sha256(), 0
    for r in canonical.lines(got.delivered).orderBy("i").select("line").toLocalIterator():
        data = r.line.encode() + b"\n"
        digest.update(data)
        size += len(data)
    print("\n".join(summary_lines(got.delivered)))
    print(f"canonical {size} bytes, sha256 {digest.hexdigest()}")
    found = got.discontinuities.orderBy("i").select(T.discontinuity_text(time_text(F.col("recv_ns"))).alias("text"))
    count = found.count()
    for r in found.toLocalIterator():
        print(r.text)
    if args.chart:
        density = {r["column"]: r["n"] for r in summaries.timeline_columns(got.delivered.withColumn("recv_us", F.expr("recv_us div 1000")), args.width).collect()}
        most = max(density.values(), default=0)
        level = lambda n: 0 if not n else 7 if n >= most else min(7, n * 7 // most + 1)
        print("".join(T.RAMP[True][level(density.get(i, 0))] for i in range(args.width)))
    return 1 if count else 0


def run_stat(spark: SparkSession, args: argparse.Namespace) -> int:
    profiles = load(spark, args, "profile")
    one = storage.totals(profiles).first()
    formats = ", ".join(f"{r.files} v{r.version}" for r in storage.census(profiles).orderBy("version").collect())
    print(f"files {one.files} ({formats})\nrecords {one.records} in {one.batches} batches, {one.gap_batches} with a gap\nframes {one.frame_bytes} bytes\nstored {one.stored} bytes\ncolumnar {one.columnar} bytes, {one.ratio_frames:.2f} times smaller than the frames")
    for r in storage.storage_profile(profiles).collect():
        print(f"{r.name:<14} {r.stored:>12} {r.raw:>12} {100 * r.share:>7.1f}% {r.ratio:>7.2f}x")
    return 0


def run_bench(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = window_records(load(spark, args)).withColumn("recv_us", F.expr("recv_us div 1000"))
    load_rows = summaries.amplified(rows, args.repeat).select((F.col("pass") * F.lit(1 << 40) + F.col("arrival")).alias("arrival"), "product", "recv_us", F.lit("message").alias("kind"))
    for policy in [args.policy] if args.policy else policies.POLICIES:
        r = policies.bench_result(policies.simulate(load_rows, policy, depth=args.buffer, service_us=args.service_us)).first()
        print(f"{policy:<7} offered {r.offered} ({r.offered_rate:.1f}/s), written {r.written} ({r.written_rate:.1f}/s), lost {100 * r.loss:.1f}%, deepest queue {r.peak_depth}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqlake")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, window: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if window:
            p.add_argument("window")
            for k in ("symbol", "date", "hour"):
                p.add_argument(f"--{k}")
        return p

    p = command("capture", run_capture, window=False)
    p.add_argument("dir")
    p.add_argument("--symbol", default="SYN")
    p.add_argument("--count", type=int, default=1000)
    p.add_argument("--buffer", type=int, default=4096)
    p.add_argument("--window-s", type=int, default=300)
    p.add_argument("--format", choices=FORMATS, default="columnar")
    p.add_argument("--policy", choices=policies.POLICIES, default="block")
    p.add_argument("--mode", choices=("contiguous", "monotonic"), default="contiguous")
    p.add_argument("--skip-after", default="")
    p.add_argument("--sever-after", default="")
    p = command("replay", run_replay)
    p.add_argument("-o", "--out")
    p.add_argument("--continue-on-gap", action="store_true")
    p.add_argument("--reorder", type=int, default=4096)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--width", type=int, default=96)
    p = command("verify", run_verify)
    p.add_argument("--reorder", type=int, default=4096)
    p.add_argument("--chart", action="store_true")
    p.add_argument("--width", type=int, default=80)
    command("stat", run_stat)
    p = command("bench", run_bench)
    p.add_argument("--policy", choices=policies.POLICIES)
    p.add_argument("--repeat", type=int, default=20)
    p.add_argument("--buffer", type=int, default=4096)
    p.add_argument("--service-us", type=int, default=20)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)  # exits with 2 for wrong usage
    try:
        return args.run(session(), args)
    except Exception as e:  # noqa: BLE001  a command tells its error in one line
        said = re.findall(r"\b(?:\w+Error|Taken|Corrupt): (.+)", str(e))  # Spark wraps what a source raises
        print(f"seqlake: {said[-1] if said else str(e).splitlines()[0]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
