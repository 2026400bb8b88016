"""Registered queries of stored windows, sessions, metrics, policies and synthetic feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions import scalars as X
from seqlake.functions import text as T
from seqlake.operators import policies as P
from seqlake.operators import replay as R
from seqlake.operators import sequence as S
from seqlake.operators import storage as ST
from seqlake.operators import summaries as A
from seqlake.plans.registry import FRAMES, LAT, MINUTE, OFF, latencies, metrics, metrics_sql, query
from seqlake.sources import columnar, synthetic, tapefile
from seqlake.sources.staging import claim

DAY = 86_400_000_000


def stored(v: DataFrame, version: int) -> str:
    """Write the feed as a window of one file a day, and say where."""
    spark = v.sparkSession
    spark.dataSource.register(tapefile.TapeSource)
    root = claim(spark, "window")
    wide = lambda c: F.col(c).cast("decimal(20,0)").alias(c)
    rows = v.select(F.lit("FEED").alias("symbol"), "kind", (F.col("recv_us") * 1000).alias("recv_ns"), F.col("raw").cast("binary").alias("raw"), wide("expected"), wide("got"), wide("dropped"), "reason", X.window_start(F.col("recv_us"), DAY).alias("day"), "arrival")
    # Encoding takes long for few bytes, so the files are dealt to a fixed number of tasks.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol", "day").sortWithinPartitions("day", "arrival").drop("day", "arrival")
    dealt.write.format("tapelog").mode("append").options(version=version, window_ns=DAY * 1000).save(root)
    return root


def load(v: DataFrame, version: int, mode: str = "records") -> DataFrame:
    return v.sparkSession.read.format("tapelog").option("mode", mode).load(stored(v, version))


#: Where a record stands in a window of one file a day.
DAYS = f"dy as (select *, recv_us - (recv_us + 62135596800000000) % {DAY} as day from v), pl as (select *, dense_rank() over (order by day) - 1 as f, row_number() over (partition by day order by arrival) - 1 as r from dy)"
STORED = f"select * from (with {DAYS} select f as file_idx, r as rec, kind, recv_us * 1000 as recv_ns, raw, cast(expected as bigint) as expected, cast(got as bigint) as got, cast(dropped as bigint) as dropped, reason, strftime(make_timestamp(day), 'v1/symbol=FEED/date=%Y-%m-%d/hour=%H/%Y%m%dT%H%M%SZ.tape') as file from pl)"


def window_rows(v: DataFrame, version: int) -> DataFrame:
    whole = lambda c: F.col(c).cast("long").alias(c)
    return load(v, version).select(whole("file_idx"), "rec", "kind", "recv_ns", F.col("raw").cast("string").alias("raw"), whole("expected"), whole("got"), whole("dropped"), "reason", "file")


@query(STORED)
def window_rows_v1(v: DataFrame) -> DataFrame:
    """The feed written as row-oriented files, one a day, and read back."""
    return window_rows(v, tapefile.ROWS_VERSION)


@query(STORED)
def window_rows_v2(v: DataFrame) -> DataFrame:
    """The feed written as columnar files, one a day, and read back."""
    return window_rows(v, columnar.VERSION)


@query(f"select * from (with {DAYS}, {FRAMES} select f as file_idx, r as rec, case when fr.decode_error <> '' or kind <> 'message' then '' else fr.type end as type, case when fr.decode_error = '' then fr.exch_us end as exch_us, case when fr.decode_error = '' then fr.seq end as seq, case when fr.decode_error = '' then nullif(fr.side, '') end as side, case when fr.decode_error = '' then nullif(fr.price_text, '') end as price_text, case when fr.decode_error = '' then nullif(fr.size_text, '') end as size_text from pl left join fr using (arrival))")
def window_index(v: DataFrame) -> DataFrame:
    """The index columns of columnar files; the SQL has the fields that the frames were made from."""
    return load(v, columnar.VERSION, "index").select(F.col("file_idx").cast("long").alias("file_idx"), "rec", "type", F.expr("exch_ns div 1000").alias("exch_us"), F.col("seq").cast("long").alias("seq"), "side", "price_text", "size_text")


@query(f"select * from (with {DAYS} select f as file_idx, count(*) as rows, min(recv_us) * 1000 as first_ns, max(recv_us) * 1000 as last_ns, bool_or(kind = 'gap') as has_gap, bool_or(kind = 'reseed') as has_reseed from pl group by f)")
def window_footers(v: DataFrame) -> DataFrame:
    """Footers alone, summed by file."""
    feet = load(v, columnar.VERSION, "footers")
    return feet.groupBy(F.col("file_idx").cast("long").alias("file_idx")).agg(F.sum("rows").alias("rows"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.bool_or("has_gap").alias("has_gap"), F.bool_or("has_reseed").alias("has_reseed"))


@query(f"select * from (with {DAYS} select count(distinct day) as files, count(*) as records, cast(sum(octet_length(encode(coalesce(raw, '')))) as bigint) as frame_bytes, (select count(distinct day) from dy) as v2 from pl)")
def storage_totals(v: DataFrame) -> DataFrame:
    profiles = load(v, columnar.VERSION, "profile")
    one, versions = ST.totals(profiles), ST.census(profiles).agg(F.sum(F.when(F.col("version") == 2, F.col("files"))).alias("v2"))
    return one.select("files", "records", "frame_bytes").join(F.broadcast(versions))  # one row each


@query()
def storage_columns(v: DataFrame) -> DataFrame:
    """What each column costs, the largest first; sizes of deflated blocks have no SQL."""
    return ST.storage_profile(load(v, columnar.VERSION, "profile"))


# ---------------------------------------------------------------- sessions and metrics


@query(f"select count(*) as records, count(*) filter (kind = 'message') as messages, cast(sum(octet_length(encode(coalesce(raw, '')))) as bigint) as bytes, count(distinct recv_us - (recv_us + 62135596800000000) % {DAY}) - 1 as rotations, count(*) filter (kind = 'reseed') as reseeds, count(*) filter (kind = 'gap') as gaps, (select count(*) from cl where contiguous = 'stale') as stale, count(*) filter (bad in (1, 2)) as decode_errors, count(*) filter (etype = 'error') as exchange_errors, cast(coalesce(sum(dropped), 0) as bigint) as dropped, case when max(recv_us) > min(recv_us) then count(*) filter (kind = 'message') * 1e6 / (max(recv_us) - min(recv_us)) else 0 end as rate from v")
def session_summary(v: DataFrame) -> DataFrame:
    """Everything that a capture session counts."""
    return A.session_summary(v, DAY)


PRODUCT = "select s.slot, p.product, cast(coalesce(messages, 0) as bigint) as messages, cast(coalesce(anomalies, 0) as bigint) as anomalies, cast(coalesce(lag_n, 0) as bigint) as lag_n, lag_sum, lag_min, lag_max, coalesce(messages, 0) / 86400.0 as rate from (select unnest(range(min(recv_us // 86400000000), max(recv_us // 86400000000) + 1)) as slot from v) s, (select distinct product from v where product <> '') p left join (select recv_us // 86400000000 as slot, v.product, count(*) filter (v.kind = 'message') as messages, count(*) filter (contiguous in ('gap', 'regression', 'reconnect_gap')) as anomalies, count(abs(v.recv_us - exch_us)) as lag_n, cast(sum(abs(v.recv_us - exch_us)) as bigint) as lag_sum, min(abs(v.recv_us - exch_us)) as lag_min, max(abs(v.recv_us - exch_us)) as lag_max from v left join cl using (arrival) where v.product <> '' group by all) m on m.slot = s.slot and m.product = p.product"
PRODUCT = PRODUCT.replace("v.recv_us", "v.recv_us").replace("select recv_us // 86400000000 as slot, v.product", "select v.recv_us // 86400000000 as slot, v.product")


@query(PRODUCT)
def product_metrics(v: DataFrame) -> DataFrame:
    """Intervals of each product, empty ones included."""
    return A.product_metrics(v, S.classified(v, "contiguous"), DAY)


@query(f"select * from (with pm as ({PRODUCT}) select slot, product, 'Messages' as name, 'Count' as unit, cast(messages as double) as value, null as n, null as total, null as least, null as most from pm union all select slot, product, 'MessageRate', 'Count/Second', rate, null, null, null, null from pm union all select slot, product, 'SequenceGaps', 'Count', cast(anomalies as double), null, null, null, null from pm union all select slot, product, 'IngestLag', 'Seconds', null, lag_n, lag_sum / 1e6, lag_min / 1e6, lag_max / 1e6 from pm where lag_n > 0)")
def product_datums(v: DataFrame) -> DataFrame:
    """One row for each figure of an interval, with its unit; a lag is a set of statistics, and left out where none was measured."""
    return A.product_datums(A.product_metrics(v, S.classified(v, "contiguous"), DAY))


@query(f"select count(*) as n, cast(sum(lat) as bigint) // count(*) as mean, case when max(lat) * 1000 >= 1000000000 then (max(lat) * 1000 + 500000) // 1000000 * 1000000 else max(lat) * 1000 end as most from ({LAT})")
def latency_summary(v: DataFrame) -> DataFrame:
    lat = latencies(v)
    return lat.agg(F.count("*").alias("n"), F.expr("sum(lat) div count(*)").alias("mean"), T.latency_rounded(F.max("lat") * 1000).alias("most"))


@query(f"select least(greatest((f0.first + off // (1000 << k) * (1000 << k) - s.a) * 80 // (s.b - s.a), 0), 79) as \"column\", count(*) as n from ({OFF}), (select arg_min(recv_us, i) as first from rp where kind = 'message') f0, (select min(recv_us) as a, max(recv_us) as b from rp) s, (select min(k) as k from range(0, 40) t(k) where (select max(off) from ({OFF})) // (1000 << k) < 4096) group by 1")
def timeline_columns(v: DataFrame) -> DataFrame:
    """Message density folded to 80 columns."""
    return A.timeline_columns(R.ordered(v), 80)


@query(f"select slot * {60 * MINUTE} as at_us, cast(sum(messages) over w as bigint) as messages, cast(sum(gaps + reseeds) over w as bigint) as breaks from (select slot, messages, gaps, reseeds from ({metrics_sql('select * from mt')})) window w as (order by slot)")
def progress_samples(v: DataFrame) -> DataFrame:
    """What a session had counted at the start of each interval's end."""
    so_far = Window.orderBy("slot")  # one row for each interval
    return metrics(v).select((F.col("slot") * 60 * MINUTE).alias("at_us"), F.sum("messages").over(so_far).alias("messages"), F.sum(F.col("gaps") + F.col("reseeds")).over(so_far).alias("breaks"))


@query("select recv_us // 3600000000 as hour, count(exch_us) as observed, count(*) - count(exch_us) as absent, cast(sum(recv_us - exch_us) as bigint) as lag_us from v where kind = 'message' group by 1")
def ingest_lag(v: DataFrame) -> DataFrame:
    """Local less exchange time; what has no exchange time is not observed."""
    lag = F.col("recv_us") - F.col("exch_us")
    return v.where("kind = 'message'").groupBy(F.floor(F.col("recv_us") / 3_600_000_000).cast("long").alias("hour")).agg(F.count(lag).alias("observed"), (F.count("*") - F.count(lag)).alias("absent"), F.sum(lag).alias("lag_us"))


@query("select arrival, case kind when 'message' then channel else 'control' end as ordering from v where kind <> 'message' or bad not in (1, 2)")
def ordering_channels(v: DataFrame) -> DataFrame:
    return v.where("kind <> 'message' or bad not in (1, 2)").select("arrival", F.when(F.col("kind") == "message", X.channel_of(F.col("etype"))).otherwise("control").alias("ordering"))


@query("select product, product <> '' as valid, count(*) as n from v where coalesce(etype, '') <> 'snapshot' group by all")
def valid_symbols(v: DataFrame) -> DataFrame:
    """Frames other than snapshots, by product, and whether it could name a partition."""
    return v.where("coalesce(etype, '') <> 'snapshot'").groupBy("product").agg(F.count("*").alias("n")).select("product", X.valid_symbol(F.col("product")).alias("valid"), "n")


@query("select arrival, recv_us, seq from v")
def delta_decode(v: DataFrame) -> DataFrame:
    """Differences within files summed up again, absent values passed over."""
    w = Window.partitionBy("file_idx").orderBy("rec")
    before = F.last("seq", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    coded = v.select("arrival", "file_idx", "rec", (F.col("recv_us") - F.coalesce(F.lag("recv_us").over(w), F.lit(0))).alias("dt"), (F.col("seq") - F.coalesce(before, F.lit(0))).alias("dq"))
    return coded.select("arrival", F.sum("dt").over(w).alias("recv_us"), F.when(F.col("dq").isNotNull(), F.sum("dq").over(w)).alias("seq"))


@query("select cast(count(*) as bigint) as added, count(*) filter (k = 0) as uploaded, count(*) filter (k = 1) as existed, count(*) filter (k = 2) as failed, count(*) filter (k = 3) as dropped, cast(sum(greatest(a - 1, 0)) as bigint) as retries, cast(sum(case when k = 0 then b else 0 end) as bigint) as bytes, count(*) filter (k = 4) as pending from (select file_idx % 5 as k, case when file_idx % 5 < 3 then file_idx % 4 + 1 else 0 end as a, sum(octet_length(encode(coalesce(raw, '')))) as b from v group by file_idx)")
def upload_stats(v: DataFrame) -> DataFrame:
    """Counts over upload events, one for each file."""
    files = v.groupBy("file_idx").agg(F.sum(F.octet_length(F.coalesce("raw", F.lit("")))).alias("b"))
    k = F.col("file_idx") % 5
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("uploaded", "existed", "failed", "dropped")], F.lit(None).cast("string")), (k + 1).cast("int"))
    return ST.upload_stats(files.select(outcome.alias("outcome"), F.when(k < 3, F.col("file_idx") % 4 + 1).otherwise(0).alias("attempts"), F.when(k == 0, F.col("b")).otherwise(0).alias("bytes")))


@query(metrics_sql("select count(*) as intervals, count(*) filter (slot % 7 <> 3) as published, count(*) filter (slot % 7 = 3) as failed, cast(sum(case when slot % 7 <> 3 then 3 + case when lag_n > 0 then 1 else 0 end else 0 end) as bigint) as datapoints from mt"))
def publisher_stats(v: DataFrame) -> DataFrame:
    return ST.publisher_stats(metrics(v).select("slot", (F.lit(3) + F.when(F.col("lag_n") > 0, 1).otherwise(0)).alias("datapoints"), (F.col("slot") % 7 != 3).alias("ok")))


# ---------------------------------------------------------------- policies and synthetic feeds


@query("select product, policy, count(*) as offered, true as conserved, true as reseeds_kept from v, (select unnest(['block', 'drop', 'buffer']) as policy) group by all")
def policy_conservation(v: DataFrame) -> DataFrame:
    """Under every policy what was written and what gap rows say was dropped is what was offered."""
    out = None
    for policy in P.POLICIES:
        rows = P.simulate(v, policy, depth=4, service_us=600_000_000)
        gaps = P.gap_rows(rows).groupBy("product").agg(F.sum("dropped").alias("told"))
        kept = rows.groupBy("product").agg(F.count("*").alias("offered"), F.sum(F.col("kept").cast("long")).alias("written"), F.min(F.col("kept") | (F.col("kind") == "message")).alias("reseeds_kept"))
        one = kept.join(gaps, "product", "left").select("product", F.lit(policy).alias("policy"), "offered", (F.col("written") + F.coalesce("told", F.lit(0)) == F.col("offered")).alias("conserved"), "reseeds_kept")
        out = one if out is None else out.unionByName(one)
    return out


SERVICE = 600_000_000
QUEUE = f"qu as (select product, arrival, recv_us, max(recv_us - {SERVICE} * n) over (partition by product order by arrival) + {SERVICE} * n as start_us from (select *, row_number() over (partition by product order by arrival) as n from v))"


@query(f"select * from (with {QUEUE} select product, arrival, start_us from qu)")
def policy_buffer(v: DataFrame) -> DataFrame:
    """When a writer that needs ten minutes a record begins each, behind a queue without bounds; the SQL is the closed form."""
    return P.simulate(v, "buffer", depth=4, service_us=SERVICE).select("product", "arrival", "start_us")


@query(f"select * from (with {QUEUE} select a.product, a.recv_us // {DAY} as slot, max(n) as deepest from (select a.product, a.arrival, a.recv_us, (select count(*) from qu b where b.product = a.product and b.arrival < a.arrival and b.start_us + {SERVICE} > a.recv_us) as n from qu a) a group by all)")
def queue_depths(v: DataFrame) -> DataFrame:
    """The deepest queue of each product and day."""
    rows = P.simulate(v, "buffer", depth=4, service_us=SERVICE)
    return rows.groupBy("product", F.floor(F.col("recv_us") / DAY).cast("long").alias("slot")).agg(F.max("queued").alias("deepest"))


#: A queue of four that sheds, record by record: the ends of what waits are its state.
SHED = f"""od as (select *, row_number() over (partition by product order by arrival) as n from v),
  sh as (select product, n, arrival, recv_us, kind, cast(0 as bigint) as queued, true as kept, recv_us as start_us, [recv_us + {SERVICE}] as ends, recv_us + {SERVICE} as last from od where n = 1
    union all select product, n, arrival, recv_us, kind, cast(len(w) as bigint), stays, case when stays then s end, case when stays then list_append(w, s + {SERVICE}) else w end, case when stays then s + {SERVICE} else last end
    from (select *, not (len(w) >= 4 and kind = 'message') as stays, greatest(recv_us, last) as s from
      (select od.product, od.n, od.arrival, od.recv_us, od.kind, list_filter(sh.ends, lambda e: e > od.recv_us) as w, sh.last from sh join od on od.product = sh.product and od.n = sh.n + 1)))"""


@query(f"select * from (with recursive {SHED} select arrival, product, kind, recv_us, kept, start_us, queued from sh)")
def policy_drop(v: DataFrame) -> DataFrame:
    """What a writer that needs ten minutes a record keeps behind a queue of four; the SQL goes record by record."""
    return P.simulate(v, "drop", depth=4, service_us=SERVICE)


@query(f"select * from (with recursive {SHED}, rn as (select *, coalesce(sum(cast(kept as bigint)) over (partition by product order by arrival rows between unbounded preceding and 1 preceding), 0) as run from sh) select product, min(recv_us) filter (not kept) as at_us, count(*) filter (not kept) as dropped, min(arrival) filter (kept) as next_arrival from rn group by product, run having count(*) filter (not kept) > 0)")
def policy_gaps(v: DataFrame) -> DataFrame:
    """One gap row for each run of dropped records."""
    return P.gap_rows(P.simulate(v, "drop", depth=4, service_us=SERVICE))


DEPTHS = f"dp as (select a.*, (select count(*) from qu b where b.product = a.product and b.arrival < a.arrival and b.start_us + {SERVICE} > a.recv_us) as n from qu a)"
RUNS = "select 'drop' as policy, recv_us, start_us, kept, queued from sh union all select 'buffer', recv_us, start_us, true, n from dp union all select 'block', recv_us, start_us, true, least(n, 4) from dp"


@query(f"select * from (with recursive {SHED}, {QUEUE}, {DEPTHS}, rs as ({RUNS}), sm as (select policy, count(*) as offered, count(*) filter (kept) as written, max(queued) as peak_depth, (greatest(max(recv_us), max(start_us)) - min(recv_us)) / 1e6 as seconds from rs group by policy) select *, offered - written as dropped, (offered - written) / offered as loss, offered / seconds as offered_rate, written / seconds as written_rate from sm)")
def bench_results(v: DataFrame) -> DataFrame:
    """Offered and written rates, loss and the deepest queue of each policy."""
    out = None
    for policy in P.POLICIES:
        one = P.bench_result(P.simulate(v, policy, depth=4, service_us=SERVICE)).withColumn("policy", F.lit(policy))
        out = one if out is None else out.unionByName(one)
    return out


SYNTHETIC = "sy as (select i, 'data' as kind, 1000 + 3 * i + case when i > 40 then 7 else 0 end + case when i > 120 then 100 else 0 end as seq from range(0, 200) t(i)), sv as (select 2 * i + 1 as o, kind, seq from sy union all select 0, 'reseed', null union all select 2 * 90 + 2, 'reseed', null)"


@query(f"select * from (with {SYNTHETIC} select row_number() over (order by o) - 1 as arrival, kind, seq from sv)")
def synthetic_feed(v: DataFrame) -> DataFrame:
    """A scripted feed: numbers three apart, seven lost after frame 40, a hundred after 120, a new connection after 90."""
    return synthetic.frames(v.sparkSession, count=200, start=1000, step=3, skip_after={40: 7, 120: 100}, sever_after=[90]).select("arrival", "kind", "seq")


@query("select * from (with kept as (select arrival, file_idx, rec, kind, product, seq, bad from v where not (arrival between 300 and 339)), sev as (select *, false as put from kept union all select 300, 300 // 512, 300 % 512, 'reseed', '', null, 0, true), ep as (select *, sum(case when kind = 'reseed' then 1 else 0 end) over (order by arrival) as epoch from sev), sq as (select *, max(seq) over (partition by product order by arrival rows between unbounded preceding and 1 preceding) as hwm, epoch <> lag(epoch) over (partition by product order by arrival) as reseeded from ep where kind = 'message' and seq is not null and bad = 0) select arrival, product, seq, hwm + 1 as expected from sq where reseeded and seq > hwm + 1)")
def severed_feed(v: DataFrame) -> DataFrame:
    """The feed cut for forty records and connected again: what the tracker finds at new connections."""
    return S.classified(synthetic.severed(v, 300, 339), "monotonic").where("anomaly = 'reconnect_gap'").select("arrival", "product", "seq", "expected")
