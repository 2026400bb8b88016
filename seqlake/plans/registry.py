"""Registered queries and their DuckDB equivalents, over the ``events`` table seen as a recorded feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions import scalars as X
from seqlake.operators import replay as R
from seqlake.operators import sequence as S
from seqlake.operators import summaries as A
from seqlake.sources.fixture import records, view_sql

QUERIES: dict = {}
SQL: dict = {}
MINUTE, FIVE_MINUTES = 60_000_000, 300_000_000
HALF_DAY = 43_200_000_000


def query(sql: str | None = None):
    """Register a function of the feed's records under its name, with its SQL over the view ``v``."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(records(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"with v as ({view_sql()}), {CHAIN} {sql}"
        return f

    return put


#: Tables that the SQL of several queries starts from.
CHAIN = """
ep as (select *, sum(case when kind = 'reseed' then 1 else 0 end) over (order by arrival) as epoch from v),
sq as (select *, max(seq) over (partition by product order by arrival rows between unbounded preceding and 1 preceding) as hwm,
         epoch <> lag(epoch) over (partition by product order by arrival) as reseeded from ep where kind = 'message' and seq is not null and bad = 0),
cl as (select arrival, file_idx, rec, product, recv_us, seq, hwm + 1 as expected, seq - hwm - 1 as missing,
         case when hwm is null then 'none' when reseeded and seq <= hwm then 'stale' when reseeded and seq <> hwm + 1 then 'reconnect_gap'
              when reseeded then 'none' when seq <= hwm then 'regression' when seq <> hwm + 1 then 'gap' else 'none' end as contiguous,
         case when hwm is null then 'none' when reseeded and seq <= hwm then 'stale' when reseeded and seq <> hwm + 1 then 'reconnect_gap'
              when reseeded then 'none' when seq <= hwm then 'regression' else 'none' end as monotonic from sq),
pg as (select *, count(exch_us) filter (kind = 'message') over (order by arrival) as grp, count(*) filter (kind = 'message') over (order by arrival rows between unbounded preceding and 1 preceding) as earlier from v),
pk as (select arrival, file_idx, rec, kind, recv_us, seq, product, kind = 'reseed' and coalesce(earlier, 0) = 0 as opening,
         case when grp = 0 then 0 else max(exch_us) over (partition by grp) end as k_exch,
         case when grp = 0 then 0 else max(case when exch_us is null then null when seq is null then 0 else 1 end) over (partition by grp) end as k_rank,
         case when grp = 0 then 0 else coalesce(max(case when exch_us is not null then coalesce(seq, 0) end) over (partition by grp), 0) end as k_seq,
         case when grp = 0 then '' else max(case when exch_us is not null then channel end) over (partition by grp) end as k_channel from pg),
rp as (select *, row_number() over (order by k_exch, k_rank, k_seq, k_channel, file_idx, rec) - 1 as i, kind = 'gap' or kind = 'reseed' and not opening as disc from pk)
"""
ANOMALY = "select arrival, product, seq, {0} as anomaly, expected, missing from cl where {0} <> 'none'"


@query(ANOMALY.format("contiguous"))
def seq_anomalies_contiguous(v: DataFrame) -> DataFrame:
    return S.classified(v, "contiguous").where("anomaly <> 'none'").select("arrival", "product", "seq", "anomaly", "expected", "missing")


@query(ANOMALY.format("monotonic"))
def seq_anomalies_monotonic(v: DataFrame) -> DataFrame:
    return S.classified(v, "monotonic").where("anomaly <> 'none'").select("arrival", "product", "seq", "anomaly", "expected", "missing")


@query("select arrival, 0 as sub, 'gap' as kind, product, recv_us, expected, seq as got, missing, contiguous as anomaly from cl where contiguous in ('gap', 'regression', 'reconnect_gap') union all select arrival, 1, kind, product, recv_us, null, null, null, null from v")
def gap_records_inserted(v: DataFrame) -> DataFrame:
    return S.with_gap_rows(v, "contiguous").select("arrival", "sub", "kind", "product", "recv_us", "expected", "got", "missing", "anomaly")


@query("select arrival, k_exch, k_rank, k_seq, k_channel from pk")
def pinned_keys(v: DataFrame) -> DataFrame:
    return R.annotated(v).select("arrival", *R.KEY)


@query("select i, arrival, file_idx, rec, kind, opening, disc from rp")
def replay_order(v: DataFrame) -> DataFrame:
    return R.ordered(v).select("i", "arrival", "file_idx", "rec", "kind", "opening", "disc")


@query("select i, arrival, kind from rp where i < coalesce((select min(i) from rp where disc), 9223372036854775807)")
def replay_until_gap(v: DataFrame) -> DataFrame:
    return R.until_gap(R.ordered(v)).select("i", "arrival", "kind")


@query("select i, arrival, kind, recv_us from rp where disc")
def discontinuities(v: DataFrame) -> DataFrame:
    return R.ordered(v).where("disc").select("i", "arrival", "kind", "recv_us")


@query("select arrival, opening from pk where kind = 'reseed'")
def opening_reseed(v: DataFrame) -> DataFrame:
    return R.annotated(v).where("kind = 'reseed'").select("arrival", "opening")


@query("select max(arrival - i) + 1 as n from rp")
def required_reorder_window(v: DataFrame) -> DataFrame:
    return R.required_window(R.ordered(v))


@query("select count(*) as records, count(*) filter (kind = 'message') as messages, count(*) filter (kind = 'gap') as gaps, count(*) filter (kind = 'reseed') as reseeds, cast(sum(strlen(coalesce(props, '')) + 13) as bigint) as bytes, min(recv_us) as first_us, max(recv_us) as last_us, max(recv_us) - min(recv_us) as span_us from v")
def replay_stats(v: DataFrame) -> DataFrame:
    return A.replay_stats(v)


@query("select product, count(*) as messages, count(*) filter (contiguous = 'gap') as gap, count(*) filter (contiguous = 'regression') as regression, count(*) filter (contiguous = 'reconnect_gap') as reconnect_gap, count(*) filter (contiguous = 'stale') as stale from cl group by product")
def capture_summary(v: DataFrame) -> DataFrame:
    rows = S.classified(v, "contiguous")
    return rows.groupBy("product").agg(F.count("*").alias("messages"), *[A.count_if(F.col("anomaly") == k).alias(k) for k in ("gap", "regression", "reconnect_gap", "stale")])


@query("select product, count(*) filter (contiguous not in ('none', 'stale')) = 0 as trustworthy from cl group by product")
def trustworthy_by_symbol(v: DataFrame) -> DataFrame:
    return S.classified(v, "contiguous").groupBy("product").agg((A.count_if(~F.col("anomaly").isin("none", "stale")) == 0).alias("trustworthy"))


@query(f"select recv_us - (recv_us + 62135596800000000) % {HALF_DAY} as start_us, count(*) as n, min(arrival) as first_arrival from v group by 1")
def rotation_files(v: DataFrame) -> DataFrame:
    return v.groupBy(X.window_start(F.col("recv_us"), HALF_DAY).alias("start_us")).agg(F.count("*").alias("n"), F.min("arrival").alias("first_arrival"))


@query(f"select w as start_us, count(*) as runs from (select w, coalesce(w <> lag(w) over (order by arrival), true) as new from (select arrival, coalesce(exch_us, recv_us) - (coalesce(exch_us, recv_us) + 62135596800000000) % {HALF_DAY} as w from v)) where new group by w having count(*) > 1")
def reopen_violations(v: DataFrame) -> DataFrame:
    """Windows that a writer keyed by exchange time would have to open again."""
    rows = v.withColumn("w", X.window_start(F.coalesce("exch_us", "recv_us"), HALF_DAY))
    # Runs are cut within files; a file's first row is looked at beside the last row of the file before it.
    in_file = Window.partitionBy("file_idx").orderBy("rec")
    ends = v.withColumn("w", X.window_start(F.coalesce("exch_us", "recv_us"), HALF_DAY)).groupBy("file_idx").agg(F.max_by("w", "rec").alias("end")).withColumn("before", F.lag("end").over(Window.orderBy("file_idx"))).drop("end")
    new = rows.withColumn("p", F.lag("w").over(in_file)).join(ends, "file_idx").where(~F.coalesce(F.col("w") == F.coalesce("p", "before"), F.lit(False)))
    return new.groupBy(F.col("w").alias("start_us")).agg(F.count("*").alias("runs")).where("runs > 1")


@query("select distinct 'v1/symbol=' || product || strftime(make_timestamp(recv_us - recv_us % 300000000), '/date=%Y-%m-%d/hour=%H/%Y%m%dT%H%M%SZ.tape') as storage_key from v where kind = 'message'")
def storage_keys(v: DataFrame) -> DataFrame:
    return v.where("kind = 'message'").select(X.storage_key(F.col("product"), X.window_start(F.col("recv_us"), FIVE_MINUTES)).alias("storage_key")).distinct()


@query("select file_idx, cast(floor(rec / 128) as bigint) as batch, count(*) as n, min(recv_us) as first_us, max(recv_us) as last_us, bool_or(kind = 'gap') as has_gap, bool_or(kind = 'reseed') as has_reseed from v group by all")
def footer_zone_maps(v: DataFrame) -> DataFrame:
    return v.groupBy("file_idx", F.floor(F.col("rec") / 128).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("recv_us").alias("first_us"), F.max("recv_us").alias("last_us"), F.bool_or(F.col("kind") == "gap").alias("has_gap"), F.bool_or(F.col("kind") == "reseed").alias("has_reseed"))


METRICS = f"""mt as (select s.slot, cast(coalesce(messages, 0) as bigint) as messages, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(reseeds, 0) as bigint) as reseeds, cast(coalesce(lag_n, 0) as bigint) as lag_n, lag_sum, lag_min, lag_max, coalesce(messages, 0) / {60.0 * 60} as rate
  from (select unnest(range(min(recv_us // {60 * MINUTE}), max(recv_us // {60 * MINUTE}) + 1)) as slot from v) s left join
  (select recv_us // {60 * MINUTE} as slot, count(*) filter (kind = 'message') as messages, count(*) filter (kind = 'gap') as gaps, count(*) filter (kind = 'reseed') as reseeds, count(abs(recv_us - exch_us)) filter (kind = 'message') as lag_n, cast(sum(abs(recv_us - exch_us)) filter (kind = 'message') as bigint) as lag_sum, min(abs(recv_us - exch_us)) filter (kind = 'message') as lag_min, max(abs(recv_us - exch_us)) filter (kind = 'message') as lag_max from v group by 1) m using (slot))"""


def metrics(v: DataFrame) -> DataFrame:
    return A.interval_metrics(v, 60 * MINUTE)


def metrics_sql(select: str) -> str:
    return f"select * from (with {METRICS} {select})"


@query(metrics_sql("select * from mt"))
def interval_metrics(v: DataFrame) -> DataFrame:
    return metrics(v)


@query(metrics_sql("select slot, 'Messages' as name, cast(messages as double) as value from mt union all select slot, 'MessageRate', rate from mt union all select slot, 'SequenceGaps', cast(gaps as double) from mt union all select slot, 'Reseeds', cast(reseeds as double) from mt union all select slot, 'LagMaximum', cast(lag_max as double) from mt where lag_max is not null"))
def metric_datums(v: DataFrame) -> DataFrame:
    return A.metric_datums(metrics(v))


@query(metrics_sql("select slot, gaps > 0 as alarm from mt"))
def alarm_gaps(v: DataFrame) -> DataFrame:
    return A.alarm(metrics(v), F.col("gaps") > 0, 1)


@query(metrics_sql("select slot, coalesce(min(case when lag_max > 2400000000 then 1 else 0 end) over w = 1 and count(*) over w = 3, false) as alarm from mt window w as (order by slot rows between 2 preceding and current row)"))
def alarm_lag(v: DataFrame) -> DataFrame:
    return A.alarm(metrics(v), F.col("lag_max") > 2_400_000_000, 3)


LAT = "select abs(recv_us - exch_us) as lat from v where kind = 'message' and exch_us is not null"
BUCKET = "case when lat < 8 then lat else (length(bin(lat)) - 3) * 8 + ((lat >> (length(bin(lat)) - 4)) & 7) end"


def latencies(v: DataFrame) -> DataFrame:
    return v.where("kind = 'message' and exch_us is not null").select(F.abs(F.col("recv_us") - F.col("exch_us")).alias("lat"))


@query(f"select {BUCKET} as bucket, count(*) as n from ({LAT}) group by 1")
def latency_histogram(v: DataFrame) -> DataFrame:
    return A.latency_histogram(latencies(v))


@query(f"select q, least(case when b < 8 then b else ((9 + b % 8) << (cast(b // 8 as int) - 1)) - 1 end, (select max(lat) from ({LAT}))) as value from (select q, min(bucket) as b from (select bucket, sum(n) over (order by bucket) as cum, sum(n) over () as total from (select {BUCKET} as bucket, count(*) as n from ({LAT}) group by 1)), (select unnest([0.5, 0.9, 0.99, 0.999])::double as q) where cum >= greatest(1, ceil(cast(round(q * 1000) as bigint) * total / 1000.0)) group by q)")
def latency_quantiles(v: DataFrame) -> DataFrame:
    return A.latency_quantiles(latencies(v), (0.5, 0.9, 0.99, 0.999))


OFF = "select greatest(recv_us - (select arg_min(recv_us, i) from rp where kind = 'message'), 0) as off from rp where kind = 'message'"


@query(f"select off // (1000 << k) as bucket, count(*) as n from ({OFF}), (select min(k) as k from range(0, 40) t(k) where (select max(off) from ({OFF})) // (1000 << k) < 4096) group by 1")
def timeline_density(v: DataFrame) -> DataFrame:
    return A.timeline(R.ordered(v))


@query("select least(greatest((at_us - (select min(recv_us) from rp)) * 80 // (select max(recv_us) - min(recv_us) from rp), 0), 79) as \"column\", max(rank) as mark from (select arg_min(recv_us, i) as at_us, 1 as rank from rp group by file_idx union all select recv_us, 2 from rp where kind = 'reseed' and not opening union all select recv_us, 3 from rp where kind = 'gap') group by 1")
def timeline_marks(v: DataFrame) -> DataFrame:
    return A.timeline_marks(R.ordered(v), 80)


@query("select etype, channel, count(*) as n from v where kind = 'message' and bad not in (1, 2) group by all")
def channel_classification(v: DataFrame) -> DataFrame:
    """Types to channels; the SQL's channels come from the events' own types."""
    return v.where("kind = 'message' and bad not in (1, 2)").groupBy("etype").agg(F.count("*").alias("n")).select("etype", X.channel_of(F.col("etype")).alias("channel"), "n")


@query("select arrival, etype in ('subscriptions', 'error', 'heartbeat', '') as control, coalesce(etype = 'error', false) as error from v where kind = 'message'")
def control_frames(v: DataFrame) -> DataFrame:
    return v.where("kind = 'message'").select("arrival", X.is_control(F.col("etype")).alias("control"), X.is_error(F.col("etype")).alias("error"))


EXACT = "bad <> 4 and arrival % 211 <> 9 and arrival % 223 <> 3"


@query(f"select arrival, case when {EXACT} then cast(replace(price_text, '.', '') as bigint) end as units, case when {EXACT} then length(price_text) - instr(price_text, '.') end as scale from v where price_text is not null")
def decimal_parse(v: DataFrame) -> DataFrame:
    """Units and scale of prices; those that could not be given back as they are have none."""
    t = F.col("price_text")
    units = X.decimal_units(t)
    return v.where("price_text is not null").select("arrival", units.alias("units"), F.when(units.isNotNull(), X.decimal_scale(t).cast("long")).alias("scale"))


@query(f"select arrival, case when {EXACT} then price_text end as again, {EXACT} as same from v where price_text is not null")
def exact_decimal_roundtrip(v: DataFrame) -> DataFrame:
    t = F.col("price_text")
    rows = v.where("price_text is not null").select("arrival", "price_text", X.decimal_text(X.decimal_units(t), X.decimal_scale(t)).alias("again"))
    return rows.select("arrival", "again", F.coalesce(F.col("again") == F.col("price_text"), F.lit(False)).alias("same"))


@query("select arrival, cast(json_extract_string(props, '$.k') as bigint) as k, json_valid(props) as valid from v")
def props_member(v: DataFrame) -> DataFrame:
    body = F.from_json("props", "k bigint")
    return v.select("arrival", body["k"].alias("k"), F.get_json_object("props", "$").isNotNull().alias("valid"))


FRAMES = """fr as (select arrival, bad, coalesce(etype, '') as type, channel, product, coalesce(side, '') as side, exch_us, seq, coalesce(price_text, '') as price_text, coalesce(size_text, '') as size_text,
  case when bad in (3, 4) or price_text is null then 0.0 else cast(price_text as double) end as price, case when bad in (3, 4) or size_text is null then 0.0 else cast(size_text as double) end as size,
  case bad when 1 then 'decode frame: no JSON object of the expected types' when 2 then 'decode frame: no JSON object of the expected types' when 3 then 'parse time "yesterday"' when 4 then 'parse price "n/a"' else '' end as decode_error,
  case when etype = 'error' then 'no feed: ' || product else '' end as error_text from v where kind = 'message')"""


@query(f"select * exclude (bad) from (with {FRAMES} select * from fr)")
def decode_frames(v: DataFrame) -> DataFrame:
    """Every frame decoded strictly from its JSON text; the SQL has the fields that the text was made from."""
    from seqlake.functions.frames import decoded

    got = decoded(v.where("kind = 'message'").select("arrival", "raw"))
    return got.select("arrival", "type", "channel", "product", "side", F.expr("exch_ns div 1000").alias("exch_us"), F.col("seq").cast("long").alias("seq"), "price_text", "size_text", "price", "size", "decode_error", "error_text")


@query("select p as pass, arrival, product, recv_us + p * (s.span + 1) as recv_us, cast(seq + p * s.seqs as bigint) as seq from v, range(0, 3) t(p), (select arg_max(recv_us, arrival) - arg_min(recv_us, arrival) as span, max(seq) - min(seq) + 1 as seqs from v where kind = 'message') s where kind = 'message'")
def load_amplified(v: DataFrame) -> DataFrame:
    return A.amplified(v, 3).withColumn("pass", F.col("pass").cast("long"))


@query("select count(*) as messages, arg_max(recv_us, arrival) - arg_min(recv_us, arrival) as span_us, cast(max(seq) - min(seq) + 1 as bigint) as seq_span, count(*) * 1e6 / (arg_max(recv_us, arrival) - arg_min(recv_us, arrival)) as rate from v where kind = 'message'")
def load_stats(v: DataFrame) -> DataFrame:
    return A.load_stats(v)


@query("select grp, cast(count(*) filter (d) as bigint) as dropped, min(arrival) filter (not d) as next_arrival, min(recv_us) filter (d) as first_us from (select *, coalesce(cast(sum(case when d then 0 else 1 end) over (order by arrival rows between unbounded preceding and 1 preceding) as bigint), 0) as grp from (select *, (arrival // 7) % 5 = 3 as d from v)) group by grp having count(*) filter (d) > 0")
def drop_accounting(v: DataFrame) -> DataFrame:
    return S.drop_runs(v, F.expr("(arrival div 7) % 5 = 3"))


@query("select etype, min(arrival) as first_arrival, count(*) as n from v where kind = 'message' group by etype")
def type_dictionary(v: DataFrame) -> DataFrame:
    return v.where("kind = 'message'").groupBy("etype").agg(F.min("arrival").alias("first_arrival"), F.count("*").alias("n"))


@query(metrics_sql("select slot, (messages - lag(messages) over (order by slot)) / 3600.0 as rate_change from mt"))
def instant_rate(v: DataFrame) -> DataFrame:
    return metrics(v).select("slot", ((F.col("messages") - F.lag("messages").over(Window.orderBy("slot"))) / F.lit(3600.0)).alias("rate_change"))


@query(metrics_sql("select slot, cast(case when messages <= 0 then 0 when messages >= m then 7 else least(7, floor(messages * 7 / m) + 1) end as bigint) as level from mt, (select max(messages) as m from mt)"))
def ramp_levels(v: DataFrame) -> DataFrame:
    rows = metrics(v)
    return rows.crossJoin(F.broadcast(rows.agg(F.max("messages").alias("m")))).select("slot", X.ramp(F.col("messages"), F.col("m")).alias("level"))


@query("select arrival, recv_us - lag(recv_us) over (partition by file_idx order by rec) as recv_delta, seq - last_value(seq ignore nulls) over (partition by file_idx order by rec rows between unbounded preceding and 1 preceding) as seq_delta from v")
def delta_encode(v: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_idx").orderBy("rec")
    before = F.last("seq", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return v.select("arrival", (F.col("recv_us") - F.lag("recv_us").over(w)).alias("recv_delta"), (F.col("seq") - before).alias("seq_delta"))


#: A time in microseconds as RFC 3339; all digits of its fraction, less the zeros at its end.
def time_sql(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(make_timestamp({us}), '.%f'), '0'), '.') || 'Z'"


NUMBER = "case when {0} = 0 then '0' else regexp_replace(cast({0} as varchar), '\\.0$', '') end"
CANONICAL = f"""ln as (select rp.i, '{{"i":' || rp.i || ',"kind":"' || v.kind || '","file":"' || v.file_idx || '","rec":' || v.rec || ',"recv":"' || {time_sql("v.recv_us")} || '",' ||
  case v.kind when 'gap' then '"expected":' || expected || ',"got":' || got || ',"missing":' || (got - expected) || case when dropped > 0 then ',"dropped":' || dropped else '' end
  when 'reseed' then '"reason":"' || reason || '","opening":' || case when rp.opening then 'true' else 'false' end
  else '"exchange_time":"' || coalesce({time_sql("fr.exch_us")}, '') || '","channel":"' || fr.channel || '","type":"' || fr.type || '","product":"' || fr.product || '","sequence":' || coalesce(cast(fr.seq as varchar), 'null') ||
    ',"side":"' || fr.side || '","price":' || {NUMBER.format("fr.price")} || ',"size":' || {NUMBER.format("fr.size")} || case when decode_error <> '' then ',"decode_error":"' || replace(decode_error, '"', '\\"') || '"' else '' end ||
    case when fr.bad = 1 then ',"raw_b64":"' || to_base64(encode(raw)) || '"' else ',"raw":' || replace(replace(replace(raw, ', ', ','), ': ', ':'), 'nofeed', 'no feed') end end || '}}' as line
  from rp join v using (arrival) left join fr using (arrival))"""


def canonical_sql(select: str) -> str:
    return f"select * from (with {FRAMES}, {CANONICAL} {select})"


@query(canonical_sql("select i, line from ln"))
def canonical_lines(v: DataFrame) -> DataFrame:
    """Every record as its canonical line, decoded from its frame; the SQL puts the lines together from the feed's fields."""
    from seqlake.operators.canonical import lines

    return lines(R.ordered(v))


@query(canonical_sql("select i, sha256(line) as sha256 from ln"))
def canonical_digest(v: DataFrame) -> DataFrame:
    """A digest of every line, to compare replays without bringing them to the driver."""
    from seqlake.operators.canonical import lines

    return lines(R.ordered(v)).select("i", F.sha2("line", 256).alias("sha256"))


WINDOW = f"(({{0}}.recv_us + 62135596800000000) // {HALF_DAY})"
GREEDY = f"""bs as (select file_idx, cast(0 as bigint) as batch, cast(0 as bigint) as s from v group by file_idx
  union all select bs.file_idx, bs.batch + 1, min(n.rec) from bs join v f on f.file_idx = bs.file_idx and f.rec = bs.s join v n on n.file_idx = bs.file_idx and n.rec > bs.s
    and (n.rec >= bs.s + 100 or n.recv_us - f.recv_us >= 21600000000 or {WINDOW.format("n")} <> {WINDOW.format("f")}) group by bs.file_idx, bs.batch),
  rg as (select *, coalesce(lead(s) over (partition by file_idx order by batch), 9223372036854775807) as e from bs)"""


@query(f"select * from (with recursive {GREEDY} select rg.file_idx, rg.batch, count(*) as n, min(recv_us) as first_us, max(recv_us) as last_us, bool_or(kind = 'gap') as has_gap, bool_or(kind = 'reseed') as has_reseed from rg join v on v.file_idx = rg.file_idx and v.rec >= rg.s and v.rec < rg.e group by all)")
def batch_footers(v: DataFrame) -> DataFrame:
    """Greedy batches of at most 100 rows, six hours and one half-day window; the SQL goes from one batch's start to the next."""
    from seqlake.operators.batches import batched, footers

    return footers(batched(v.withColumn("bytes", F.octet_length(F.coalesce("raw", F.lit("")))), "bytes", age_us=21_600_000_000, rows=100, window_us=HALF_DAY))
