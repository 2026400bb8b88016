"""Registered queries of the scalar functions that people read, and of codes and checksums, over the feed's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions import bits as B
from seqlake.functions import text as T
from seqlake.functions.scalars import nanoseconds, ramp, time_text
from seqlake.operators import replay as R
from seqlake.plans.registry import metrics, metrics_sql, query, time_sql

BYTES_SQL = "case " + " ".join(f"when n >= {1024**i} then case when n / {float(1024**i)} < 10 then printf('%.2f', n / {float(1024**i)}) when n / {float(1024**i)} < 100 then printf('%.1f', n / {float(1024**i)}) else printf('%.0f', n / {float(1024**i)}) end || ' {u}'" for i, u in list(enumerate(T.UNITS))[:0:-1]) + " else n || ' B' end"


def cubed(a: Column) -> Column:
    """The cube, exact up to places of 1e12 (a long holds those below 2,097,152)."""
    a = a.cast("decimal(12,0)")
    return (a * a * a).cast("decimal(36,0)")


@query(f"select arrival, format('{{:,}}', n) as count, {BYTES_SQL} as bytes, case when r <= 0 then '0/s' when r < 10 then printf('%.1f/s', r) else printf('%.0f/s', r) end as rate, case when r >= 1e6 then printf('%.2fM', r / 1e6) when r >= 1e3 then printf('%.1fk', r / 1e3) else printf('%.0f', r) end as quantity, case when f = 0 then '0' else printf('%.1f%%', f * 100) end as share from (select arrival, arrival * arrival * arrival * 37 as n, arrival * 13 + 0.25 as r, (arrival % 65) / 64.0 as f from v)")
def figures_text(v: DataFrame) -> DataFrame:
    """Counts, bytes, rates, quantities and shares as text."""
    a = F.col("arrival")
    n, r, f = cubed(a) * 37, a * 13 + F.lit(0.25), (a % 65) / F.lit(64.0)
    return v.select("arrival", T.count_text(n).alias("count"), T.bytes_text(n).alias("bytes"), T.rate_text(r).alias("rate"), T.quantity_text(r).alias("quantity"), T.percent_text(f).alias("share"))


PLAIN = r"regexp_replace(printf('%.{d}f', {x}), '\.?0+$', '')"
ROUND = "(case when ns >= 1000000000 then (ns + 500000) // 1000000 * 1000000 when ns >= 1000000 then (ns + 500) // 1000 * 1000 when ns >= 1000 then (ns + 5) // 10 * 10 else ns end)"


@query(f"select arrival, (ns // 3600000000000) || ':' || lpad(cast(ns // 60000000000 % 60 as varchar), 2, '0') || ':' || lpad(cast(ns // 1000000000 % 60 as varchar), 2, '0') as elapsed, r as rounded, case when r >= 1000000000 then {PLAIN.format(d=3, x='r / 1e9')} || 's' when r >= 1000000 then {PLAIN.format(d=3, x='r / 1e6')} || 'ms' when r >= 1000 then {PLAIN.format(d=2, x='r / 1e3')} || 'µs' when r = 0 then '0s' else r || 'ns' end as short from (select *, {ROUND} as r from (select arrival, arrival * arrival * arrival % 59999999989 as ns from v))")
def durations_text(v: DataFrame) -> DataFrame:
    """Durations as a clock, rounded, and short."""
    # Cubes of places from 2,097,152 on are no longs: they are multiplied as decimals, from the remainders.
    m = F.lit(59_999_999_989).cast("decimal(11,0)")
    a = (F.col("arrival").cast("decimal(19,0)") % m).cast("decimal(11,0)")
    ns = ((a * a % m).cast("decimal(11,0)") * a % m).cast("long")
    return v.select("arrival", T.elapsed_text(ns).alias("elapsed"), T.latency_rounded(ns).alias("rounded"), T.short_text(ns).alias("short"))


@query("select arrival, case when length(t) <= 9 then rpad(t, 9, ' ') else substr(t, 1, 8) || '…' end as \"left\", case when length(t) <= 6 then lpad(t, 6, ' ') else substr(t, 1, 5) || '…' end as \"right\", substr(t, 1, 1) as one from (select arrival, coalesce(etype, kind) || arrival % 7 as t from v)")
def padded_cells(v: DataFrame) -> DataFrame:
    t = F.concat(F.coalesce(F.when(F.col("etype").isNotNull(), F.col("etype")), F.col("kind")), (F.col("arrival") % 7).cast("string"))
    return v.select("arrival", T.padded(t, 9).alias("left"), T.padded_left(t, 6).alias("right"), T.truncated(t, 1).alias("one"))


@query("select arrival, strftime(make_timestamp(coalesce(exch_us, recv_us)), '%H:%M:%S.%g') as clock, 'symbol=' || product || '/hour=' || arrival % 24 || '/f.tape' as label from v")
def clock_labels(v: DataFrame) -> DataFrame:
    path = F.concat(F.lit("v1/symbol="), "product", F.lit("/hour="), (F.col("arrival") % 24).cast("string"), F.lit("/f.tape"))
    return v.select("arrival", T.clock(F.col("exch_us"), F.col("recv_us")).alias("clock"), T.file_label(path).alias("label"))


METER_SQL = "case when most <= 0 or messages <= 0 then 0 when messages >= most then 30 else greatest(floor(messages / most * 30), 1) end"
LEVEL_SQL = "cast(case when messages <= 0 then 0 when messages >= most then 7 else least(7, floor(messages * 7 / most) + 1) end as int)"


@query(metrics_sql(f"select slot, repeat('#', cast({METER_SQL} as int)) || repeat('-', cast(30 - {METER_SQL} as int)) as meter, substr('▁▂▃▄▅▆▇█', {LEVEL_SQL} + 1, 1) as glyph from mt, (select max(messages) as most from mt)"))
def meters(v: DataFrame) -> DataFrame:
    rows = metrics(v)
    rows = rows.join(F.broadcast(rows.agg(F.max("messages").alias("most"))))  # one row
    return rows.select("slot", T.meter(F.col("messages"), F.col("most"), 30).alias("meter"), T.glyph(ramp(F.col("messages"), F.col("most")), unicode=True).alias("glyph"))


@query(metrics_sql(f"select string_agg(substr('_.-~=+*#', {LEVEL_SQL} + 1, 1), '' order by slot) as line, any_value(most) as most from (select *, max(messages) over () as most from (select * from mt order by slot desc limit 48))"))
def sparkline(v: DataFrame) -> DataFrame:
    """The last 48 intervals as one line, scaled to the largest of them."""
    last = metrics(v).orderBy(F.desc("slot")).limit(48)
    scaled = last.withColumn("most", F.max("messages").over(Window.partitionBy(F.lit(0))))  # 48 rows
    cells = F.array_sort(F.collect_list(F.struct("slot", T.glyph(ramp(F.col("messages"), F.col("most"))).alias("g"))))
    return scaled.agg(F.array_join(F.transform(cells, lambda x: x["g"]), "").alias("line"), F.first("most").alias("most"))


@query("select arrival, case when x >= 0 then 2 * x else -2 * x - 1 end as code, x as back from (select arrival, (arrival - 5000) * 7919 as x from v)")
def zigzag_codes(v: DataFrame) -> DataFrame:
    rows = v.select("arrival", B.zigzag((F.col("arrival") - 5000) * 7919).alias("code"))
    return rows.withColumn("back", B.unzigzag(F.col("code")))


@query("select arrival, to_base64(encode(raw)) as b64, octet_length(encode(raw)) as bytes from v where kind = 'message'")
def frame_base64(v: DataFrame) -> DataFrame:
    raw = F.col("raw").cast("binary")
    return v.where("kind = 'message'").select("arrival", B.base64_line(raw).alias("b64"), F.octet_length(raw).cast("long").alias("bytes"))


@query()
def frame_checksums(v: DataFrame) -> DataFrame:
    """CRC-32C of every frame; DuckDB has no such function, the tests have a bit-by-bit one."""
    return v.where("kind = 'message'").select("arrival", B.crc32c_of(F.col("raw").cast("binary")).alias("crc32c"))


@query("select arrival, case when seq is null then raw else replace(raw, '\"sequence\":' || seq, '\"sequence\":' || (seq + 1000)) end as raw, case when seq is null then null else instr(raw, '\"sequence\":') + 10 end as at from v where kind = 'message'")
def sequence_rewrite(v: DataFrame) -> DataFrame:
    """Frames whose sequence number is 1000 higher, and the byte where it stands."""
    from seqlake.functions.scalars import sequence_at, with_sequence_advanced

    raw = F.col("raw")
    return v.where("kind = 'message'").select("arrival", with_sequence_advanced(raw, F.lit(1000)).alias("raw"), sequence_at(raw).alias("at"))


@query(f"select arrival, {time_sql('exch_us')} as again, exch_us * 1000 as ns from v where exch_us is not null")
def time_roundtrip(v: DataFrame) -> DataFrame:
    """Exchange times as text and back, also from another zone."""
    text = time_text(F.col("exch_us") * 1000)
    zoned = F.concat(F.date_format(F.timestamp_micros(F.col("exch_us") + 19_800_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    rows = v.where("exch_us is not null").select("arrival", text.alias("again"), nanoseconds(text).alias("ns"), nanoseconds(zoned).alias("zoned"))
    return rows.select("arrival", "again", F.when(F.col("ns") == F.col("zoned"), F.col("ns")).alias("ns"))


CLOCK = "strftime(make_timestamp({0}), '%H:%M:%S.%g')"
PRETTY = (
    "case when length({0}) >= 96 then case when length(trim({0})) <= 96 then trim({0}) else substr(trim({0}), 1, 95) || '…' end else repeat('=', (96 - length({0})) // 2) || {0} || repeat('=', 96 - (96 - length({0})) // 2 - length({0})) end"
)
CELL = "case when length({0}) <= {1} then {2}pad({0}, {1}, ' ') else substr({0}, 1, {1} - 1) || '…' end"
CELLS = " || ' ' || ".join(CELL.format(f"coalesce(cast({c} as varchar), '')", w, "l" if c in ("price_text", "size_text") else "r") for c, w in (("v.channel", 12), ("etype", 13), ("v.seq", 13), ("side", 4), ("price_text", 11), ("size_text", 12)))
SAID = f"""case when v.kind = 'gap' and dropped > 0 then ' GAP  capture dropped ' || format('{{:,}}', dropped) || ' frames  at ' || {CLOCK.format('v.recv_us')} || ' '
  when v.kind = 'gap' then ' GAP  ' || format('{{:,}}', got - expected) || ' messages missing  expected ' || format('{{:,}}', expected) || ', got ' || format('{{:,}}', got) || '  at ' || {CLOCK.format('v.recv_us')} || ' '
  when rp.opening then ' window opens  ' || reason || '  at ' || {CLOCK.format('v.recv_us')} || ' ' else ' RESEED  the book was rebuilt here  ' || reason || '  at ' || {CLOCK.format('v.recv_us')} || ' ' end"""


@query(f"select i, case when kind = 'message' then rtrim(cells) else {PRETTY.format('said')} end as line from (select rp.i, v.kind, {CLOCK.format('coalesce(v.exch_us, v.recv_us)')} || ' ' || {CELLS} as cells, {SAID} as said from rp join v using (arrival))")
def pretty_lines(v: DataFrame) -> DataFrame:
    """The replay as a person reads it."""
    return R.ordered(v).select("i", T.pretty(96).alias("line"))


@query(f"select i, case when v.kind = 'gap' and dropped > 0 then 'gap at file ' || v.file_idx || ' record ' || v.rec || ': capture dropped ' || dropped || ' frames at ' when v.kind = 'gap' then 'gap at file ' || v.file_idx || ' record ' || v.rec || ': expected sequence ' || expected || ', got ' || got || ' (' || (got - expected) || ' missing) at ' else 'reseed at file ' || v.file_idx || ' record ' || v.rec || ': ' || reason || ' at ' end || {time_sql('v.recv_us')} as text from rp join v using (arrival) where disc")
def discontinuity_texts(v: DataFrame) -> DataFrame:
    return R.ordered(v).where("disc").select("i", T.discontinuity_text(time_text(F.col("recv_us") * 1000)).alias("text"))
