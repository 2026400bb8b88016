"""The ``events`` table seen as a recorded feed: frames as JSON text, with gaps, reconnects, reseeds and bad frames put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One text for both engines: {EVENTS} is the table, {US} an event's time in microseconds, {STR} the string type.
#: ``bad``: 1 the frame is cut off, 2 its price is a number, 3 its time is none, 4 its price is none.
EVENTS = """
  select event_id as arrival, {US} as ts_us, event_type, value, props, event_type in ('click', 'purchase', 'signup') as trade,
         'P' || cast(user_id % 4 as {STR}) as account,
         case when event_id % 997 = 0 then 'reseed' when event_id % 1499 = 700 then 'gap' else 'message' end as kind,
         case when event_id % 613 <> 5 or event_id % 4 = 3 and event_type not in ('click', 'purchase', 'signup') then 0 else 1 + event_id % 4 end as bad,
         cast(floor(event_id / 512) as bigint) as file_idx, event_id % 512 as rec,
         case when event_type = 'purchase' and event_id % 50 = 0 then 'last_match' when event_type in ('click', 'purchase', 'signup') then 'match'
              when event_type = 'view' and event_id % 89 = 0 then 'snapshot' when event_type = 'view' then 'l2update'
              when event_id % 3 = 0 then 'subscriptions' when event_id % 3 = 1 then 'error' else 'heartbeat' end as kind_of_frame
  from {EVENTS}
"""
FLAGS = "select *, kind = 'message' and trade and bad not in (1, 2) as has_seq, kind = 'message' and event_type <> 'error' and bad not in (1, 2, 3) as has_exch"
#: {N} numbers a product's sequenced messages from 1 on.
NUMBERS = """
  select *, case when has_seq then {N} + 5 * cast(floor(arrival / 2000) as bigint) + 40 * cast(floor(arrival / 997) as bigint)
          - case when arrival % 641 = 0 then 3 else 0 end - case when arrival > 997 and arrival % 997 between 1 and 2 then 60 else 0 end end as seq,
        case when has_exch then ts_us + ((arrival * 7919) % 11 - 5) * 600000000 end as exch_us,
        case when has_seq then case when bad = 4 then 'n/a' when arrival % 211 = 9 then cast(cast(value as decimal(18,2)) as {STR}) || 'e0'
             when arrival % 223 = 3 then '0' || cast(cast(value as decimal(18,2)) as {STR}) else cast(cast(value as decimal(18,2)) as {STR}) end end as price_text,
        case when has_seq then cast(cast(floor((arrival % 400 + 1) / 4) as bigint) as {STR}) || case (arrival + 1) % 4 when 0 then '.00' when 1 then '.25' when 2 then '.50' else '.75' end end as size_text,
        case when has_seq then case when arrival % 101 = 0 then 'cross' when arrival % 2 = 0 then 'buy' else 'sell' end end as side
"""
RECORDS = """
select arrival, file_idx, rec, kind, case when kind = 'message' then bad else 0 end as bad,
       case when kind = 'message' and bad not in (1, 2) then account else '' end as product,
       case when kind <> 'message' then null when bad in (1, 2) then '' else kind_of_frame end as etype,
       ts_us as recv_us, exch_us, cast(seq as bigint) as seq,
       case when kind <> 'message' then 'control' when bad in (1, 2) then '' when trade then 'matches' when event_type = 'view' then 'level2_batch' else 'control' end as channel,
       side, price_text, size_text, value, props,
       case when kind <> 'message' then null when bad = 1 then chr(123) || '"type":"' || kind_of_frame || '"' else
         chr(123) || '"type": "' || kind_of_frame || '", "product_id": "' || account || '"' || case when has_seq then ',"sequence":' || cast(cast(seq as bigint) as {STR}) else '' end
         || case when bad = 3 then ',"time":"yesterday"' when has_exch then ',"time":"' || {TIME} || '"' else '' end
         || case when has_seq then ',"side":"' || side || '","price":"' || price_text || '","size":"' || size_text || '"' when bad = 2 then ',"price":12.5' else '' end
         || case when kind_of_frame = 'error' then ',"message":"no feed","reason":"' || account || '"' else '' end || ', "props": ' || props || chr(125) end as raw,
       case when kind = 'gap' then case when arrival % 2 = 1 then 0 else 100 + arrival end end as expected,
       case when kind = 'gap' then case when arrival % 2 = 1 then 0 else 100 + arrival + arrival % 90 end end as got,
       case when kind = 'gap' then case when arrival % 2 = 1 then arrival % 13 + 1 else 0 end end as dropped,
       case when kind = 'reseed' then case when arrival = 0 then 'connected' else 'again after ' || cast(arrival as {STR}) end end as reason
"""


def view_sql() -> str:
    """The view for DuckDB."""
    names = {"EVENTS": "events", "US": "epoch_us(ts)", "STR": "varchar", "N": "row_number() over (partition by account, has_seq order by arrival)", "TIME": "strftime(make_timestamp(exch_us), '%Y-%m-%dT%H:%M:%S.%fZ')"}
    parts = [part.format(**names) for part in (EVENTS, FLAGS, NUMBERS, RECORDS)]
    return f"with e0 as ({parts[0]}), e1 as ({parts[1]} from e0), e2 as ({parts[2]} from e1) {parts[3]} from e2"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's records, dealt by ``file_idx``.

    Numbers run over all files of a product: rows are numbered in their file, and one row for each file says how many were
    before, so that no product is one task.
    """
    names = {"EVENTS": "{events}", "US": "unix_micros(cast(ts as timestamp))", "STR": "string", "N": "n", "TIME": "date_format(timestamp_micros(exch_us), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"}
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    flagged = spark.sql(f"{FLAGS} from ({EVENTS.format(**names)})", events=events)
    accounts = [f"P{i}" for i in range(4)]
    per_file = flagged.groupBy("file_idx").agg(*[F.sum(F.expr(f"cast(has_seq and account = '{a}' as long)")).alias(a) for a in accounts])
    earlier = Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each file
    before = per_file.select("file_idx", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(a) for a in accounts])
    here = F.row_number().over(Window.partitionBy("file_idx", "account", "has_seq").orderBy("rec"))
    own = F.coalesce(*[F.when(F.col("account") == a, F.col(a)) for a in accounts])
    numbered = flagged.repartition("file_idx").withColumn("n", here).join(before, "file_idx").withColumn("n", F.col("n") + own).drop(*accounts)
    return spark.sql(f"{RECORDS.format(**names)} from ({NUMBERS.format(**names)} from {{t}})", t=numbered)
