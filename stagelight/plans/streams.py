"""Streaming plans, each held against the batch answer in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagelight.plans.registry import plan
from stagelight.sources.star import Star
from stagelight.sources.upserts import KeyedTable
from stagelight.streaming import replay as R


def _events(s: Star) -> DataFrame:
    return R.arriving(s.spark, f"{s.sf_dir}/events.parquet")


@plan("stream_daily_counts", "select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily_counts(s: Star) -> DataFrame:
    """Tumbling windows; each batch writes the windows that it changed, and closed ones leave the state."""
    out = R.run_to_end(R.daily_counts(_events(s)), "update", R.append)
    return R.newest(s.spark, out, "w", "event_type").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@plan("stream_sliding_counts", """
select time_bucket(interval 30 minute, ts) - to_minutes(30 * k) as starts, user_id, count(*) as n from events, (values (0), (1)) v(k) group by 1, 2
""")  # fmt: skip
def stream_sliding_counts(s: Star) -> DataFrame:
    """Windows of an hour, every half; each batch writes those that it changed, and closed ones leave the state."""
    out = R.run_to_end(R.sliding_counts(_events(s), "1 hour", "30 minutes"), "update", R.append)
    return R.newest(s.spark, out, "w", "user_id").select(F.col("w.start").cast("timestamp_ntz").alias("starts"), "user_id", "n")


@plan("stream_first_seen", "select distinct user_id, event_type from events")
def stream_first_seen(s: Star) -> DataFrame:
    """The first of each key within the watermark."""
    out = R.run_to_end(R.first_seen(_events(s), ["user_id", "event_type"]), "append", R.append)
    return s.spark.read.parquet(out).select("user_id", "event_type")


_LIMIT = """
with recursive q as (select user_id, epoch_us(ts) as micros, row_number() over (partition by user_id order by ts) as r from events),
t(user_id, r, micros, opened, n) as (select user_id, r, micros, micros, 1 from q where r = 1 union all
 select q.user_id, q.r, q.micros, case when q.micros >= t.opened + 86400000000 then q.micros else t.opened end, case when q.micros >= t.opened + 86400000000 then 1 else t.n + 1 end from t join q on q.user_id = t.user_id and q.r = t.r + 1)
select user_id, micros, n::bigint as n, n <= 2 as allowed from t
"""


@plan("stream_fixed_window_limit", _LIMIT)
def stream_fixed_window_limit(s: Star) -> DataFrame:
    """Windows opened by a key's first request, in keyed state that ends with the window."""
    out = R.run_to_end(R.limited(_events(s), "user_id", "ts", 86_400, 2), "append", R.append)
    return s.spark.read.parquet(out).select(F.col("key").alias("user_id"), F.col("at").alias("micros"), "n", "allowed")


@plan("fixed_window_limit", _LIMIT)
def fixed_window_limit(s: Star) -> DataFrame:
    """Z9 in batch: one pass over each key's sorted rows with a window and a count, whatever their number."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, opened, n = None, 0, 0
        for pdf in batches:
            counts = []
            for u, t in zip(pdf["user_id"], pdf["micros"], strict=True):
                if u != user or t >= opened + 86_400_000_000:
                    user, opened, n = u, t, 0
                n += 1
                counts.append(n)
            yield pdf.assign(n=counts, allowed=[c <= 2 for c in counts])

    rows = s.table("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "micros").mapInPandas(walk, "user_id long, micros long, n long, allowed boolean")


@plan("sliding_window_limit", """
select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as n from events
""")  # fmt: skip
def sliding_window_limit(s: Star) -> DataFrame:
    """Z8 in batch: requests within the last six hours, by a range frame."""
    back = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3_600_000_000, 0)
    return s.table("events").select("event_id", "user_id", F.count("*").over(back).alias("n"))


@plan("stream_latest", "select user_id, event_type, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def stream_latest(s: Star) -> DataFrame:
    """A sink that holds the newest item of each key; each batch writes the parts of the table that its keys are in."""
    items, keys = _events(s).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"]
    out = R.run_to_end(items, "append", R.keep_latest(items, keys, "ts", "event_id"))
    return KeyedTable(s.spark, out, keys).rows(items)
