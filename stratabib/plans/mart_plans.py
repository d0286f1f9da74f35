"""Queries over sinks' partitioning, figure tables, samples and event series."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators import marts
from stratabib.operators import topics as K
from stratabib.plans import sql as S
from stratabib.runtime import shared_dir, table
from stratabib.sources import delimited as D
from stratabib.streaming import windows as V

MERGED = "merge_three_db"


def row_partition_ids(spark, d):
    """Part of each record when written a thousand rows a file."""
    return D.part_ids(table(spark, d, MERGED).select("rec_id"), ["rec_id"], 1000)


SQL_PARTS = f"SELECT rec_id, CAST(floor((row_number() OVER (ORDER BY rec_id) - 1) / 1000) AS BIGINT) + 1 AS part FROM {MERGED}"


def csv_round_trip(spark, d):
    """Records written as delimited text and read back, line breaks, quotes and commas included."""
    import uuid

    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    cols = ["rec_id", "title_en", "author", "institution", "keywords_en"]
    D.write_table(table(spark, d, MERGED).select("rec_id", *(T.text_or_empty(c).alias(c) for c in cols[1:])), path)
    return D.read_table(spark, path, encoding="utf-8", columns=cols, line_breaks=True).withColumn("rec_id", F.col("rec_id").cast("bigint"))


SQL_ROUND = f"SELECT rec_id, {', '.join(f'{S.text(c)} AS {c}' for c in ('title_en', 'author', 'institution', 'keywords_en'))} FROM {MERGED}"


def seeded_sample(spark, d):
    """Five hundred documents in seeded order; sampling is the feature."""
    return K.seeded_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 500)


def top_cited(spark, d):
    """The three most cited records of each journal."""
    rows = table(spark, d, MERGED).select("rec_id", T.text_or_empty("journal_en").alias("journal"), T.to_float("cited_count").alias("cited")).filter("journal <> ''")
    return marts.top_per_group(rows, "journal", [F.desc("cited"), "rec_id"], 3)


SQL_CITED = f"SELECT rec_id, {S.text('journal_en')} AS journal, {S.number('cited_count')} AS cited, row_number() OVER (PARTITION BY {S.text('journal_en')} ORDER BY {S.number('cited_count')} DESC, rec_id) AS place FROM {MERGED} WHERE {S.text('journal_en')} <> '' QUALIFY place <= 3"


def weekly_index(spark, d):
    """Weekly mean and variance of events and five weeks' lags."""
    return V.weekly(table(spark, d, "events"))


SQL_WEEKLY = """WITH g AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n, round(avg(value), 6) AS mean_value, round(var_pop(value), 6) AS var_value FROM events GROUP BY 1)
SELECT *, """ + ", ".join(f"lag(mean_value, {k}) OVER (ORDER BY week) AS lag_{k}" for k in range(1, 6)) + " FROM g"


def events_windowed(spark, d):
    """Events per hour and type."""
    return V.windowed(table(spark, d, "events"), "1 hour")


SQL_WINDOWED = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _streamed(spark, d, make):
    """What a stream of events writes under a watermark: its rows alone, when events after the last have closed all windows."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0] or datetime(2000, 1, 1)
    closing = spark.range(1).select(*(F.lit(None).cast(t).alias(c) for c, t in events.dtypes))
    closing.limit(0).write.parquet(f"{base}/closing")
    stream = V.stream_of(spark, f"{d}/[e]vents.parquet", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    made = make(stream.unionByName(V.stream_of(spark, f"{base}/closing", events.schema)))
    V.run_to_table(made, f"{base}/out", f"{base}/checkpoint")
    for k in (1, 2):  # the first moves the watermark on, with the second what it closed is written
        closing.withColumn("ts", F.lit(last + timedelta(days=100 * k))).write.mode("append").parquet(f"{base}/closing")
        V.run_to_table(made, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(made.schema).parquet(f"{base}/out")


def events_streamed(spark, d):
    """Events per hour and type from a stream with a watermark."""
    return _streamed(spark, d, lambda s: V.windowed(s, "1 hour", late="60 days")).filter("event_type is not null")


def events_sliding(spark, d):
    """Events per hour and type every half hour, from a stream."""
    return _streamed(spark, d, lambda s: V.windowed(s, "1 hour", "30 minutes", late="60 days")).filter("event_type is not null")


SQL_SLIDING = """WITH h AS (SELECT to_timestamp(CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800)::TIMESTAMP AS s, event_type, value FROM events),
w AS (SELECT s AS window_start, event_type, value FROM h UNION ALL SELECT s - INTERVAL 30 MINUTE, event_type, value FROM h)
SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2"""


def sessions_streamed(spark, d):
    """Sessions of users from a stream."""
    return _streamed(spark, d, lambda s: V.sessions(s, "30 minutes", late="60 days")).filter("user_id is not null")


def user_sessions(spark, d):
    """Sessions of users with gaps under half an hour."""
    return V.sessions(table(spark, d, "events"), "30 minutes")


SQL_SESSIONS = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS session_start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""

_ALL = {
    "row_partition_ids": (row_partition_ids, SQL_PARTS), "csv_round_trip": (csv_round_trip, SQL_ROUND), "seeded_sample": (seeded_sample, ""), "top_cited": (top_cited, SQL_CITED), "weekly_index": (weekly_index, SQL_WEEKLY),
    "events_windowed": (events_windowed, SQL_WINDOWED), "events_streamed": (events_streamed, SQL_WINDOWED), "events_sliding": (events_sliding, SQL_SLIDING), "sessions_streamed": (sessions_streamed, SQL_SESSIONS), "user_sessions": (user_sessions, SQL_SESSIONS),
}


def queries():
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql():
    return {k: v[1] for k, v in _ALL.items() if v[1]}
