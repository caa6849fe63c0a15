"""Recordings, loudness and speech derived from an events table.

The derivation has no meaning of its own; it gives every operator something to
do. Times are multiples of 1/8 s, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    scale = 120 + 60 * (F.col("video_id") % 5)
    return events.withColumn("video_id", F.col("user_id") % 32).withColumn("t", F.floor(us / 1e6 / scale * 8) / 8).select("video_id", "event_id", "value", "t")


def video(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 32).alias("video_id")).distinct()
    path = F.when(F.col("video_id") % 9 == 4, F.format_string("/v/it's_%d.mp4", "video_id")).otherwise(F.format_string("/v/rec_%d.mp4", "video_id"))
    duration = F.lit(2592000.0) / (120 + 60 * (F.col("video_id") % 5)) - (F.col("video_id") % 11) * 0.625
    return ids.select("video_id", path.alias("path"), duration.alias("duration_s"))


def speech(spark: SparkSession, sf_dir: str, some_silent: bool = False) -> DataFrame:
    """Ordered and disjoint; with ``some_silent`` videos of id 7 modulo 8 have none."""
    by = Window.partitionBy("video_id").orderBy("t", "event_id")
    rows = _timed(spark, sf_dir).select(
        "video_id", (F.row_number().over(by) - 1).alias("seg_idx"), F.col("t").alias("speech_start"),
        F.least(F.col("t") + 1 + F.floor(F.col("value") * 2) / 8, F.lead("t").over(by)).alias("speech_end"),
    )
    return rows.filter("video_id % 8 <> 7") if some_silent else rows


def overlapping_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``speech``, but every segment of videos of id 1 modulo 3 lasts twelve seconds longer."""
    longer = F.when(F.col("video_id") % 3 == 1, F.col("speech_end") + 12).otherwise(F.col("speech_end"))
    return speech(spark, sf_dir).withColumn("speech_end", longer)


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _timed(spark, sf_dir).groupBy("video_id", (F.floor(F.col("t") / 10) * 10.0).alias("chunk_start")).agg(
        F.least(F.lit(0.0), F.lit(-50.0) + F.floor(F.max("value") * 5) / 10).alias("max_db"), F.max("event_id").alias("last")
    )
    log = F.format_string("mean_volume: %.1f dB max_volume: %.1f dB", F.col("max_db") - F.col("last") % 13, "max_db")
    unheard = (F.col("chunk_start") / 10) % 17 == 0
    return cells.select("video_id", "chunk_start", F.when(unheard, "mean_volume: -inf dB max_volume: -inf dB").otherwise(log).alias("log"))


#: The same tables as DuckDB expressions over ``events``.
SQL = {
    "ev": """SELECT user_id % 32 AS video_id, event_id, value,
    floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::double / (120 + 60 * ((user_id % 32) % 5)) * 8) / 8 AS t FROM events""",
    "video": """SELECT video_id, CASE WHEN video_id % 9 = 4 THEN printf('/v/it''s_%d.mp4', video_id) ELSE printf('/v/rec_%d.mp4', video_id) END AS path,
    2592000::double / (120 + 60 * (video_id % 5)) - (video_id % 11) * 0.625::double AS duration_s FROM (SELECT DISTINCT video_id FROM ev)""",
    "speech": """SELECT video_id, (row_number() OVER w - 1)::int AS seg_idx, t AS speech_start,
    least(t + 1 + floor(value * 2) / 8, lead(t) OVER w) AS speech_end FROM ev WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id)""",
    "volume": """SELECT video_id, chunk_start, CASE WHEN (chunk_start / 10)::bigint % 17 = 0 THEN 'mean_volume: -inf dB max_volume: -inf dB'
    ELSE printf('mean_volume: %.1f dB max_volume: %.1f dB', max_db - last % 13, max_db) END AS log
    FROM (SELECT video_id, floor(t / 10) * 10 AS chunk_start, least(0::double, -50::double + floor(max(value) * 5) / 10) AS max_db, max(event_id) AS last
          FROM ev GROUP BY ALL)""",
}
