"""Extension: chunk scores of recordings that are still running.

Loudness readings (video_id, ts, max_db, mean_db) arrive as a stream. Each grid
cell is scored once the watermark has passed it; claims and packing rank whole
timelines and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.operators.scoring import loudness_score
from cliptide.plans.config import HighlightConfig


def stream_scores(readings: DataFrame, lateness: str = "1 minute", config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """video_id, chunk_start, chunk_end (timestamps), score: cells with a score above 0."""
    cells = readings.withWatermark("ts", lateness).groupBy("video_id", F.window("ts", f"{config.chunk_s} seconds").alias("w")).agg(
        F.max("max_db").alias("max_db"), F.max("mean_db").alias("mean_db")
    )
    score = loudness_score(F.lit(float(config.chunk_s)), F.col("max_db"), F.col("mean_db"), config.silence_db)
    return cells.select("video_id", F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), score.alias("score")).filter("score > 0")
