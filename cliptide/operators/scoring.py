"""Time grid, loudness scores and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.plans.config import HighlightConfig

#: Fixed pattern of a loudness log; the first match counts.
LEVEL = r"%s_volume: (-?\d+\.?\d*) dB"


def chunk_grid(video: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """Chunks of chunk_s from 0, the last cut at the duration; those of min_chunk_s or less are left out."""
    lasting = video.filter(F.col("duration_s") >= 1)
    starts = lasting.select("video_id", "duration_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor("duration_s") - 1, F.lit(config.chunk_s).cast("long"))).alias("s"))
    chunks = starts.select(
        "video_id", F.col("s").cast("double").alias("chunk_start"), F.least((F.col("s") + config.chunk_s).cast("double"), "duration_s").alias("chunk_end")
    )
    return chunks.filter(F.col("chunk_end") - F.col("chunk_start") > config.min_chunk_s)


def level_in(log: Column, kind: str) -> Column:
    return F.nullif(F.regexp_extract(log, LEVEL % kind, 1), F.lit("")).try_cast("double")


def parse_volume(volume: DataFrame) -> DataFrame:
    """max_db and mean_db of each log; null where a line is missing."""
    return volume.select("video_id", "chunk_start", level_in(F.col("log"), "max").alias("max_db"), level_in(F.col("log"), "mean").alias("mean_db"))


def loudness_score(duration: Column, max_db: Column, mean_db: Column, silence_db: float = -40.0) -> Column:
    """duration * loudness * dynamics; 0 for silence and for missing levels."""
    loudness = (max_db - silence_db) / -silence_db
    dynamics = F.when(mean_db != 0, F.abs(mean_db - max_db) / F.abs(mean_db)).otherwise(1.0)
    heard = max_db.isNotNull() & mean_db.isNotNull() & (max_db > silence_db)
    return F.when(heard, duration * loudness * dynamics).otherwise(0.0)


def score_chunks(chunks: DataFrame, levels: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """Chunks with a score above 0."""
    duration = F.col("chunk_end") - F.col("chunk_start")
    scored = chunks.join(levels, ["video_id", "chunk_start"]).withColumn("duration", duration)
    scored = scored.withColumn("score", loudness_score(F.col("duration"), F.col("max_db"), F.col("mean_db"), config.silence_db))
    return scored.filter("score > 0").select("video_id", "chunk_start", "chunk_end", "duration", "score")


def rank_chunks(scored: DataFrame) -> DataFrame:
    """chunk_rank by score, earlier chunks first among equals."""
    order = Window.partitionBy("video_id").orderBy(F.desc("score"), "chunk_start")
    return scored.withColumn("chunk_rank", F.row_number().over(order))
