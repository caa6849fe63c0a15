"""Joining loud chunks with speech: overlap, exclusive claims, moments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliptide.plans.config import HighlightConfig

MOMENT = "video_id long, moment_rank int, start double, end double, duration double, score double"


def speech_overlap(ranked: DataFrame, speech: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """Pairs of a chunk and a segment that overlap; touching is no overlap.

    A segment is listed under every grid cell it touches and a chunk lies in
    exactly one cell, so this is a hash join that yields each pair once.
    """
    cell = lambda c: F.floor(c / config.chunk_s)
    listed = speech.filter("speech_end >= speech_start").withColumn("cell", F.explode(F.sequence(cell(F.col("speech_start")), cell(F.col("speech_end")))))
    return ranked.withColumn("cell", cell(F.col("chunk_start"))).join(listed, ["video_id", "cell"]).filter(
        "chunk_start < speech_end AND chunk_end > speech_start"
    ).drop("cell")


def claim_speech(overlap: DataFrame) -> DataFrame:
    """Each segment goes to the best-ranked chunk that overlaps it."""
    best = Window.partitionBy("video_id", "seg_idx").orderBy("chunk_rank")
    return overlap.withColumn("claim", F.row_number().over(best)).filter("claim = 1").drop("claim")


def spans(claimed: DataFrame) -> DataFrame:
    """One moment of each chunk that got speech: from its first segment's start to its last one's end."""
    grouped = claimed.groupBy("video_id", "chunk_rank").agg(
        F.min("speech_start").alias("start"), F.max("speech_end").alias("end"), F.max("score").alias("score")
    )
    return grouped.select("video_id", "chunk_rank", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "score")


def unordered_videos(speech: DataFrame) -> DataFrame:
    """Videos whose segments overlap or are out of order, where claims depend on the order of visits."""
    by = Window.partitionBy("video_id").orderBy("seg_idx")
    odd = (F.lag("speech_end").over(by) > F.col("speech_start")) | (F.col("speech_start") > F.col("speech_end"))
    return speech.withColumn("odd", F.coalesce(odd, F.lit(False))).filter("odd").select("video_id").distinct()


def visit_in_order(chunks: pd.DataFrame, speech: pd.DataFrame) -> pd.DataFrame:
    """One video by visiting its chunks, best first, as overlapping speech requires.

    A chunk takes the free segments that overlap it; everything between the first
    and the last of them, by index, is used up.
    """
    speech, chunks = speech.sort_values("seg_idx"), chunks.sort_values("chunk_rank")
    start, end = speech["speech_start"].to_numpy(), speech["speech_end"].to_numpy()
    free = pd.Series(True, index=range(len(speech))).to_numpy()
    rows = []
    for c in chunks.itertuples():
        hits = (free & (start < c.chunk_end) & (end > c.chunk_start)).nonzero()[0]
        if len(hits):
            low, high = int(hits[0]), int(hits[-1])
            free[low : high + 1] = False
            rows.append((c.video_id, c.chunk_rank, float(start[low]), float(end[high]), float(end[high] - start[low]), c.score))
    return pd.DataFrame(rows, columns=["video_id", "chunk_rank", "start", "end", "duration", "score"])


def moments(ranked: DataFrame, speech: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """Ranked moments. Videos without speech keep their chunks as moments; videos with overlapping
    or unordered speech are visited in order."""
    schema = "video_id long, chunk_rank int, start double, end double, duration double, score double"
    odd = unordered_videos(speech)
    plain_speech = speech.join(odd, "video_id", "left_anti")
    plain = spans(claim_speech(speech_overlap(ranked, plain_speech, config)))
    visited = ranked.join(odd, "video_id", "left_semi").groupBy("video_id").cogroup(speech.join(odd, "video_id", "left_semi").groupBy("video_id")).applyInPandas(visit_in_order, schema)
    silent = ranked.join(speech.select("video_id").distinct(), "video_id", "left_anti").select(
        "video_id", "chunk_rank", F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end"), "duration", "score"
    )
    return rank_moments(plain.unionByName(visited).unionByName(silent))


def rank_moments(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("video_id").orderBy("chunk_rank")
    return found.withColumn("moment_rank", F.row_number().over(order)).select("video_id", "moment_rank", "start", "end", "duration", "score")
