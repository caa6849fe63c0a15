"""Inputs: recordings, loudness logs and speech segments as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO = "video_id long, path string, duration_s double"
VOLUME = "video_id long, chunk_start double, log string"
SPEECH = "video_id long, seg_idx int, speech_start double, speech_end double"
#: File name endings of recordings.
MEDIA = ("mp4", "mkv", "mov", "avi", "flv", "webm", "wmv")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def media_files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows whose path ends like a recording's."""
    return paths.filter(F.lower(path_col).rlike(r"\.(" + "|".join(MEDIA) + ")$"))


def probe_durations(paths: DataFrame, probe: Callable[[str], float]) -> DataFrame:
    """(video_id, path) with duration_s by ``probe``, a function of a path; 0 where it fails."""

    def one(path: str) -> float:
        try:
            return float(probe(path))
        except Exception:  # noqa: BLE001  a failed probe is a duration of 0
            return 0.0

    def probed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(duration_s=[one(p) for p in part["path"]])

    return paths.select("video_id", "path").mapInPandas(probed, VIDEO)


def measure_loudness(chunks: DataFrame, measure: Callable[[str, float, float], str]) -> DataFrame:
    """(video_id, path, chunk_start, chunk_end) with the measuring tool's log text; null where it fails."""

    def one(path: str, start: float, end: float) -> str | None:
        try:
            return measure(path, start, end - start)
        except Exception:  # noqa: BLE001  a failed measurement leaves no log
            return None

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            logs = [one(p, s, e) for p, s, e in zip(part["path"], part["chunk_start"], part["chunk_end"], strict=True)]
            yield part[["video_id", "chunk_start"]].assign(log=logs)

    return chunks.select("video_id", "path", "chunk_start", "chunk_end").mapInPandas(measured, VOLUME)


def speech_from_transcripts(transcripts: DataFrame) -> DataFrame:
    """(video_id, segments array<struct<start, end, ...>>) exploded in the order given."""
    return transcripts.select("video_id", F.posexplode("segments").alias("seg_idx", "s")).select(
        "video_id", "seg_idx", F.col("s.start").cast("double").alias("speech_start"), F.col("s.end").cast("double").alias("speech_end")
    )


def transcribe(paths: DataFrame, recognise: Callable[[str], list[dict]]) -> DataFrame:
    """Speech of (video_id, path) by ``recognise``, a function of a path that gives segments with
    start and end, in order. A failure ends the job: without speech there is nothing to cut."""

    def heard(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (v, i, float(s["start"]), float(s["end"]))
                for v, p in zip(part["video_id"], part["path"], strict=True)
                for i, s in enumerate(recognise(p))
            ]
            yield pd.DataFrame(rows, columns=["video_id", "seg_idx", "speech_start", "speech_end"])

    return paths.select("video_id", "path").mapInPandas(heard, SPEECH)


def checked_requests(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(video_id, path, output) with a status: unset where a path is null or empty, missing where
    ``existing`` (path) does not hold the input, else ready."""
    there = existing.select("path").distinct().withColumn("there", F.lit(True))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    status = F.when(blank("path") | blank("output"), "unset").when(F.col("there").isNull(), "missing").otherwise("ready")
    return requests.join(there, "path", "left").select("video_id", "path", "output", status.alias("status"))
