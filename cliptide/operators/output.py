"""Clips, concatenation lists and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.functions import text
from cliptide.operators.selection import padded
from cliptide.plans.config import HighlightConfig

#: Fixed filter of vertical compilations: a 9:16 crop of the middle, scaled.
VERTICAL_FILTER = "crop=ih*9/16:ih,scale=1080:1920,setsar=1"


def clips(selected: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    return padded(selected, config).withColumn("name", text.clip_name(F.col("clip_no"), F.col("start")))


def verticals(bins: DataFrame) -> DataFrame:
    """One compilation of each bin, named by its earliest moment, with the filter it is rendered by."""
    grouped = bins.groupBy("video_id", "bin_no").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n_items"), F.sum("duration").alias("duration"))
    return grouped.withColumn("name", text.vertical_name(F.col("bin_no"), F.col("start"))).withColumn("filter", F.lit(VERTICAL_FILTER))


def edit_list(selected: DataFrame, bins: DataFrame, video: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """(video_id, output, seq, line): the lines of every concatenation list, in order."""
    main = clips(selected, config).join(video.select("video_id", "path"), "video_id").select(
        "video_id", F.lit("highlight").alias("output"), F.col("clip_no").alias("seq"),
        text.concat_line(F.concat(text.clips_folder(text.default_output(F.col("path"))), F.lit("/"), F.col("name"))).alias("line"),
    )
    parts = bins.join(video.select("video_id", "path"), "video_id").select(
        "video_id", F.format_string("tiktok_%03d", "bin_no").alias("output"), F.col("item_no").alias("seq"),
        text.concat_line(F.concat(text.vertical_folder(text.default_output(F.col("path"))), F.format_string("/part_%03d_%03d.mp4", "bin_no", "item_no"))).alias("line"),
    )
    return main.unionByName(parts) if config.vertical else main


def without_failed(listed: DataFrame, failed: DataFrame) -> DataFrame:
    """An edit list without the (video_id, output, seq) that could not be cut, in the same order."""
    return listed.join(failed, ["video_id", "output", "seq"], "left_anti")


def write_edit_list(listed: DataFrame, path: str) -> None:
    listed.repartitionByRange("video_id", "output").sortWithinPartitions("video_id", "output", "seq").write.mode("overwrite").partitionBy("output").parquet(path)


def outcomes(video: DataFrame, moments: DataFrame) -> DataFrame:
    """(video_id, outcome): no_duration and no_moments end a recording's run, done does not."""
    found = moments.select("video_id").distinct().withColumn("found", F.lit(True))
    lasting = F.coalesce(F.col("duration_s"), F.lit(0.0)) != 0
    return video.join(found, "video_id", "left").select(
        "video_id", F.when(~lasting, "no_duration").when(F.col("found").isNull(), "no_moments").otherwise("done").alias("outcome")
    )


def summary(video: DataFrame, ranked: DataFrame, moments: DataFrame, selected: DataFrame, bins: DataFrame) -> DataFrame:
    """Counts and lengths of each video; 0 where there is nothing."""
    count = lambda df, name: df.groupBy("video_id").agg(F.count(F.lit(1)).alias(name))
    out = video.select("video_id")
    chosen = selected.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_selected"), F.sum("duration").alias("selected_s"))
    planned = bins.groupBy("video_id").agg(F.countDistinct("bin_no").alias("n_verticals"))
    for part in (count(ranked, "n_hype"), count(moments, "n_moments"), chosen, planned):
        out = out.join(part, "video_id", "left")
    return out.na.fill(0)
