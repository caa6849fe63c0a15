"""Length budget, choice of moments, and short compilations."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.plans.config import PROFILES, HighlightConfig


def target_seconds(duration: Column, config: HighlightConfig = HighlightConfig()) -> Column:
    """The highlight's length: least up to short_s, most from long_s, linear between. An unknown
    profile is taken for Moyen, with a warning."""
    if config.profile not in PROFILES:
        warnings.warn(f"unknown profile {config.profile!r}, Moyen is used", stacklevel=2)
    low, high = (60.0 * m for m in PROFILES.get(config.profile, PROFILES["Moyen"]))
    between = low + (high - low) * ((duration - config.short_s) / (config.long_s - config.short_s))
    return F.when(duration <= config.short_s, low).when(duration >= config.long_s, high).otherwise(between)


def select_moments(moments: DataFrame, video: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """Moments in rank order while those before them last less than the target; listed by start."""
    before = Window.partitionBy("video_id").orderBy("moment_rank").rowsBetween(Window.unboundedPreceding, -1)
    targets = video.select("video_id", target_seconds(F.col("duration_s"), config).alias("target"))
    taken = moments.withColumn("before", F.coalesce(F.sum("duration").over(before), F.lit(0.0))).join(targets, "video_id").filter("before < target")
    order = Window.partitionBy("video_id").orderBy("start", "moment_rank")
    return taken.withColumn("clip_no", F.row_number().over(order)).select("video_id", "clip_no", "start", "end", "duration")


def padded(cuts: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """Adds cut_start and cut_length: pad_s before, not below 0, and pad_s after."""
    start = F.greatest(F.lit(0.0), F.col("start") - config.pad_s)
    return cuts.withColumn("cut_start", start).withColumn("cut_length", (F.col("end") + config.pad_s) - F.col("cut_start"))


def cut_overlap(cuts: DataFrame) -> DataFrame:
    """(video_id, overlap_s): seconds that padding makes neighbouring cuts of a highlight share."""
    before = F.lag(F.col("cut_start") + F.col("cut_length")).over(Window.partitionBy("video_id").orderBy("clip_no"))
    shared = cuts.withColumn("shared", F.greatest(F.lit(0.0), F.coalesce(before - F.col("cut_start"), F.lit(0.0))))
    return shared.groupBy("video_id").agg(F.round(F.sum("shared"), 6).alias("overlap_s"))


def pack_bins(moments: DataFrame, config: HighlightConfig = HighlightConfig()) -> DataFrame:
    """First fit of each video's moments by rank into at most ``bins`` bins of bin_cap_s.

    An empty bin takes any moment, even a longer one; a bin filled to the cap is
    closed, also to moments of no length; what fits nowhere is left out. A fold
    over the ranked moments holds one load for each bin.
    """
    item = F.struct("moment_rank", "start", "end", "duration", "score")
    ordered = moments.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.struct(
        F.array(*[F.lit(None).cast("double")] * config.bins).alias("loads"), F.array().cast("array<int>").alias("bins")
    )

    def place(state: Column, x: Column) -> Column:
        load, d = state["loads"], x["duration"]
        room = lambda i: load[i].isNull() | ((load[i] < config.bin_cap_s) & (load[i] + d <= config.bin_cap_s))
        chosen = F.lit(None).cast("int")
        for i in reversed(range(config.bins)):
            chosen = F.when(room(i), F.lit(i)).otherwise(chosen)
        loads = F.transform(load, lambda v, i: F.when(chosen == i, F.coalesce(v, F.lit(0.0)) + d).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(state["bins"], F.array(chosen)).alias("bins"))

    placed = ordered.withColumn("bins", F.aggregate("items", empty, place)["bins"])
    items = placed.select("video_id", F.explode(F.arrays_zip("items", "bins")).alias("z")).select(
        "video_id", (F.col("z.bins") + 1).alias("bin_no"), F.col("z.items.moment_rank").alias("moment_rank"), F.col("z.items.start").alias("start"),
        F.col("z.items.end").alias("end"), F.col("z.items.duration").alias("duration"), F.col("z.items.score").alias("score"),
    ).filter("bin_no IS NOT NULL")
    order = Window.partitionBy("video_id", "bin_no").orderBy("start", "moment_rank")
    return items.withColumn("item_no", F.row_number().over(order)).select("video_id", "bin_no", "item_no", "moment_rank", "start", "end", "duration", "score")
