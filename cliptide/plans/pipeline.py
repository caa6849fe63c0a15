"""The whole plan: from recordings, loudness and speech to every output, lazily."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cliptide.operators import fusion, output, scoring, selection
from cliptide.plans.config import HighlightConfig


@dataclass
class HighlightPlan:
    ranked: DataFrame
    moments: DataFrame
    selected: DataFrame
    clips: DataFrame
    bins: DataFrame
    edit_list: DataFrame
    summary: DataFrame


def build_plan(video: DataFrame, volume: DataFrame, speech: DataFrame, config: HighlightConfig = HighlightConfig()) -> HighlightPlan:
    """Both outputs read the moments; persist ``moments`` where both are written in one job."""
    ranked = scoring.rank_chunks(scoring.score_chunks(scoring.chunk_grid(video, config), scoring.parse_volume(volume), config))
    moments = fusion.moments(ranked, speech, config)
    selected = selection.select_moments(moments, video, config)
    bins = selection.pack_bins(moments, config)
    return HighlightPlan(
        ranked, moments, selected, output.clips(selected, config), bins, output.edit_list(selected, bins, video, config), output.summary(video, ranked, moments, selected, bins)
    )
