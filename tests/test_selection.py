import random

import pytest
from pyspark.sql import functions as F

from cliptide.operators import output, selection
from cliptide.plans.config import HighlightConfig
from cliptide.sources.tables import VIDEO

MOMENTS = "video_id long, moment_rank int, start double, end double, duration double, score double"


def moments(spark, durations, video_id=1):
    return spark.createDataFrame([(video_id, i + 1, 100.0 * i, 100.0 * i + d, float(d), 1.0) for i, d in enumerate(durations)], MOMENTS)


@pytest.mark.parametrize(
    ("profile", "want"),
    [("Court", [360, 480, 600]), ("Moyen", [600, 900, 1200]), ("moyen", [600, 900, 1200]), ("Longue", [1200, 1800, 2400])],
)
def test_target(spark, profile, want):
    rows = spark.createDataFrame([(7200.0,), (12600.0,), (18000.0,)], "d double")
    assert [r[0] for r in rows.select(selection.target_seconds(F.col("d"), HighlightConfig(profile=profile))).collect()] == want


@pytest.mark.parametrize(("duration", "durations", "n"), [(0.0, [300, 200, 150, 10], 3), (0.0, [700, 1], 1), (0.0, [100, 100], 2), (18000.0, [600, 600, 1], 2)])
def test_selection(spark, duration, durations, n):
    video = spark.createDataFrame([(1, "a", duration)], VIDEO)
    got = selection.select_moments(moments(spark, durations), video).orderBy("clip_no").collect()
    assert [r.duration for r in got] == durations[:n]
    assert [r.clip_no for r in got] == list(range(1, n + 1))


def first_fit(durations):
    bins = []
    for i, d in enumerate(durations):
        for b in bins:
            if b[0] < 60 and b[0] + d <= 60:
                b[0] += d
                b[1].append(i)
                break
        else:
            if len(bins) < 5:
                bins.append([d, [i]])
    return [b[1] for b in bins]


@pytest.mark.parametrize(
    ("durations", "bins"),
    [([40, 30, 20, 75, 0], [[0, 2], [1, 4], [3]]), ([60, 0, 0], [[0], [1, 2]]), ([75] * 6, [[0], [1], [2], [3], [4]]), ([], [])],
)
def test_packing(spark, durations, bins):
    got = {}
    for r in selection.pack_bins(moments(spark, durations)).orderBy("bin_no", "item_no").collect():
        got.setdefault(r.bin_no, []).append(r.moment_rank - 1)
    assert [got[k] for k in sorted(got)] == bins == first_fit(durations)


def test_random_packing(spark):
    rng = random.Random(3)
    pool = {v: [rng.choice([0, 5, 12.5, 30, 45, 60, 80]) for _ in range(rng.randint(1, 25))] for v in range(40)}
    df = None
    for v, d in pool.items():
        df = moments(spark, d, v) if df is None else df.union(moments(spark, d, v))
    got = {v: {} for v in pool}
    for r in selection.pack_bins(df).orderBy("moment_rank").collect():
        got[r.video_id].setdefault(r.bin_no, []).append(r.moment_rank - 1)
    assert {v: [b[k] for k in sorted(b)] for v, b in got.items()} == {v: first_fit(d) for v, d in pool.items()}


def test_padding_and_names(spark):
    cuts = spark.createDataFrame([(1, 1, 0.1, 5.0, 4.9), (1, 2, 10.0, 20.0, 10.0), (1, 7, 642.9, 700.0, 57.1), (1, 1000, 7503.0, 7504.0, 1.0)], "video_id long, clip_no int, start double, end double, duration double")
    got = {r.clip_no: r for r in output.clips(cuts).collect()}
    assert (got[1].cut_start, got[1].cut_length) == (0.0, 5.3)
    assert got[2].cut_start == 9.7 and got[2].cut_length == pytest.approx(10.6)
    assert got[7].name == "clip_007_10m42s.mp4"
    assert got[1000].name == "clip_1000_125m03s.mp4"


def test_paths_beside_a_recording(spark):
    from cliptide.functions import text

    cases = {"/a.mp4": "/a_clips", "a.mp4": "a_clips", "/v/a.b.mkv": "/v/a.b_clips", "x//a.mp4": "x/a_clips", "//a": "//a_clips", "/v/.hidden": "/v/.hidden_clips"}
    rows = spark.createDataFrame([(k,) for k in cases], "path string").select("path", text.clips_folder(F.col("path")).alias("out"))
    assert {r.path: r.out for r in rows.collect()} == cases


def test_unknown_profile_warns(spark):
    with pytest.warns(UserWarning, match="Kurz"):
        selection.target_seconds(F.lit(1.0), HighlightConfig(profile="Kurz"))
