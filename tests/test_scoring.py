import pytest

from cliptide.operators import scoring
from cliptide.sources.tables import VIDEO, VOLUME


@pytest.mark.parametrize(
    ("duration", "chunks"),
    [
        (0.0, []), (0.9, []), (1.0, []), (1.5, [(0, 1.5)]), (10.0, [(0, 10)]), (20.5, [(0, 10), (10, 20)]), (21.0, [(0, 10), (10, 20)]),
        (21.5, [(0, 10), (10, 20), (20, 21.5)]), (25.0, [(0, 10), (10, 20), (20, 25)]), (None, []),
    ],
)
def test_grid(spark, duration, chunks):
    video = spark.createDataFrame([(1, "/v/a.mp4", duration)], VIDEO)
    assert sorted((r.chunk_start, r.chunk_end) for r in scoring.chunk_grid(video).collect()) == chunks


def test_scores(spark):
    line = "mean_volume: {} dB\nmax_volume: {} dB"
    cases = [
        (line.format(-20, -5), 6.5625), (line.format(-50, -40), 0), (line.format(-50, -39.9), 0.005050000000000073), (line.format(-10, -10), 0),
        (line.format(0, 0), 10), (line.format(-20, 0), 10), (line.format("-inf", "-inf"), 0), ("max_volume: -5 dB", 0), (None, 0),
        ("max_volume: -5 dB max_volume: -1 dB mean_volume: -20 dB", 6.5625),
    ]
    video = spark.createDataFrame([(1, "a", 10.0 * len(cases))], VIDEO)
    volume = spark.createDataFrame([(1, 10.0 * i, log) for i, (log, _) in enumerate(cases)], VOLUME)
    got = {r.chunk_start: r.score for r in scoring.score_chunks(scoring.chunk_grid(video), scoring.parse_volume(volume)).collect()}
    want = {10.0 * i: s for i, (_, s) in enumerate(cases) if s > 0}
    assert got == pytest.approx(want, rel=1e-12)


def test_ties_rank_earlier_chunks_first(spark):
    scored = spark.createDataFrame([(1, 10.0, 20.0, 10.0, 5.0), (1, 0.0, 10.0, 10.0, 5.0), (1, 20.0, 30.0, 10.0, 9.0)], "video_id long, chunk_start double, chunk_end double, duration double, score double")
    assert {r.chunk_start: r.chunk_rank for r in scoring.rank_chunks(scored).collect()} == {20.0: 1, 0.0: 2, 10.0: 3}
