import random

import pytest
from pyspark.sql import functions as F

from cliptide.operators import fusion, scoring
from cliptide.sources.tables import SPEECH, speech_from_transcripts

SCORED = "video_id long, chunk_start double, chunk_end double, duration double, score double"


def loop(chunks, speech):
    """The rule stated as a loop over chunks, best first."""
    used, out = set(), []
    for a, b, score in sorted(chunks, key=lambda c: (-c[2], c[0])):
        hits = [i for i, (s, e) in enumerate(speech) if i not in used and a < e and b > s]
        if hits:
            used.update(range(hits[0], hits[-1] + 1))
            out.append((speech[hits[0]][0], speech[hits[-1]][1], score))
    return out or ([] if speech else [(a, b, s) for a, b, s in sorted(chunks, key=lambda c: (-c[2], c[0]))])


def run(spark, videos):
    scored = spark.createDataFrame([(v, float(a), float(b), float(b - a), float(s)) for v, (chunks, _) in videos.items() for a, b, s in chunks], SCORED)
    speech = spark.createDataFrame([(v, i, float(s), float(e)) for v, (_, segs) in videos.items() for i, (s, e) in enumerate(segs)], SPEECH)
    rows = fusion.moments(scoring.rank_chunks(scored), speech).orderBy("video_id", "moment_rank").collect()
    out = {v: [] for v in videos}
    for r in rows:
        assert r.duration == r.end - r.start
        out[r.video_id].append((r.start, r.end, r.score))
    return out


CASES = [
    ([(0, 10, 5), (10, 20, 9)], [(1, 3), (8, 12), (15, 18)], [(8, 18, 9), (1, 3, 5)]),
    ([(10, 20, 9)], [(5, 10)], []),
    ([(10, 20, 9)], [(12, 12)], [(12, 12, 9)]),
    ([(0, 10, 9), (10, 20, 5)], [(10, 10)], []),
    ([(20, 30, 9), (0, 10, 5), (10, 20, 4)], [(5, 35)], [(5, 35, 9)]),
    ([(0, 10, 9), (10, 20, 5)], [(1, 3), (11, 13), (8, 9)], [(1, 9, 9)]),
    ([(0, 10, 5), (10, 20, 9)], [], [(10, 20, 9), (0, 10, 5)]),
    ([(0, 10, 9), (50, 60, 5)], [(52, 55)], [(52, 55, 5)]),
]


def test_branches(spark):
    got = run(spark, {i: (c, s) for i, (c, s, _) in enumerate(CASES)})
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


@pytest.mark.parametrize("disjoint", [True, False])
def test_random_timelines(spark, disjoint):
    rng = random.Random(5)
    videos = {}
    for v in range(120):
        chunks = [(10 * i, 10 * i + 10, rng.randint(1, 6)) for i in range(8) if rng.random() < 0.7]
        cuts = sorted(rng.randrange(0, 640) / 8 for _ in range(2 * rng.randint(1, 9)))
        segs = list(zip(cuts[::2], cuts[1::2], strict=True))
        if not disjoint:
            segs = [(s, s + rng.randrange(0, 160) / 8) for s, _ in segs]
            rng.shuffle(segs)
        videos[v] = (chunks, segs)
    got = run(spark, videos)
    assert got == {v: loop(c, s) for v, (c, s) in videos.items()}


def test_each_segment_is_claimed_once(spark):
    ranked = scoring.rank_chunks(spark.createDataFrame([(1, 10.0 * i, 10.0 * i + 10, 10.0, float(i % 3 + 1)) for i in range(9)], SCORED))
    speech = spark.createDataFrame([(1, i, 7.0 * i, 7.0 * i + 6) for i in range(12)], SPEECH)
    claimed = fusion.claim_speech(fusion.speech_overlap(ranked, speech))
    assert claimed.groupBy("seg_idx").count().filter("count > 1").isEmpty()
    assert fusion.speech_overlap(ranked, speech).groupBy("seg_idx", "chunk_rank").count().filter("count > 1").isEmpty()


def test_transcripts_explode_in_order(spark):
    t = spark.range(1).select(F.lit(3).cast("long").alias("video_id"), F.expr("array(named_struct('start', 1.5D, 'end', 2D), named_struct('start', 0D, 'end', 1D))").alias("segments"))
    assert [tuple(r) for r in speech_from_transcripts(t).orderBy("seg_idx").collect()] == [(3, 0, 1.5, 2.0), (3, 1, 0.0, 1.0)]
