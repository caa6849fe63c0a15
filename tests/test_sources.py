from pyspark.sql import functions as F

from cliptide.functions import text
from cliptide.operators import output
from cliptide.sources import tables


def test_failed_probes_have_no_duration(spark):
    def probe(path):
        if path.endswith("b.mp4"):
            raise OSError(path)
        return 12.5

    rows = spark.createDataFrame([(1, "/v/a.MP4"), (2, "/v/b.mp4"), (3, "/v/c.txt")], "video_id long, path string")
    kept = tables.media_files(rows)
    assert {r.video_id: r.duration_s for r in tables.probe_durations(kept, probe).collect()} == {1: 12.5, 2: 0.0}


def test_failed_measurements_have_no_log(spark):
    def measure(path, start, length):
        if start > 0:
            raise OSError(path)
        return f"max_volume: -{length:.0f} dB"

    chunks = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "a", 10.0, 20.0)], "video_id long, path string, chunk_start double, chunk_end double")
    assert {r.chunk_start: r.log for r in tables.measure_loudness(chunks, measure).collect()} == {0.0: "max_volume: -10 dB", 10.0: None}


def test_paths(spark):
    rows = spark.createDataFrame([("/v/highlight.mp4",), ("plain.tar.gz",), ("/v/.hidden",), ("/v.d/noend",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in rows.select(text.default_output(p), text.clips_folder(p), text.vertical_folder(p)).collect()]
    assert got == [
        ("/v/highlight_highlight.mp4", "/v/highlight_clips", "/v/highlight_tiktoks"),
        ("plain.tar_highlight.mp4", "plain.tar_clips", "plain.tar_tiktoks"),
        ("/v/.hidden_highlight.mp4", "/v/.hidden_clips", "/v/.hidden_tiktoks"),
        ("/v.d/noend_highlight.mp4", "/v.d/noend_clips", "/v.d/noend_tiktoks"),
    ]


def test_quotes_are_escaped(spark):
    row = spark.createDataFrame([("/v/it's.mp4",)], "p string").select(text.concat_line(F.col("p"))).first()
    assert row[0] == "file '/v/it'\\''s.mp4'"


def test_failed_clips_leave_the_list(spark, tmp_path):
    listed = spark.createDataFrame([(1, "highlight", 1, "a"), (1, "highlight", 2, "b"), (1, "tiktok_001", 1, "c")], "video_id long, output string, seq int, line string")
    left = output.without_failed(listed, listed.filter("line = 'a'").drop("line"))
    assert sorted(r.line for r in left.collect()) == ["b", "c"]
    output.write_edit_list(left, str(tmp_path / "lists"))
    assert spark.read.parquet(str(tmp_path / "lists")).count() == 2
