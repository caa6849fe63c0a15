from datetime import datetime, timedelta

from cliptide.streaming.levels import stream_scores


def test_cells_are_scored_once_the_watermark_passes(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, t0 + timedelta(seconds=s), m, -20.0) for s, m in ((1, -5.0), (4, -9.0), (12, -45.0), (25, 0.0), (300, 0.0))]
    spark.createDataFrame(rows, "video_id long, ts timestamp, max_db double, mean_db double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id long, ts timestamp, max_db double, mean_db double").parquet(str(tmp_path / "in"))
    query = stream_scores(stream).writeStream.outputMode("append").format("memory").queryName("levels").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    got = {(r.chunk_start - t0).seconds: r.score for r in spark.sql("SELECT * FROM levels").collect()}
    assert got[0] == 6.5625 and got[20] == 10.0 and 10 not in got
