"""Every operator as a named query over derived recordings, and DuckDB SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.functions import text
from cliptide.operators import fusion, output, scoring, selection
from cliptide.plans.config import PROFILES, HighlightConfig
from cliptide.plans.registry import ORACLES, QUERIES
from cliptide.sources import fixtures, tables

#: Later entries build on earlier ones.
STEPS = fixtures.SQL | {
    "grid": """SELECT video_id, s::double AS chunk_start, least((s + 10)::double, duration_s) AS chunk_end
    FROM (SELECT video_id, duration_s, unnest(range(0, floor(duration_s)::bigint, 10)) AS s FROM video) WHERE least((s + 10)::double, duration_s) - s > 1""",
    "levels": r"""SELECT video_id, chunk_start, try_cast(nullif(regexp_extract(log, 'max_volume: (-?\d+\.?\d*) dB', 1), '') AS double) AS max_db,
    try_cast(nullif(regexp_extract(log, 'mean_volume: (-?\d+\.?\d*) dB', 1), '') AS double) AS mean_db FROM volume""",
    "scored": """SELECT video_id, chunk_start, chunk_end, duration, score FROM (
      SELECT *, CASE WHEN max_db IS NULL OR mean_db IS NULL OR max_db <= -40 THEN 0::double
        ELSE duration * ((max_db + 40) / 40) * CASE WHEN mean_db <> 0 THEN abs(mean_db - max_db) / abs(mean_db) ELSE 1::double END END AS score
      FROM (SELECT *, chunk_end - chunk_start AS duration FROM grid JOIN levels USING (video_id, chunk_start))) WHERE score > 0""",
    "ranked": """SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY score DESC, chunk_start))::int AS chunk_rank FROM scored""",
    "overlap": """SELECT r.video_id, chunk_start, chunk_end, duration, score, chunk_rank, seg_idx, speech_start, speech_end
    FROM ranked r JOIN speech s ON r.video_id = s.video_id AND chunk_start < speech_end AND chunk_end > speech_start""",
    "claimed": """SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg_idx ORDER BY chunk_rank) AS n FROM overlap) WHERE n = 1""",
    "spans": """SELECT video_id, chunk_rank, start, "end", "end" - start AS duration, score FROM (
      SELECT video_id, chunk_rank, min(speech_start) AS start, max(speech_end) AS "end", max(score) AS score FROM claimed GROUP BY ALL)""",
    "moments": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY chunk_rank))::int AS moment_rank, start, "end", duration, score FROM spans""",
    "heard_spans": """SELECT * FROM spans WHERE video_id % 8 <> 7 UNION ALL
    SELECT video_id, chunk_rank, chunk_start, chunk_end, duration, score FROM ranked WHERE video_id NOT IN (SELECT video_id FROM speech WHERE video_id % 8 <> 7)""",
    "selected": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY start, moment_rank))::int AS clip_no, start, "end", duration FROM (
      SELECT m.*, coalesce(sum(duration) OVER (PARTITION BY video_id ORDER BY moment_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM moments m)
      JOIN target USING (video_id) WHERE before < target""",
    "padded": """SELECT *, ("end" + 0.3::double) - cut_start AS cut_length FROM (SELECT *, greatest(0::double, start - 0.3::double) AS cut_start FROM selected)""",
    "clips": """SELECT *, printf('clip_%03d_%dm%02ds.mp4', clip_no, floor(start / 60)::bigint, floor(start % 60)::bigint) AS name FROM padded""",
    "walk": """SELECT video_id, 0 AS moment_rank, NULL::int AS bin_no, NULL::double AS a, NULL::double AS b, NULL::double AS c, NULL::double AS d, NULL::double AS e FROM video
    UNION ALL SELECT video_id, moment_rank, bin_no, CASE WHEN bin_no = 1 THEN coalesce(a, 0) + x ELSE a END, CASE WHEN bin_no = 2 THEN coalesce(b, 0) + x ELSE b END,
      CASE WHEN bin_no = 3 THEN coalesce(c, 0) + x ELSE c END, CASE WHEN bin_no = 4 THEN coalesce(d, 0) + x ELSE d END, CASE WHEN bin_no = 5 THEN coalesce(e, 0) + x ELSE e END
    FROM (SELECT w.video_id, m.moment_rank, m.duration AS x, a, b, c, d, e,
      CASE WHEN a IS NULL OR (a < 60 AND a + m.duration <= 60) THEN 1 WHEN b IS NULL OR (b < 60 AND b + m.duration <= 60) THEN 2
           WHEN c IS NULL OR (c < 60 AND c + m.duration <= 60) THEN 3 WHEN d IS NULL OR (d < 60 AND d + m.duration <= 60) THEN 4
           WHEN e IS NULL OR (e < 60 AND e + m.duration <= 60) THEN 5 END AS bin_no
      FROM walk w JOIN moments m ON m.video_id = w.video_id AND m.moment_rank = w.moment_rank + 1)""",
    "bins": """SELECT video_id, bin_no, (row_number() OVER (PARTITION BY video_id, bin_no ORDER BY start, moment_rank))::int AS item_no, moment_rank, start, "end", duration, score
    FROM walk JOIN moments USING (video_id, moment_rank) WHERE bin_no IS NOT NULL""",
    "verticals": """SELECT *, printf('tiktok_%03d_%dm%02ds.mp4', bin_no, floor(start / 60)::bigint, floor(start % 60)::bigint) AS name, 'crop=ih*9/16:ih,scale=1080:1920,setsar=1' AS filter FROM (
      SELECT video_id, bin_no, min(start) AS start, count(*) AS n_items, sum(duration) AS duration FROM bins GROUP BY ALL)""",
    "stems": """SELECT video_id, replace(regexp_replace(path, '[.]mp4$', '') || '_highlight', '''', '''\\''''') AS stem FROM video""",
}


def target_sql(profile: str) -> str:
    low, high = (60 * m for m in PROFILES[profile])
    return f"""SELECT video_id, CASE WHEN duration_s <= 7200 THEN {low}::double WHEN duration_s >= 18000 THEN {high}::double
    ELSE {low}::double + {high - low}::double * ((duration_s - 7200) / (18000::double - 7200)) END AS target FROM video"""


def sql(select: str, profile: str = "Moyen") -> str:
    steps = dict(STEPS)
    at = list(steps).index("selected")
    named = [*list(steps.items())[:at], ("target", target_sql(profile)), *list(steps.items())[at:]]
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in named) + "\n" + select


class Inputs:
    """Derived inputs and the steps up to the moments."""

    def __init__(self, spark: SparkSession, sf_dir: str, profile: str = "Moyen"):
        self.config = HighlightConfig(profile=profile)
        self.video, self.volume = fixtures.video(spark, sf_dir), fixtures.volume(spark, sf_dir)
        self.speech = fixtures.speech(spark, sf_dir)
        self.held: DataFrame | None = None

    def scored(self) -> DataFrame:
        return scoring.score_chunks(scoring.chunk_grid(self.video), scoring.parse_volume(self.volume))

    def ranked(self) -> DataFrame:
        return scoring.rank_chunks(self.scored())

    def moments(self) -> DataFrame:
        if self.held is None:
            self.held = fusion.moments(self.ranked(), self.speech)
        return self.held

    def shared(self) -> Inputs:
        """Keeps the moments for outputs that read them more than once."""
        self.moments().persist()
        return self

    def selected(self) -> DataFrame:
        return selection.select_moments(self.moments(), self.video, self.config)

    def bins(self) -> DataFrame:
        return selection.pack_bins(self.moments())


def query(name: str, select: str | None, profile: str = "Moyen"):
    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir, profile), spark, sf_dir)
        if select is not None:
            ORACLES[name] = sql(select, profile)
        return build

    return register


query("chunk_grid", "SELECT * FROM grid")(lambda i, *_: scoring.chunk_grid(i.video))
query("volume_parse", "SELECT * FROM levels")(lambda i, *_: scoring.parse_volume(i.volume))
query("chunk_score", "SELECT * FROM scored")(lambda i, *_: i.scored())
query("hype_rank", "SELECT * FROM ranked")(lambda i, *_: i.ranked())
for _profile in PROFILES:
    query(f"target_duration_{_profile.lower()}", "SELECT video_id, duration_s, target FROM video JOIN target USING (video_id)", _profile)(
        lambda i, *_: i.video.select("video_id", "duration_s", selection.target_seconds(F.col("duration_s"), i.config).alias("target"))
    )
    query(f"highlight_selection_{_profile.lower()}", "SELECT * FROM selected", _profile)(lambda i, *_: i.selected())
query("speech_overlap", "SELECT * FROM overlap")(lambda i, *_: fusion.speech_overlap(i.ranked(), i.speech))
query("speech_claim", "SELECT * FROM claimed")(lambda i, *_: fusion.claim_speech(fusion.speech_overlap(i.ranked(), i.speech)))
query("moments", "SELECT * FROM moments")(lambda i, *_: i.moments())
query(
    "moments_no_speech",
    """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY chunk_rank))::int AS moment_rank, start, "end", duration, score FROM heard_spans""",
)(lambda i, spark, sf_dir: fusion.moments(i.ranked(), fixtures.speech(spark, sf_dir, some_silent=True)))
#: Chunks are visited best first; one takes the free segments that overlap it and all between the first and the last.
OVERLAPPING = """SELECT v.video_id, (row_number() OVER (PARTITION BY v.video_id ORDER BY rank))::int AS moment_rank, a.speech_start AS start, b.speech_end AS "end",
    b.speech_end - a.speech_start AS duration, r.score FROM visits v JOIN long_speech a ON a.video_id = v.video_id AND a.seg_idx = v.low
    JOIN long_speech b ON b.video_id = v.video_id AND b.seg_idx = v.high JOIN ranked r ON r.video_id = v.video_id AND r.chunk_rank = v.rank"""
STEPS |= {
    "long_speech": "SELECT video_id, seg_idx, speech_start, speech_end + CASE WHEN video_id % 3 = 1 THEN 12 ELSE 0 END AS speech_end FROM speech",
    "met": """SELECT r.video_id, chunk_rank, list(seg_idx) FILTER (seg_idx IS NOT NULL) AS hits FROM ranked r LEFT JOIN long_speech s
    ON r.video_id = s.video_id AND chunk_start < speech_end AND chunk_end > speech_start GROUP BY ALL""",
    "visits": """SELECT video_id, 0 AS rank, []::int[] AS used, NULL::int AS low, NULL::int AS high FROM video
    UNION ALL SELECT video_id, rank, CASE WHEN low IS NULL THEN used ELSE list_concat(used, range(low, high + 1)::int[]) END, low, high FROM (
      SELECT video_id, rank, used, list_min(free)::int AS low, list_max(free)::int AS high FROM (
        SELECT v.video_id, v.rank + 1 AS rank, used, list_filter(coalesce(hits, []), lambda x: NOT list_contains(used, x)) AS free
        FROM visits v JOIN met ON met.video_id = v.video_id AND met.chunk_rank = v.rank + 1))""",
}
query("moments_overlapping_speech", OVERLAPPING)(lambda i, spark, sf_dir: fusion.moments(i.ranked(), fixtures.overlapping_speech(spark, sf_dir)))
query("highlight_selection", "SELECT * FROM selected")(lambda i, *_: i.selected())
query("padded_cuts", "SELECT * FROM padded")(lambda i, *_: selection.padded(i.selected()))
query("clip_names", "SELECT video_id, clip_no, name FROM clips")(lambda i, *_: output.clips(i.selected()).select("video_id", "clip_no", "name"))
query("bin_packing", "SELECT * FROM bins")(lambda i, *_: i.bins())
query("vertical_names", "SELECT * FROM verticals")(lambda i, *_: output.verticals(i.bins()))
query(
    "path_names",
    r"""SELECT video_id, regexp_replace(path, '[.]mp4$', '_highlight.mp4') AS default_output, regexp_replace(path, '[.]mp4$', '_clips') AS clips_folder,
    regexp_replace(path, '[.]mp4$', '_tiktoks') AS vertical_folder FROM video""",
)(
    lambda i, *_: i.video.select(
        "video_id", text.default_output(F.col("path")).alias("default_output"), text.clips_folder(F.col("path")).alias("clips_folder"), text.vertical_folder(F.col("path")).alias("vertical_folder")
    )
)
EDIT_LIST = """SELECT video_id, 'highlight' AS output, clip_no AS seq, 'file ''' || stem || '_clips/' || name || '''' AS line FROM clips JOIN stems USING (video_id)
    UNION ALL SELECT video_id, printf('tiktok_%03d', bin_no), item_no, 'file ''' || stem || printf('_tiktoks/part_%03d_%03d.mp4', bin_no, item_no) || '''' FROM bins JOIN stems USING (video_id)"""
query("edit_list", EDIT_LIST)(lambda i, *_: output.edit_list(i.shared().selected(), i.bins(), i.video))
query(
    "highlight_summary",
    """SELECT video_id, coalesce(n_hype, 0) AS n_hype, coalesce(n_moments, 0) AS n_moments, coalesce(n_selected, 0) AS n_selected, coalesce(selected_s, 0) AS selected_s, coalesce(n_verticals, 0) AS n_verticals
    FROM video LEFT JOIN (SELECT video_id, count(*) AS n_hype FROM ranked GROUP BY 1) USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS n_moments FROM moments GROUP BY 1) USING (video_id)
    LEFT JOIN (SELECT video_id, count(*) AS n_selected, sum(duration) AS selected_s FROM selected GROUP BY 1) USING (video_id)
    LEFT JOIN (SELECT video_id, count(DISTINCT bin_no) AS n_verticals FROM bins GROUP BY 1) USING (video_id)""",
)(lambda i, *_: output.summary(i.video, i.ranked(), i.shared().moments(), i.selected(), i.bins()))


def _derived_length(path: str) -> float:
    """Stands for a probe; fails for some paths."""
    return 1 / 0 if "'" in path else 10.0 * len(path)


def _derived_log(path: str, start: float, length: float) -> str:
    """Stands for a loudness measurement; fails for some chunks."""
    return 1 / 0 if start % 70 == 30 else f"mean_volume: -{int(start) % 7 + 20}.0 dB max_volume: -{len(path)}.5 dB"


def _derived_segments(path: str) -> list[dict]:
    """Stands for a speech recogniser."""
    return [{"start": 2.0 * i, "end": 2.0 * i + 1.5} for i in range(len(path) % 6)]


query("duration_probe", "SELECT video_id, path, CASE WHEN contains(path, '''') THEN 0::double ELSE 10::double * length(path) END AS duration_s FROM video")(
    lambda i, *_: tables.probe_durations(i.video, _derived_length)
)
query(
    "loudness_probe",
    """SELECT video_id, chunk_start, CASE WHEN chunk_start % 70 <> 30 THEN 'mean_volume: -' || (chunk_start::bigint % 7 + 20) || '.0 dB max_volume: -' || length(path) || '.5 dB' END AS log
    FROM grid JOIN video USING (video_id)""",
)(lambda i, *_: tables.measure_loudness(scoring.chunk_grid(i.video).join(i.video.select("video_id", "path"), "video_id"), _derived_log))
query(
    "speech_recognised",
    "SELECT video_id, i::int AS seg_idx, 2::double * i AS speech_start, 2::double * i + 1.5::double AS speech_end FROM (SELECT video_id, unnest(range(length(path) % 6)) AS i FROM video)",
)(lambda i, *_: tables.transcribe(i.video, _derived_segments))
query("speech_transcripts", "SELECT * FROM speech")(
    lambda i, *_: tables.speech_from_transcripts(
        i.speech.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.col("speech_start").alias("start"), F.col("speech_end").alias("end")))).alias("segments"))
    )
)
_ENDINGS = ("mp4", "MKV", "mov", "avi", "flv", "WebM", "wmv", "txt", "mp3", "mp4.part")
query(
    "media_formats",
    f"""SELECT * FROM (SELECT video_id, 'rec.' || [{', '.join(map(repr, _ENDINGS))}][video_id % 10 + 1] AS path FROM video)
    WHERE regexp_matches(lower(path), '[.](mp4|mkv|mov|avi|flv|webm|wmv)$')""",
)(lambda i, *_: tables.media_files(i.video.select("video_id", F.concat(F.lit("rec."), F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("video_id") % 10).cast("int"))).alias("path"))))


def _without_failed(i: Inputs) -> DataFrame:
    listed = output.edit_list(i.shared().selected(), i.bins(), i.video)
    return output.without_failed(listed, listed.filter("seq % 4 = 1").select("video_id", "output", "seq"))


query("edit_list_without_failed", f"SELECT * FROM ({EDIT_LIST}) WHERE seq % 4 <> 1")(lambda i, *_: _without_failed(i))
query(
    "cut_overlap",
    """SELECT video_id, round(sum(greatest(0::double, coalesce(before - cut_start, 0::double))), 6) AS overlap_s FROM (
    SELECT *, lag(cut_start + cut_length) OVER (PARTITION BY video_id ORDER BY clip_no) AS before FROM padded) GROUP BY 1""",
)(lambda i, *_: selection.cut_overlap(selection.padded(i.selected())))
query(
    "request_check",
    """SELECT *, CASE WHEN coalesce(path, '') = '' OR coalesce(output, '') = '' THEN 'unset' WHEN path NOT IN (SELECT path FROM video WHERE video_id % 5 <> 2) THEN 'missing' ELSE 'ready' END AS status
    FROM (SELECT video_id, CASE WHEN video_id % 7 <> 3 THEN path END AS path, CASE WHEN video_id % 7 = 5 THEN '' ELSE 'out.mp4' END AS output FROM video)""",
)(
    lambda i, *_: tables.checked_requests(
        i.video.select("video_id", F.when(F.col("video_id") % 7 != 3, F.col("path")).alias("path"), F.when(F.col("video_id") % 7 == 5, "").otherwise("out.mp4").alias("output")),
        i.video.filter("video_id % 5 <> 2"),
    )
)
query(
    "run_outcomes",
    """SELECT video_id, CASE WHEN video_id % 6 = 1 THEN 'no_duration' WHEN video_id % 6 = 4 OR video_id NOT IN (SELECT video_id FROM moments) THEN 'no_moments' ELSE 'done' END AS outcome FROM video""",
)(
    lambda i, *_: output.outcomes(
        i.video.withColumn("duration_s", F.when(F.col("video_id") % 6 == 1, F.lit(0.0)).otherwise(F.col("duration_s"))), i.moments().filter("video_id % 6 <> 4")
    )
)
