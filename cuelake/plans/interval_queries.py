"""Queries over intervals: filters, joins, windows, aggregates, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.timecode import clamp_resume, sample_rate_for
from cuelake.operators import aggregates as A
from cuelake.operators import filters as P
from cuelake.operators import joins as J
from cuelake.operators import sets as U
from cuelake.operators import windows as W
from cuelake.plans import inputs as I
from cuelake.plans.inputs import CTE

QUERIES: dict = {}
ORACLE_SQL: dict = {}
COLOURS = ("red", "green", "blue", "orange", "purple", "teal", "pink", "grey")


def query(name: str, sql: str | None):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(I.segments(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = CTE + sql
        return f

    return put


def cuts_of(s: DataFrame) -> DataFrame:
    return P.cut_points(I.silence(s))


def times_of(s: DataFrame) -> DataFrame:
    """Times in every segment, 977 ms apart."""
    return s.select("media_id", F.explode(F.sequence("start_ms", "end_ms", F.lit(977).cast("bigint"))).alias("t")).distinct()


TIMES = ", times AS (SELECT DISTINCT media_id, unnest(generate_series(start_ms, end_ms, 977)) AS t FROM segments)\n"


def flagship(s: DataFrame) -> DataFrame:
    """Cuts, what they leave, its place in the output, and totals: one row for each clip."""
    cuts, media = cuts_of(s), I.media(s)
    placed = W.timeline(W.kept_ranges(cuts, media))
    return placed.join(A.cut_stats(cuts), "media_id", "left").select(
        "media_id", "clip_no", "start_ms", "end_ms", "in_frame", "out_frame", "out_start", "out_end",
        F.coalesce("n_cuts", F.lit(0)).alias("n_cuts"), F.coalesce("removed_ms", F.lit(0)).alias("removed_ms"),
    )


KEPT = """, closed AS (SELECT media_id, start_ms, end_ms FROM cuts UNION ALL SELECT media_id, duration_ms, duration_ms FROM media),
gaps AS (
  SELECT media_id, CAST(greatest(0, coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS s, start_ms AS e
  FROM closed),
kept AS (
  SELECT m.media_id, coalesce(g.s, 0) AS start_ms, coalesce(g.e, m.duration_ms) AS end_ms
  FROM media m LEFT JOIN (SELECT * FROM gaps WHERE e > s) g USING (media_id)),
framed AS (
  SELECT *, CAST(floor(start_ms*30/1000 + 0.5) AS BIGINT) AS in_frame, CAST(floor(end_ms*30/1000 + 0.5) AS BIGINT) AS out_frame FROM kept),
placed AS (
  SELECT *, row_number() OVER w AS clip_no,
         CAST(coalesce(sum(out_frame - in_frame) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start
  FROM framed WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, end_ms))
"""
query("flagship_timeline", KEPT + """
SELECT p.media_id, clip_no, start_ms, end_ms, in_frame, out_frame, out_start, out_start + out_frame - in_frame AS out_end,
       coalesce(n, 0) AS n_cuts, CAST(coalesce(removed, 0) AS BIGINT) AS removed_ms
FROM placed p LEFT JOIN (SELECT media_id, count(*) AS n, sum(end_ms - start_ms) AS removed FROM cuts GROUP BY 1) c USING (media_id)
""")(flagship)

# --- filters and projections
query("p1_public_shape", "SELECT media_id, ord, start_ms, end_ms, text, language, 'speech' AS type FROM segments")(P.to_public)
query("p2_by_type", "SELECT media_id, ord, type FROM everything WHERE type = 'breath'")(
    lambda s: P.by_type(I.everything(s), "breath").select("media_id", "ord", "type")
)
query("p3_speech_nonblank", "SELECT media_id, ord FROM (SELECT *, CASE WHEN ord % 4 = 2 THEN '  ' ELSE text END AS t FROM segments) WHERE trim(t) <> ''")(
    lambda s: P.speech_nonblank(s.withColumn("text", F.when(F.col("ord") % 4 == 2, "  ").otherwise(F.col("text")))).select("media_id", "ord")
)
query("p3_speech_nonempty", "SELECT media_id, ord FROM segments WHERE text <> ''")(lambda s: P.speech_nonempty(s).select("media_id", "ord"))


def scored(s: DataFrame) -> DataFrame:
    return s.withColumn("no_speech_prob", ((F.col("seg_no") * 13 % 10) / 10)).withColumn("avg_logprob", -(F.col("seg_no") * 7 % 20) / 10)


for _mode, _cond in {
    "speech": "ns <= 0.6 AND lp >= -1.0", "song": "ns <= 0.8 AND lp >= -1.5", "live": "ns <= 0.55 AND lp >= -1.0", "none": "true",
}.items():
    query(f"p4_confident_{_mode}", f"SELECT media_id, ord FROM (SELECT *, (seg_no*13 % 10)/10 AS ns, -(seg_no*7 % 20)/10 AS lp FROM segments) WHERE {_cond}")(
        lambda s, mode=_mode: P.confident(scored(s), mode).select("media_id", "ord")
    )
query("p7_offset", "SELECT media_id, ord, start_ms + media_id * 10 AS start_ms, end_ms + media_id * 10 AS end_ms FROM segments")(
    lambda s: P.offset(s, F.col("media_id") * 10).select("media_id", "ord", "start_ms", "end_ms")
)
query("p8_clamp_resume", "SELECT media_id, greatest(0, least(media_id * 5000, duration_ms - 1000)) AS resume_ms FROM media")(
    lambda s: I.media(s).select("media_id", clamp_resume(F.col("media_id") * 5000, F.col("duration_ms")).alias("resume_ms"))
)
query("p10_cut_points", "SELECT media_id, ord, start_ms, end_ms, type FROM cuts")(cuts_of)
query("p11_drop_subframe", """SELECT * FROM (SELECT media_id, ord, CAST(floor(start_ms*30/1000 + 0.5) AS BIGINT) AS start_frame,
  CAST(floor((start_ms + ord * 20)*30/1000 + 0.5) AS BIGINT) AS end_frame FROM cuts) WHERE end_frame - start_frame >= 1""")(
    lambda s: P.drop_subframe(cuts_of(s).withColumn("end_ms", F.col("start_ms") + F.col("ord") * 20)).select("media_id", "ord", "start_frame", "end_frame")
)
query("p12_resume_keep", "SELECT media_id, ord FROM everything WHERE type = 'speech' AND end_ms <= 20500")(
    lambda s: P.resume_keep(I.everything(s), F.lit(20000)).select("media_id", "ord")
)
query("p13_sample_rate", "SELECT media_id, CASE WHEN d < 600000 THEN 8000 WHEN d < 1800000 THEN 4000 WHEN d < 7200000 THEN 2000 ELSE 1000 END AS rate FROM (SELECT media_id, duration_ms * 40 AS d FROM media)")(
    lambda s: I.media(s).select("media_id", sample_rate_for(F.col("duration_ms") * 40).alias("rate"))
)
query("p14_export_flags", "SELECT media_id, bool_or(type <> 'speech') AS has_cuts, bool_or(type = 'speech' AND trim(coalesce(text, '')) <> '') AS has_speech FROM everything GROUP BY 1")(
    lambda s: P.export_flags(I.everything(s))
)
query("p15_with_duration", "SELECT media_id FROM media WHERE duration_ms - 20000 > 0")(
    lambda s: P.with_duration(I.media(s).withColumn("duration_ms", F.col("duration_ms") - 20000)).select("media_id")
)
query("p16_without_language", "SELECT media_id, seg_no, lang FROM translations WHERE lang <> 'yy'")(
    lambda s: P.without_language(I.translations(s), "yy").select("media_id", "seg_no", "lang")
)
query("p17_markers", "SELECT media_id, ord, CASE WHEN type = 'breath' THEN 'Breath' ELSE 'Silence' END AS name, start_ms * 254016000 AS start_ticks, (end_ms - start_ms) * 254016000 AS length_ticks FROM silence")(
    lambda s: P.markers(I.silence(s))
)

# --- joins
query("j1_assign_max_overlap", """, o AS (
  SELECT s.media_id, s.ord, d.ord AS dord, d.speaker, least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms) AS n
  FROM segments s JOIN diar d ON s.media_id = d.media_id AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms)
SELECT s.media_id, s.ord, coalesce((SELECT speaker FROM o WHERE o.media_id = s.media_id AND o.ord = s.ord ORDER BY n DESC, dord LIMIT 1), 'UNKNOWN') AS speaker FROM segments s""")(
    lambda s: J.assign_max_overlap(s, I.diar(s)).select("media_id", "ord", "speaker")
)
query("j2_assign_dominant", """, o AS (
  SELECT s.media_id, s.ord, d.speaker, sum(least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms)) AS n, min(d.ord) AS dord
  FROM segments s JOIN diar d ON s.media_id = d.media_id AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms GROUP BY 1, 2, 3)
SELECT media_id, ord, speaker FROM (SELECT *, row_number() OVER (PARTITION BY media_id, ord ORDER BY n DESC, dord) AS r FROM o) WHERE r = 1""")(
    lambda s: J.assign_dominant(s, I.diar(s)).select("media_id", "ord", "speaker")
)
query("j3_match_by_start", """SELECT d.media_id, d.ord, (SELECT min(s.ord) FROM segments s WHERE s.media_id = d.media_id AND abs(s.start_ms - d.start_ms) < 500) AS matched_ord FROM diar d""")(
    lambda s: J.match_by_start(s, I.diar(s)).select("media_id", "ord", "matched_ord")
)
query("j4_clip_speaker", KEPT + """, sp AS (SELECT media_id, speaker FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY f, speaker) AS r FROM (SELECT media_id, speaker, min(ord) AS f FROM segments GROUP BY 1, 2)) WHERE r = 1)
SELECT k.media_id, k.start_ms, k.end_ms, coalesce((SELECT s.speaker FROM segments s WHERE s.media_id = k.media_id AND s.start_ms <= floor((k.start_ms + k.end_ms)/2) AND floor((k.start_ms + k.end_ms)/2) < s.end_ms ORDER BY s.ord LIMIT 1), sp.speaker) AS speaker
FROM kept k JOIN sp USING (media_id)""")(
    lambda s: J.clip_speaker(W.kept_ranges(cuts_of(s), I.media(s)), s, W.speaker_labels(s)).select("media_id", "start_ms", "end_ms", "speaker")
)
query("j5_clip_name", """SELECT c.media_id, c.ord, (SELECT concat('R', d.ord) FROM diar d WHERE d.media_id = c.media_id AND floor((c.start_ms + c.end_ms)/2) >= d.start_ms - 150 AND floor((c.start_ms + c.end_ms)/2) < d.end_ms + 150 ORDER BY d.ord LIMIT 1) AS name FROM silence c""")(
    lambda s: J.clip_name(I.silence(s), I.diar(s).withColumn("name", F.concat(F.lit("R"), F.col("ord").cast("string")))).select("media_id", "ord", "name")
)
query("j6_bucket_segment", """, b AS (SELECT media_id, k AS bucket, CAST(floor(k * duration_ms / 50) AS BIGINT) AS t FROM media, range(50) r(k)),
f AS (SELECT b.media_id, b.bucket, b.t, (SELECT min(s.ord) FROM segments s WHERE s.media_id = b.media_id AND s.end_ms > b.t) AS ord FROM b)
SELECT f.media_id, f.bucket, CASE WHEN s.start_ms <= f.t THEN f.ord END AS ord FROM f LEFT JOIN segments s ON s.media_id = f.media_id AND s.ord = f.ord""")(
    lambda s: J.bucket_segment(s, I.media(s))
)
query("j7_segment_at", TIMES + """SELECT t.media_id, t.t, coalesce(
  (SELECT min(s.ord) FROM silence s WHERE s.media_id = t.media_id AND s.start_ms <= t.t AND t.t < s.end_ms),
  (SELECT s.ord FROM silence s WHERE s.media_id = t.media_id AND s.start_ms <= t.t ORDER BY s.start_ms DESC, s.ord DESC LIMIT 1)) AS ord FROM times t""")(
    lambda s: J.segment_at(times_of(s), I.silence(s))
)
query("j8_skip_map", TIMES.replace("start_ms, end_ms", "start_ms - gap_ms, end_ms") + """SELECT t.media_id, t.t, least((SELECT c.end_ms + 10 FROM cuts c WHERE c.media_id = t.media_id AND t.t >= c.start_ms - 20 AND t.t < c.end_ms - 50 ORDER BY c.ord LIMIT 1), CASE WHEN EXISTS (SELECT 1 FROM cuts c WHERE c.media_id = t.media_id AND t.t >= c.start_ms - 20 AND t.t < c.end_ms - 50) THEN duration_ms END) AS jump_to
FROM times t JOIN media USING (media_id)""")(
    lambda s: J.skip_map(times_of(s.withColumn("start_ms", F.col("start_ms") - F.col("gap_ms"))), cuts_of(s), I.media(s))
)
query("j9_not_fully_cut", """, wide AS (SELECT media_id, ord, start_ms - 300 * (ord % 3) AS start_ms, end_ms - 2000 + 800 * (ord % 4) AS end_ms FROM segments)
SELECT s.media_id, s.ord FROM segments s WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.media_id = s.media_id AND w.start_ms <= s.start_ms AND w.end_ms >= s.end_ms)""")(
    lambda s: J.not_fully_cut(s, s.select("media_id", (F.col("start_ms") - 300 * (F.col("ord") % 3)).alias("start_ms"), (F.col("end_ms") - 2000 + 800 * (F.col("ord") % 4)).alias("end_ms"))).select("media_id", "ord")
)
query("j10_removed_before", TIMES + """SELECT t.media_id, t.t, CAST(coalesce((SELECT sum(CASE WHEN c.end_ms <= t.t THEN c.end_ms - c.start_ms WHEN c.start_ms < t.t THEN t.t - c.start_ms ELSE 0 END) FROM cuts c WHERE c.media_id = t.media_id), 0) AS BIGINT) AS removed_ms FROM times t""")(
    lambda s: J.removed_before(times_of(s), cuts_of(s))
)
query("j11_silent_clips", """SELECT d.media_id, d.ord FROM diar d WHERE EXISTS (SELECT 1 FROM segments r WHERE r.media_id = d.media_id AND d.start_ms >= r.start_ms - 200 AND d.end_ms <= r.end_ms + 200)""")(
    lambda s: J.silent_clips(I.diar(s), s).select("media_id", "ord")
)
query("j12_apply_labels", """SELECT media_id, ord, CASE WHEN speaker = 'SPEAKER_01' AND media_id % 3 = 0 THEN 'Guest' WHEN media_id % 4 = 0 AND speaker = 'SPEAKER_01' THEN 'Unknown' WHEN speaker = 'SPEAKER_00' THEN 'Speaker A' ELSE 'Speaker B' END AS speaker_label FROM segments""")(
    lambda s: J.apply_labels(
        s,
        W.speaker_labels(s).filter("NOT (media_id % 4 = 0 AND speaker = 'SPEAKER_01')").withColumn("label", F.when(F.col("speaker") == "SPEAKER_00", "Speaker A").otherwise("Speaker B")),
        s.select("media_id", "speaker").distinct().withColumn("label", F.when((F.col("media_id") % 3 == 0) & (F.col("speaker") == "SPEAKER_01"), " Guest ").otherwise("  ")),
    ).select("media_id", "ord", "speaker_label")
)
query("j14_align", "SELECT s.media_id, s.seg_no, coalesce(t.text, '') AS translation FROM segments s LEFT JOIN (SELECT * FROM translations WHERE lang = 'xx') t USING (media_id, seg_no)")(
    lambda s: J.align(s, I.translations(s).filter("lang = 'xx'")).select("media_id", "seg_no", "translation")
)
query("j15_reuse_drafts", """, f AS (SELECT media_id AS session_id, seg_no AS index, 'xx' AS lang, text FROM segments)
SELECT session_id, index, CASE WHEN index % 4 <> 3 AND index % 5 <> 1 THEN concat('[', text, ']') END AS reused FROM f""")(
    lambda s: J.reuse_drafts(
        s.select(F.col("media_id").alias("session_id"), F.col("seg_no").alias("index"), F.lit("xx").alias("lang"), "text"),
        s.select(
            F.col("media_id").alias("session_id"), F.col("seg_no").alias("index"), F.lit("xx").alias("lang"),
            F.when(F.col("seg_no") % 4 == 3, "other words").otherwise(F.regexp_replace("text", r"[.]$", "")).alias("text"),
            F.when(F.col("seg_no") % 5 == 1, "").otherwise(F.concat(F.lit("["), "text", F.lit("]"))).alias("cached"),
        ),
    ).select("session_id", "index", "reused")
)
query("j16_untranslated", "SELECT s.media_id, s.seg_no, l.lang FROM segments s, (VALUES ('xx'), ('yy'), ('zz')) l(lang) WHERE NOT EXISTS (SELECT 1 FROM translations t WHERE t.media_id = s.media_id AND t.seg_no = s.seg_no AND t.lang = l.lang AND t.text <> '')")(
    lambda s: J.untranslated(s, I.translations(s), ["xx", "yy", "zz"]).select("media_id", "seg_no", "lang")
)
query("j17_track_drift", """, v AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS n FROM segments), a AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS n FROM diar)
SELECT media_id, max(abs(v.start_ms - a.start_ms)) AS drift_ms FROM v JOIN a USING (media_id, n) WHERE n <= 4 GROUP BY 1""")(
    lambda s: J.track_drift(s, I.diar(s))
)
SLICES = """, edges AS (SELECT DISTINCT media_id, unnest([start_ms, end_ms]) AS t0 FROM diar),
slices AS (SELECT media_id, t0, lead(t0) OVER (PARTITION BY media_id ORDER BY t0) AS t1 FROM edges)
"""
query("j18_active_speakers", SLICES + "SELECT s.media_id, t0 AS start_ms, t1 AS end_ms, count(*) AS active FROM slices s JOIN diar d ON d.media_id = s.media_id AND d.start_ms < t1 AND d.end_ms > t0 WHERE t1 IS NOT NULL GROUP BY 1, 2, 3")(
    lambda s: J.active_speakers(
        U.boundaries(I.diar(s)).withColumn("end_ms", F.lead("t").over(W.in_order("t"))).filter("end_ms IS NOT NULL").withColumnRenamed("t", "start_ms"), I.diar(s)
    )
)
query("j20_palette", f""", f AS (SELECT media_id, speaker, row_number() OVER (PARTITION BY media_id ORDER BY min(ord), speaker) - 1 AS pos FROM segments GROUP BY 1, 2)
SELECT media_id, speaker, list_extract({list(COLOURS)}, CAST(pos % 8 + 1 AS INT)) AS colour, pos % 6 + 1 AS camera FROM f""")(
    lambda s: J.palette(W.speaker_labels(s), COLOURS).select("media_id", "speaker", "colour", "camera")
)
PATCH = ", patch AS (SELECT media_id, seg_no, 'xx' AS lang, CASE WHEN seg_no % 2 = 0 THEN '' ELSE concat('new ', seg_no) END AS text FROM segments)\n"
for _mode in ("partial", "final"):
    query(f"j21_upsert_{_mode}", PATCH + f"SELECT media_id, seg_no, lang, coalesce({"p.text" if _mode == "final" else "nullif(p.text, '')"}, t.text, '') AS text FROM translations t FULL JOIN patch p USING (media_id, seg_no, lang)")(
        lambda s, mode=_mode: J.upsert_translations(
            I.translations(s),
            s.select("media_id", "seg_no", F.lit("xx").alias("lang"), F.when(F.col("seg_no") % 2 == 0, "").otherwise(F.concat(F.lit("new "), F.col("seg_no").cast("string"))).alias("text")),
            mode,
        )
    )
query("j22_apply_edits", "SELECT media_id, ord, CASE WHEN ord % 3 = 0 THEN 'edited' ELSE text END AS text FROM segments")(
    lambda s: J.apply_edits(s, s.filter("ord % 3 = 0").select("media_id", "ord", F.lit(" edited ").alias("text"))).select("media_id", "ord", "text")
)

# --- windows
query("w1_merge_turns", """, c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS ch FROM diar WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, ord)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS island FROM c),
t AS (SELECT media_id, island, min(start_ms) AS s, max(end_ms) AS e, min(speaker) AS speaker FROM i GROUP BY 1, 2)
SELECT * FROM (SELECT media_id, CAST(island AS BIGINT) AS ord, s AS start_ms, coalesce(lead(s) OVER (PARTITION BY media_id ORDER BY island), e) AS end_ms, speaker FROM t) WHERE end_ms > start_ms""")(
    lambda s: W.merge_turns(I.diar(s))
)
query("w2_resolve_overlaps", SLICES + """, won AS (
  SELECT media_id, t0, t1, speaker FROM (SELECT s.media_id, t0, t1, d.speaker, row_number() OVER (PARTITION BY s.media_id, t0 ORDER BY d.start_ms DESC, d.ord) AS r
    FROM slices s JOIN diar d ON d.media_id = s.media_id AND d.start_ms < t1 AND d.end_ms > t0 WHERE t1 IS NOT NULL) WHERE r = 1),
m AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND lag(t1) OVER w = t0 THEN 0 ELSE 1 END AS ch FROM won WINDOW w AS (PARTITION BY media_id ORDER BY t0)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY media_id ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT media_id, CAST(island AS BIGINT) AS ord, min(t0) AS start_ms, max(t1) AS end_ms, min(speaker) AS speaker FROM i GROUP BY 1, 2""")(
    lambda s: W.resolve_overlaps(I.diar(s))
)
CHUNKS = """, plan AS (SELECT media_id, duration_ms, chunk_no, chunk_no * 60000 AS s, least(chunk_no * 60000 + 60000 + {0}, duration_ms) AS e FROM media, range(1000) r(chunk_no) WHERE chunk_no * 60000 <= duration_ms - 1),
chunked AS (SELECT p.media_id, p.chunk_no, x.ord, greatest(p.s, x.start_ms) AS start_ms, least(p.e, x.end_ms) AS end_ms, x.{2} FROM plan p JOIN {1} x ON x.media_id = p.media_id AND x.start_ms < p.e AND p.s < x.end_ms)
"""
query("w3_merge_silence", CHUNKS.format(2000, "silence", "type") + """, o AS (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY chunk_no, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM chunked),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms >= reach + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY chunk_no, ord ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT media_id, CAST(island AS BIGINT) AS ord, arg_min(start_ms, chunk_no * 100000 + ord) AS start_ms, max(end_ms) AS end_ms, arg_min(type, chunk_no * 100000 + ord) AS type FROM i GROUP BY 1, 2""")(
    lambda s: W.merge_silence(I.chunked(I.silence(s), I.media(s), 2000))
)
query("w4_dedupe_chunks", CHUNKS.format(5000, "segments", "text") + """, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY chunk_no, ord) AS k FROM chunked),
walk AS (
  SELECT media_id, k, ord, chunk_no, start_ms, end_ms, end_ms AS last_end, true AS kept FROM n WHERE k = 1
  UNION ALL SELECT n.media_id, n.k, n.ord, n.chunk_no, n.start_ms, n.end_ms, CASE WHEN n.start_ms >= w.last_end - 100 THEN n.end_ms ELSE w.last_end END, n.start_ms >= w.last_end - 100
  FROM walk w JOIN n ON n.media_id = w.media_id AND n.k = w.k + 1)
SELECT media_id, chunk_no, ord, start_ms, end_ms FROM walk WHERE kept""")(
    lambda s: W.dedupe_chunks(I.chunked(s.select("media_id", "ord", "start_ms", "end_ms", "text"), I.media(s), 5000)).select("media_id", "chunk_no", "ord", "start_ms", "end_ms")
)
RUNS = """, c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS ch FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY ord)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY media_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM c),
runs AS (SELECT media_id, CAST(island AS BIGINT) AS ord, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker) AS speaker FROM r GROUP BY 1, 2)
"""
query("w5_same_speaker_ranges", RUNS + "SELECT * FROM runs")(W.same_speaker_ranges)
query("w6_group_turns", """, o AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w < 500 THEN 0 ELSE 1 END AS ch FROM diar WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, ord)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT media_id, CAST(island AS BIGINT) AS ord, min(start_ms) AS start_ms, arg_max(end_ms, start_ms * 1000 + ord) AS end_ms, min(speaker) AS speaker FROM i GROUP BY 1, 2""")(
    lambda s: W.group_turns(I.diar(s))
)
query("w7_turn_clips", RUNS + """SELECT media_id, r.ord, speaker, CAST(coalesce(floor((lag(end_ms) OVER w + start_ms)/2), 0) AS BIGINT) AS start_ms, CAST(coalesce(floor((end_ms + lead(start_ms) OVER w)/2), duration_ms) AS BIGINT) AS end_ms FROM runs r JOIN media USING (media_id) WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, r.ord)""")(
    lambda s: W.turn_clips(W.same_speaker_ranges(s), I.media(s))
)
query("w8_kept_ranges", KEPT + "SELECT * FROM kept")(lambda s: W.kept_ranges(cuts_of(s), I.media(s)))
query("w9_kept_clips", KEPT + """, c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS ch FROM segments WHERE media_id % 2 = 0 WINDOW w AS (PARTITION BY media_id ORDER BY ord)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY media_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM c),
runs AS (SELECT media_id, island, min(start_ms) AS s, max(end_ms) AS e, min(speaker) AS speaker FROM r GROUP BY 1, 2)
SELECT media_id, CAST(coalesce(floor((lag(e) OVER w + s)/2), 0) AS BIGINT) AS start_ms, CAST(coalesce(floor((e + lead(s) OVER w)/2), duration_ms) AS BIGINT) AS end_ms, speaker FROM runs JOIN media USING (media_id) WINDOW w AS (PARTITION BY media_id ORDER BY s, island)
UNION ALL SELECT media_id, start_ms, end_ms, NULL FROM kept WHERE media_id % 2 = 1""")(
    lambda s: W.kept_clips(s.withColumn("speaker", F.when(F.col("media_id") % 2 == 0, F.col("speaker"))), cuts_of(s), I.media(s))
)
query("w11_close_gaps", """, g AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w > 20 THEN 1 ELSE 0 END AS gap FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, ord)),
m AS (SELECT *, max(gap) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS moves FROM g),
e AS (SELECT media_id, ord, end_ms - start_ms AS len, CASE WHEN moves = 1 THEN max(CASE WHEN moves = 0 THEN end_ms END) OVER u + sum(CASE WHEN moves = 1 THEN end_ms - start_ms ELSE 0 END) OVER u ELSE end_ms END AS ne FROM m WINDOW u AS (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING))
SELECT media_id, ord, CAST(ne - len AS BIGINT) AS start_ms, CAST(ne AS BIGINT) AS end_ms FROM e""")(W.close_gaps)
query("w12_numbering", "SELECT media_id, ord, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS number FROM segments WHERE trim(text) <> ''")(
    lambda s: W.numbered(P.speech_nonblank(s)).select("media_id", "ord", "number")
)
query("w13_speaker_labels", "SELECT media_id, speaker, concat('Speaker ', chr(CAST(65 + row_number() OVER (PARTITION BY media_id ORDER BY min(ord), speaker) - 1 AS INT))) AS label FROM segments GROUP BY 1, 2")(
    lambda s: W.speaker_labels(s).select("media_id", "speaker", "label")
)
query("w14_visible_prefix", """, a AS (SELECT s.media_id, s.seg_no, CASE WHEN coalesce(t.text, '') = '' THEN 1 ELSE 0 END AS missing FROM segments s LEFT JOIN (SELECT * FROM translations WHERE lang = 'xx') t USING (media_id, seg_no)),
b AS (SELECT *, coalesce(sum(missing) OVER (PARTITION BY media_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT media_id, seg_no, missing = 1 AS pending FROM b WHERE before = 0""")(
    lambda s: W.visible_prefix(J.align(s, I.translations(s).filter("lang = 'xx'"))).select("media_id", "seg_no", "pending")
)
query("w15_word_gaps", "SELECT media_id, seg_no, word_no, greatest(45, least(900, coalesce(start_ms - lag(start_ms) OVER (PARTITION BY media_id ORDER BY seg_no, word_no), 0))) AS gap_ms FROM words")(
    lambda s: W.word_gaps(I.words(s)).select("media_id", "seg_no", "word_no", "gap_ms")
)
query("w16_group_lines", """, n AS (SELECT media_id, seg_no, word_no, regexp_matches(word, '[.!?。？！]$') AS hard, row_number() OVER (PARTITION BY media_id ORDER BY seg_no, word_no) AS k FROM words),
walk AS (
  SELECT media_id, seg_no, word_no, k, 1 AS line, 1 AS held, CASE WHEN hard THEN 1 ELSE 0 END AS ends, false AS closed FROM n WHERE k = 1
  UNION ALL SELECT media_id, seg_no, word_no, k, line, held, ends, CASE WHEN hard THEN ends >= 2 ELSE held >= 28 END FROM (
    SELECT n.media_id, n.seg_no, n.word_no, n.k, n.hard, w.line + CASE WHEN w.closed THEN 1 ELSE 0 END AS line, CASE WHEN w.closed THEN 1 ELSE w.held + 1 END AS held,
           CASE WHEN w.closed THEN 0 ELSE w.ends END + CASE WHEN n.hard THEN 1 ELSE 0 END AS ends FROM walk w JOIN n ON n.media_id = w.media_id AND n.k = w.k + 1))
SELECT media_id, seg_no, word_no, CAST(line AS BIGINT) AS line_no FROM walk""")(lambda s: W.group_lines(I.words(s)))
ORACLE_SQL["w16_group_lines"] = ORACLE_SQL["w16_group_lines"].replace("WITH base", "WITH RECURSIVE base")
ORACLE_SQL["w4_dedupe_chunks"] = ORACLE_SQL["w4_dedupe_chunks"].replace("WITH base", "WITH RECURSIVE base")
query("w17_speaker_changes", "SELECT * FROM (SELECT media_id, start_ms AS at_ms, lag(speaker) OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS from_speaker, speaker AS to_speaker FROM diar) WHERE from_speaker <> to_speaker")(
    lambda s: W.speaker_changes(I.diar(s))
)
query("w19_batches", "SELECT media_id, ord, CAST(floor((row_number() OVER w - 1) / 3) AS BIGINT) AS batch_no, (row_number() OVER w - 1) % 3 + 1 AS in_batch FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY ord)")(
    lambda s: W.batches(s, 3).select("media_id", "ord", "batch_no", "in_batch")
)
query("w20_chunk_plan", "SELECT media_id, chunk_no, chunk_no * 60000 AS start_ms, least(chunk_no * 60000 + 65000, duration_ms) AS end_ms FROM media, range(1000) r(chunk_no) WHERE chunk_no * 60000 <= duration_ms - 1")(
    lambda s: W.chunk_plan(I.media(s), 60_000, 5_000)
)

# --- aggregates
query("a1_cut_stats", "SELECT media_id, count(*) AS n_cuts, CAST(sum(end_ms - start_ms) AS BIGINT) AS removed_ms FROM cuts GROUP BY 1")(lambda s: A.cut_stats(cuts_of(s)))
query("a2_type_counts", "SELECT media_id, count(*) FILTER (type = 'silence') AS n_silence, count(*) FILTER (type = 'breath') AS n_breath FROM everything GROUP BY 1")(lambda s: A.type_counts(I.everything(s)))
query("a3_distinct_speakers", "SELECT media_id, count(DISTINCT speaker) AS n_speakers FROM segments GROUP BY 1")(A.distinct_speakers)
query("a4_duration", "SELECT media_id, coalesce(max(end_ms), 1000) AS duration_ms FROM segments GROUP BY 1")(A.duration)


def pair_sums(s: DataFrame) -> DataFrame:
    return J.overlap_sums(J.overlap_pairs(s.select("media_id", "ord", "start_ms", "end_ms"), I.diar(s)))


query("a6_overlap_sums", "SELECT s.media_id, s.ord, d.speaker, CAST(sum(least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms)) AS BIGINT) AS shared_ms, min(d.ord) AS first_ord FROM segments s JOIN diar d ON s.media_id = d.media_id AND s.start_ms < d.end_ms AND d.start_ms < s.end_ms GROUP BY 1, 2, 3")(
    pair_sums
)
query("a7_mean_probability", "SELECT media_id, seg_no, CAST(round(avg(prob) * 1000000) AS BIGINT) AS mean_millionths FROM words GROUP BY 1, 2")(
    lambda s: A.mean_probability(I.words(s), "media_id", "seg_no").select("media_id", "seg_no", F.round(F.col("mean_prob") * 1000000).cast("bigint").alias("mean_millionths"))
)
query("a8_token_share", """, c AS (SELECT media_id, seg_no, trim(lower(word), '.,!?;:、，。') AS token, count(*) AS n FROM words GROUP BY ALL)
SELECT media_id, seg_no, CASE WHEN sum(n) >= 5 THEN CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) ELSE 0.0::DOUBLE END AS share FROM c GROUP BY 1, 2""")(lambda s: A.token_share(I.words(s), "media_id", "seg_no"))
query("a9_pair_share", """, t AS (SELECT media_id, seg_no, word_no, trim(lower(word), '.,!?;:、，。') AS token FROM words),
p AS (SELECT *, lead(token) OVER (PARTITION BY media_id, seg_no ORDER BY word_no) AS nx FROM t),
c AS (SELECT media_id, seg_no, token || ' ' || nx AS pair, count(*) AS n FROM p WHERE nx IS NOT NULL GROUP BY ALL)
SELECT media_id, seg_no, CASE WHEN sum(n) >= 5 THEN CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) ELSE 0.0::DOUBLE END AS share FROM c GROUP BY 1, 2""")(lambda s: A.pair_share(I.words(s), "media_id", "seg_no"))
query("a10_frame_totals", KEPT + "SELECT media_id, CAST(sum(floor((end_ms - start_ms)*30/1000 + 0.5)) AS BIGINT) AS by_length, CAST(sum(out_frame - in_frame) AS BIGINT) AS by_ends FROM framed GROUP BY 1")(
    lambda s: A.frame_totals(W.kept_ranges(cuts_of(s), I.media(s)))
)
query("a12_has_translation", "SELECT media_id, lang, bool_or(text <> '') AS has_any FROM translations GROUP BY 1, 2")(lambda s: A.has_translation(I.translations(s)))
query("a13_source_language", "SELECT media_id, arg_min(language, ord) AS language FROM segments WHERE language IS NOT NULL GROUP BY 1")(A.source_language)
BLOCKS = ", c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS ch FROM {0} WINDOW w AS (PARTITION BY media_id ORDER BY ord)), b AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY media_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM c)\n"
query("a14_speaker_blocks", BLOCKS.format("segments") + "SELECT media_id, block, min(speaker) AS speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, coalesce(string_agg(trim(text), ' ' ORDER BY ord) FILTER (trim(text) <> ''), '') AS text FROM b GROUP BY 1, 2")(
    lambda s: A.speaker_blocks(s)
)
query("a15_paragraph", "SELECT media_id, coalesce(string_agg(trim(text), ' ' ORDER BY ord) FILTER (trim(text) <> ''), '') AS text FROM segments GROUP BY 1")(A.paragraph)
query("a16_bilingual_blocks", ", al AS (SELECT s.*, coalesce(t.text, '') AS translation FROM segments s LEFT JOIN (SELECT * FROM translations WHERE lang = 'xx') t USING (media_id, seg_no))" + BLOCKS.format("al") + "SELECT media_id, block, min(speaker) AS speaker, coalesce(string_agg(trim(text), ' ' ORDER BY ord) FILTER (trim(text) <> ''), '') AS text, coalesce(string_agg(trim(translation), ' ' ORDER BY ord) FILTER (trim(translation) <> ''), '') AS translation FROM b GROUP BY 1, 2")(
    lambda s: A.speaker_blocks(J.align(s, I.translations(s).filter("lang = 'xx'"))).select("media_id", "block", "speaker", "text", "translation")
)
query("a17_wide_translations", "SELECT media_id, seg_no, max(text) FILTER (lang = 'xx') AS xx, max(text) FILTER (lang = 'yy') AS yy FROM translations GROUP BY 1, 2")(lambda s: A.wide_translations(I.translations(s), ["xx", "yy"]))
query("a18_track_gaps", "SELECT media_id, count(*) FILTER (abs(start_ms - p) > 20) AS n_gaps FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS p FROM segments) GROUP BY 1")(A.track_gaps)
query("a19_clip_delta", "SELECT *, n_after - n_before AS delta FROM (SELECT media_id, (SELECT count(*) FROM segments s WHERE s.media_id = m.media_id) AS n_before, (SELECT count(*) FROM cuts s WHERE s.media_id = m.media_id) AS n_after FROM media m)")(lambda s: A.clip_delta(s, cuts_of(s)))
query("a20_progress", CHUNKS.format(5000, "segments", "text") + "SELECT media_id, chunk_no, count(*) AS n_rows, max(end_ms) AS upto_ms FROM chunked GROUP BY 1, 2")(
    lambda s: A.progress(I.chunked(s.select("media_id", "ord", "start_ms", "end_ms", "text"), I.media(s), 5000))
)
query("a21_corpus_report", "SELECT role, speaker, count(*) AS n_rows, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM segments GROUP BY ROLLUP (role, speaker)")(A.corpus_report)

# --- order, limits, sets
query("o1_by_start", "SELECT media_id, ord, start_ms FROM everything")(lambda s: U.by_start(I.everything(s)).select("media_id", "ord", "start_ms"))
query("o2_end_first", "SELECT media_id, ord, row_number() OVER (PARTITION BY media_id ORDER BY start_ms DESC, ord DESC) AS step FROM cuts")(lambda s: U.end_first(cuts_of(s)).select("media_id", "ord", "step"))
query("o3_display_order", "SELECT media_id, ord, row_number() OVER (PARTITION BY media_id ORDER BY start_ms DESC, ord) AS place FROM segments")(lambda s: U.display_order(s, True).select("media_id", "ord", "place"))
query("o5_first_rows", "SELECT media_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ord) AS n FROM segments) WHERE n <= 2")(lambda s: U.first_rows(s, "media_id", 2, "ord").select("media_id", "ord"))
query("o6_last_characters", "SELECT media_id, right(string_agg(text, ' ' ORDER BY ord), 200) AS context FROM segments GROUP BY 1")(U.last_characters)
query("u1_merge_transcript", "SELECT media_id, ord, type, start_ms FROM everything WHERE type <> 'speech' OR end_ms <= 20500 UNION ALL SELECT media_id, ord + 500, type, start_ms FROM segments WHERE start_ms >= 20000")(
    lambda s: U.merge_transcript(I.everything(s), s.filter("start_ms >= 20000").withColumn("ord", F.col("ord") + 500), F.lit(20000)).select("media_id", "ord", "type", "start_ms")
)
query("u2_replace_silence", "SELECT media_id, ord, type FROM segments UNION ALL SELECT media_id, ord, type FROM cuts")(lambda s: U.replace_silence(I.everything(s), cuts_of(s)).select("media_id", "ord", "type"))
query("u4_with_sessions", "SELECT media_id, ord, true AS prev FROM segments WHERE ord < 2 UNION ALL SELECT media_id, ord, false FROM segments WHERE ord >= 2")(lambda s: U.with_sessions(s.filter("ord < 2"), s.filter("ord >= 2")).select("media_id", "ord", "prev"))
query("u5_boundaries", "SELECT DISTINCT media_id, unnest([start_ms, end_ms]) AS t FROM diar")(lambda s: U.boundaries(I.diar(s)))
query("u6_distinct_in_order", "SELECT media_id, role, min(ord) AS first_ord FROM segments GROUP BY 1, 2")(lambda s: U.distinct_in_order(s, "role", "media_id"))
