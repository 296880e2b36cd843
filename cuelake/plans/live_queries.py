"""Queries over live sessions in batch form; tests hold streams against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import CLINGS, LEAST_PAIR_TOKENS, LEAST_TOKENS, MADE_UP_PHRASES, MAX_PAIR_SHARE, MAX_TOKEN_SHARE, TOKEN_EDGES, words
from cuelake.operators.joins import agreement
from cuelake.plans import inputs as I
from cuelake.plans.inputs import CTE
from cuelake.sources import scratch
from cuelake.streaming import changes as C
from cuelake.streaming import live as L

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(I.segments(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = CTE.replace("WITH base", "WITH RECURSIVE base", 1) + sql
        return f

    return put


#: Items of exploded rows that one task is to hold; Spark sees only the rows before the explosion when it joins small parts.
TASK_ITEMS = 1_000_000


def parts(rows: DataFrame, items: Column) -> int:
    """A number of parts that follows the number of items that will be made of the rows."""
    return int((rows.agg(F.sum(items.cast("double"))).first()[0] or 0) // TASK_ITEMS) + 1


def frames(s: DataFrame) -> DataFrame:
    """Frames of 30 ms of each conversation; speech where the frame's start lies in a turn."""
    length = F.floor(F.col("duration_ms") / 30).cast("bigint") + 1
    turns = s.select("media_id", F.ceil(F.col("start_ms") / 30).cast("bigint").alias("b"), F.ceil(F.col("end_ms") / 30).cast("bigint").alias("e"))
    ends = I.media(s).select("media_id", length.alias("b"), length.alias("e"))
    marks = turns.unionByName(ends)
    marks = marks.repartition(parts(ends, F.col("e")), "media_id")
    # What earlier turns cover is speech already; what lies between that and a turn, or the end, is quiet.
    before = Window.partitionBy("media_id").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = marks.withColumn("upto", F.greatest(F.coalesce(F.max("e").over(before), F.lit(0)), F.lit(0)))
    here = F.array(
        F.struct(F.col("upto").alias("b"), F.col("b").alias("e"), F.lit(False).alias("is_speech")),
        F.struct(F.greatest("b", "upto").alias("b"), F.col("e").alias("e"), F.lit(True).alias("is_speech")),
    )
    span = spans.select("media_id", F.explode(F.filter(here, lambda x: x["b"] < x["e"])).alias("x"))
    both = span.select("media_id", "x.is_speech", F.explode(F.sequence(F.col("x.b"), F.col("x.e") - 1)).alias("frame_no"))
    return both.select(F.col("media_id").alias("session_id"), "frame_no", "is_speech", F.timestamp_millis(F.col("frame_no") * 30).alias("event_ts"))


def hypotheses(s: DataFrame) -> DataFrame:
    """For each turn, cycles that see three words more each, the last three unsure at times; then a stop that sees all."""
    n = F.greatest(F.size(words(F.col("text"))), F.lit(0))
    w = I.words(s).withColumn("session_id", F.col("media_id") * 1000 + F.col("seg_no")).repartition(parts(s, n * (n + 18) / 6), "session_id")
    item = F.struct("word_no", "word", "start_ms", (F.col("start_ms") + 10).alias("end_ms"), F.lit(0.5).alias("probability"))
    held = w.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("ws"))
    last = F.greatest(F.ceil((F.size("ws") - 6) / 3), F.lit(0)).cast("bigint") + 1
    rows = held.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("cycle")).withColumn("stop", F.col("cycle") == last)
    seen = F.when(F.col("stop"), F.size("ws")).otherwise(F.least(F.size("ws"), (F.col("cycle") * 3 + 6).cast("int")))

    def said(x, i):
        unsure = ~F.col("stop") & (i >= seen - 3) & ((x["word_no"] + F.col("cycle")) % 11 == 0)
        return F.struct(
            F.when(unsure, F.concat(x["word"], F.lit("~"))).otherwise(x["word"]).alias("word"), x["start_ms"].alias("start_ms"),
            x["end_ms"].alias("end_ms"), x["probability"].alias("probability"),
        )

    return rows.select(
        "session_id", "cycle", F.lit(0).cast("bigint").alias("buffer_start_ms"), F.lit(6000).cast("bigint").alias("buffer_dur_ms"),
        F.when(F.col("stop"), "stop").otherwise("partial").alias("kind"), F.transform(F.slice("ws", F.lit(1), seen), said).alias("words"),
        F.timestamp_millis(F.col("cycle") * 500).alias("event_ts"),
    )


def decoded(s: DataFrame, kind: str, dur_ms: int, probability: float = 0.9) -> DataFrame:
    """One cycle for each turn that sees all its words, each eleventh unsure; the buffer ends 100 ms after the last."""
    w = I.words(s).withColumn("session_id", F.col("media_id") * 1000 + F.col("seg_no"))
    sure = F.when(F.col("word_no") % 11 == 10, 0.5).otherwise(probability)
    item = F.struct("word_no", "word", "start_ms", (F.col("start_ms") + 10).alias("end_ms"), sure.alias("probability"))
    held = w.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("ws"), F.max("start_ms").alias("last_ms"))
    return held.select(
        "session_id", F.lit(0).cast("bigint").alias("cycle"), (F.col("last_ms") + 110 - dur_ms).alias("buffer_start_ms"), F.lit(dur_ms).cast("bigint").alias("buffer_dur_ms"),
        F.lit(kind).alias("kind"), F.transform("ws", lambda x: x.dropFields("word_no")).alias("words"), F.timestamp_millis(F.lit(0)).alias("event_ts"),
    )


def paused(s: DataFrame) -> DataFrame:
    """A pause after each turn that sees all its words, then a made-up hypothesis in a pause, then another in a stop."""
    pause = decoded(s, "pause", 6000)
    end = F.element_at("words", -1)["end_ms"]
    thanks = F.array(*[F.struct(F.lit(w).alias("word"), (end + k).alias("start_ms"), (end + k + 5).alias("end_ms"), F.lit(0.9).alias("probability")) for k, w in enumerate(("Thanks", " for", " watching"))])
    later = pause.withColumn("words", thanks)
    again = later.withColumn("cycle", F.lit(1).cast("bigint"))
    return pause.unionByName(again).unionByName(later.withColumn("cycle", F.lit(2).cast("bigint")).withColumn("kind", F.lit("stop")))


def stopped(s: DataFrame) -> DataFrame:
    """An unsure partial cycle of each turn, then a stop with the same words: heard for odd sessions, too short a buffer for even ones."""
    seen = decoded(s, "partial", 6000, 0.5)
    short = F.when(F.col("session_id") % 2 == 0, F.lit(200)).otherwise(F.lit(6000)).cast("bigint")
    stop = seen.withColumn("cycle", F.lit(1).cast("bigint")).withColumn("kind", F.lit("stop")).withColumn("buffer_dur_ms", short)
    return seen.unionByName(stop)


def dropped(s: DataFrame) -> DataFrame:
    """A made-up partial cycle with a full buffer, which would be committed by force, then one with the words of the turn."""
    real = decoded(s, "partial", 12_000, 0.5)
    thanks = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).cast("bigint").alias("start_ms"), F.lit(k + 1).cast("bigint").alias("end_ms"), F.lit(0.9).alias("probability")) for k, w in enumerate(("Thanks ", "for", " watching"))])
    return real.withColumn("words", thanks).unionByName(real.withColumn("cycle", F.lit(1).cast("bigint")))


def finals(s: DataFrame) -> DataFrame:
    """The text of each turn one second after its start, by a clock that starts at one minute (a stream's first watermark is zero)."""
    return s.select(
        F.col("media_id").alias("session_id"), F.col("seg_no").alias("index"), F.lit("xx").alias("lang"), "text", F.timestamp_millis(F.col("start_ms") + 61_000).alias("event_ts")
    )


def drafts(s: DataFrame) -> DataFrame:
    """Translated drafts of the turns as they start: every third of another text, every fourth not translated."""
    return finals(s).select(
        "session_id", "index", "lang", F.when(F.col("index") % 3 == 1, F.concat("text", F.lit(" and"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("index") % 4 != 2, F.concat(F.lit("["), "text", F.lit("]"))).alias("cached"), (F.col("event_ts") - F.expr("INTERVAL 1 SECOND")).alias("event_ts"),
    )


#: Words of the sessions, their first unsure word, and the walk that closes lines.
SPOKEN = ", spoken AS (SELECT media_id * 1000 + seg_no AS session_id, word_no, word, start_ms, start_ms + 10 AS end_ms, right(word, 1) IN ('.', '!', '?', '。', '？', '！') AS hard FROM words)"
SURE = SPOKEN + """, ends AS (SELECT session_id, max(end_ms) + 100 AS buffer_end FROM spoken GROUP BY 1),
sure AS (SELECT session_id, min(word_no) AS cut FROM spoken JOIN ends USING (session_id) WHERE word_no % 11 = 10 OR buffer_end - end_ms < 150 GROUP BY 1)"""
WALK = """, walk AS (
SELECT w.session_id, w.word_no, word, start_ms, end_ms, CAST(0 AS BIGINT) AS line_no, 1 AS n, CAST(hard AS INT) AS e, false AS closes FROM (SELECT * FROM spoken {only}) w WHERE w.word_no = 0
UNION ALL
SELECT session_id, word_no, word, start_ms, end_ms, line_no, n, e, CASE WHEN hard THEN e >= 2 ELSE n >= 28 END FROM (
  SELECT w.session_id, w.word_no, w.word, w.start_ms, w.end_ms, w.hard, k.line_no + CAST(k.closes AS BIGINT) AS line_no,
         CASE WHEN k.closes THEN 1 ELSE k.n + 1 END AS n, CASE WHEN k.closes THEN 0 ELSE k.e END + CAST(w.hard AS INT) AS e
  FROM walk k JOIN (SELECT * FROM spoken {only}) w ON w.session_id = k.session_id AND w.word_no = k.word_no + 1))"""


#: The words of a line as live_step joins them: a mark that clings stands without a space before it.
COMPOSED = "ltrim(string_agg(CASE WHEN contains('{}', left(word, 1)) THEN word ELSE concat(' ', word) END, '' ORDER BY word_no)) AS text".format("".join(CLINGS).replace("'", "''"))


def judged(rows: str) -> str:
    """SQL for rows (with a list of words, ws) and whether live_step takes them for made up; their mean probability, 0.5 or more, is no ground here."""
    said = " OR ".join("contains(joined, '{}')".format(p.replace("'", "''")) for p in MADE_UP_PHRASES)
    return f"""SELECT *, {said} OR (len(tokens) >= {LEAST_TOKENS} AND list_max(map_values(list_histogram(tokens))) / len(tokens) > CAST({MAX_TOKEN_SHARE} AS DOUBLE))
  OR (len(tokens) >= {LEAST_PAIR_TOKENS} AND list_max(map_values(list_histogram(list_transform(range(1, len(tokens)), lambda i: concat(tokens[i], ' ', tokens[i + 1]))))) / (len(tokens) - 1) > CAST({MAX_PAIR_SHARE} AS DOUBLE)) AS made_up
  FROM (SELECT *, lower(array_to_string(ws, ' ')) AS joined, list_transform(ws, lambda w: trim(lower(w), '{TOKEN_EDGES}')) AS tokens FROM ({rows}))"""


#: Sessions whose words all together are taken for made up.
UNREAL = f""", unreal AS (SELECT session_id, ws FROM ({judged("SELECT session_id, list(word ORDER BY word_no) AS ws FROM spoken GROUP BY 1")}) WHERE made_up)"""
REAL = "WHERE session_id NOT IN (SELECT session_id FROM unreal)"
#: Of those, the words that the partial cycles that were not made up committed before the stop, which then hears none.
HEARD = UNREAL + f""", shown AS (
  SELECT session_id, cycle, now, list_transform(ws[1:now], lambda w, i: CASE WHEN i > now - 3 AND (i - 1 + cycle) % 11 = 0 THEN concat(w, '~') ELSE w END) AS ws
  FROM (SELECT *, least(len(ws), 3 * cycle + 6) AS now FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((len(ws) - 6) / 3), 0) AS BIGINT) + 1)) AS cycle FROM unreal))),
real AS (SELECT session_id, cycle, now, lag(cycle) OVER w AS cycle_before, lag(now) OVER w AS before, row_number() OVER w AS place
  FROM ({judged("SELECT * FROM shown")}) WHERE NOT made_up WINDOW w AS (PARTITION BY session_id ORDER BY cycle)),
commits AS (SELECT session_id, place, CAST(0 AS BIGINT) AS k FROM real WHERE place = 1
  UNION ALL
  SELECT c.session_id, r.place, list_min(list_filter(range(0, before + 1), lambda p: p >= k AND (p >= before OR (p >= now - 3 AND (p + cycle) % 11 = 0) <> (p >= before - 3 AND (p + cycle_before) % 11 = 0))))
  FROM commits c JOIN real r ON r.session_id = c.session_id AND r.place = c.place + 1),
heard AS (SELECT session_id, coalesce(max(k), 0) AS k FROM unreal LEFT JOIN commits USING (session_id) GROUP BY 1)"""
COMMITTED = "LEFT JOIN heard USING (session_id) WHERE k IS NULL OR word_no < k"

query("t1_utterances", """, f AS (SELECT DISTINCT media_id, unnest(range(CAST(ceil(start_ms / 30) AS BIGINT), CAST(ceil(end_ms / 30) AS BIGINT))) AS n FROM segments),
runs AS (SELECT media_id, min(n) AS b, max(n) + 1 AS e FROM (SELECT media_id, n, n - row_number() OVER (PARTITION BY media_id ORDER BY n) AS island FROM f) GROUP BY media_id, island),
gaps AS (SELECT media_id, e AS b, coalesce(lead(b) OVER (PARTITION BY media_id ORDER BY b), CAST(floor(duration_ms / 30) AS BIGINT) + 1) AS e FROM runs JOIN media USING (media_id)),
m AS (SELECT media_id, list({'b': runs.b, 'e': runs.e} ORDER BY runs.b) AS speech, any_value(quiet) AS quiet, any_value(n) AS n FROM runs JOIN (
  SELECT media_id, list({'b': b, 'e': e} ORDER BY b) AS quiet, max(e) AS n FROM gaps GROUP BY 1) USING (media_id) GROUP BY 1),
-- an utterance starts where six frames in a row are speech, and ends at the twelfth quiet frame or its 400th
u AS (SELECT media_id, CAST(0 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS last, false AS forced FROM m
  UNION ALL
  SELECT media_id, least(quiet_end, s + 399) + 1, s, least(quiet_end, s + 399), quiet_end > s + 399 FROM (
    SELECT media_id, s, n, coalesce(list_min(list_transform(list_filter(quiet, lambda q: q.b > s AND q.e - q.b >= 12), lambda q: q.b + 11)), n + 1000) AS quiet_end FROM (
      SELECT u.media_id, quiet, n, list_min(list_transform(list_filter(speech, lambda r: r.e - greatest(r.b, p) >= 6), lambda r: greatest(r.b, p))) AS s FROM u JOIN m USING (media_id)))
  WHERE s IS NOT NULL AND least(quiet_end, s + 399) < n)
SELECT media_id AS session_id, s * 30 AS start_ms, (last + 1) * 30 AS end_ms, forced FROM u WHERE s IS NOT NULL""")(lambda s: L.utterances(frames(s)))
query("t1_speech_sessions", """, f AS (SELECT DISTINCT media_id, unnest(range(CAST(ceil(start_ms / 30) AS BIGINT), CAST(ceil(end_ms / 30) AS BIGINT))) AS n FROM segments),
o AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY media_id ORDER BY n) <= 12 THEN 0 ELSE 1 END AS opens FROM f),
i AS (SELECT *, sum(opens) OVER (PARTITION BY media_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT media_id AS session_id, min(n) * 30 AS start_ms, max(n) * 30 + 360 AS end_ms, count(*) AS n_frames FROM i GROUP BY media_id, island""")(
    lambda s: L.speech_sessions(frames(s)).select("session_id", F.unix_millis("start_ts").alias("start_ms"), F.unix_millis("end_ts").alias("end_ms"), "n_frames")
)
query("t3_final_texts", SPOKEN + HEARD + WALK.format(only=COMMITTED) + f"""
SELECT session_id, string_agg(text, ' ' ORDER BY line_no) AS text FROM (SELECT session_id, line_no, {COMPOSED} FROM walk GROUP BY session_id, line_no) GROUP BY session_id""")(
    lambda s: L.live_transcript(hypotheses(s)).filter("event = 'final'").groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text")
    )
)
query("t4_sure_words", SURE + UNREAL + WALK.format(only=f"JOIN sure USING (session_id) {REAL} AND word_no < cut") + f"""
SELECT session_id, CASE WHEN bool_or(closes) THEN 'final' ELSE 'draft' END AS event, line_no, {COMPOSED} FROM walk GROUP BY session_id, line_no""")(
    lambda s: L.live_transcript(decoded(s, "partial", 6000)).filter("event <> 'partial'").select("session_id", "event", "line_no", "text")
)
query("t5_forced_words", SPOKEN + UNREAL + WALK.format(only=REAL) + f"""
SELECT session_id, CASE WHEN bool_or(closes) THEN 'final' ELSE 'draft' END AS event, line_no, {COMPOSED} FROM walk GROUP BY session_id, line_no""")(
    lambda s: L.live_transcript(decoded(s, "partial", 12_000, 0.5)).select("session_id", "event", "line_no", "text")
)
query("t6_lines", SPOKEN + HEARD + WALK.format(only=COMMITTED) + f"""
SELECT session_id, line_no, {COMPOSED}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM walk GROUP BY session_id, line_no""")(
    lambda s: L.live_transcript(hypotheses(s)).filter("event = 'final'").select("session_id", "line_no", "text", "start_ms", "end_ms")
)
query("t7_pause", SPOKEN + UNREAL + WALK.format(only=REAL) + f"""
SELECT session_id, CAST(CASE WHEN bool_or(closes) OR count(*) >= 8 THEN 0 ELSE 2 END AS BIGINT) AS cycle, line_no, {COMPOSED} FROM walk GROUP BY session_id, line_no""")(
    lambda s: L.live_transcript(paused(s)).filter("event = 'final'").select("session_id", "cycle", "line_no", "text")
)
query("t8_stop", SPOKEN + UNREAL + WALK.format(only=REAL + " AND session_id % 2 = 1") + f"""
SELECT session_id, CAST(1 AS BIGINT) AS cycle, line_no, {COMPOSED} FROM walk GROUP BY session_id, line_no""")(
    lambda s: L.live_transcript(stopped(s)).filter("event = 'final'").select("session_id", "cycle", "line_no", "text")
)
query("t10_pause_events", SPOKEN + UNREAL + WALK.format(only=REAL) + f""",
lines AS (SELECT session_id, line_no, bool_or(closes) OR count(*) >= 8 AS closed, {COMPOSED} FROM walk GROUP BY session_id, line_no),
sessions AS (SELECT session_id, count(*) AS n, bool_and(closed) AS all_closed FROM lines GROUP BY session_id)
SELECT session_id, CAST(cycle AS BIGINT) AS cycle, 'draft' AS event, line_no, text FROM lines, (VALUES (0), (1)) AS v(cycle) WHERE NOT closed
UNION ALL SELECT session_id, cycle, 'partial', n, '' FROM sessions, (VALUES (0), (1), (2)) AS v(cycle) WHERE all_closed OR cycle = 2
UNION ALL SELECT session_id, cycle, 'partial', 0, '' FROM unreal, (VALUES (0), (1), (2)) AS v(cycle)""")(
    lambda s: L.live_transcript(paused(s)).filter("event <> 'final'").select("session_id", "cycle", "event", "line_no", "text")
)
query("t11_dropped_cycle", SPOKEN + UNREAL + WALK.format(only=REAL) + f"""
SELECT session_id, CAST(1 AS BIGINT) AS cycle, CASE WHEN bool_or(closes) THEN 'final' ELSE 'draft' END AS event, line_no, {COMPOSED} FROM walk GROUP BY session_id, line_no""")(
    lambda s: L.live_transcript(dropped(s)).select("session_id", "cycle", "event", "line_no", "text")
)


def in_four_batches(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as four micro-batches, one of them given twice, as after a failure: late rows, and the rows that were passed on and written."""
    rows = s.select("media_id", "ord", "start_ms", F.timestamp_millis("start_ms").alias("event_ts"))
    folder = scratch.folder(s.sparkSession)
    split = C.apart_from_late(L.by_batch(f"{folder}/passed"), f"{folder}/late")
    for batch_id in (0, 1, 1, 2, 3):
        split(rows.filter(F.col("ord") % 4 == batch_id), batch_id)
    late = C.late_rows_kept(s.sparkSession, f"{folder}/late", "media_id bigint, ord bigint, start_ms bigint, event_ts timestamp")
    return late, s.sparkSession.read.schema("media_id bigint, ord bigint, start_ms bigint, batch_id bigint").parquet(f"{folder}/passed")


MARKS = """, b AS (SELECT *, ord % 4 AS batch_id FROM segments),
m AS (SELECT batch_id, max(max(start_ms)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10000 AS mark FROM b GROUP BY batch_id)
"""
query("t21_late_rows", MARKS + "SELECT media_id, ord, batch_id, mark AS watermark_ms FROM b JOIN m USING (batch_id) WHERE start_ms < mark")(
    lambda s: in_four_batches(s)[0].select("media_id", "ord", "batch_id", "watermark_ms")
)
query("x3_batches", MARKS + "SELECT media_id, ord, batch_id FROM b JOIN m USING (batch_id) WHERE mark IS NULL OR start_ms >= mark")(
    lambda s: in_four_batches(s)[1].select("media_id", "ord", "batch_id")
)
query("t9_live_events", None)(lambda s: L.live_transcript(hypotheses(s)))
query("t20_session_summary", SPOKEN + HEARD + WALK.format(only=COMMITTED) + """
SELECT session_id, count(DISTINCT line_no) AS n_lines, max(end_ms) AS duration_ms FROM walk GROUP BY session_id""")(lambda s: L.session_summary(L.live_transcript(hypotheses(s)).filter("event = 'final'")))
query("j19_agreement", SPOKEN + """, sizes AS (SELECT session_id, count(*) AS n, CAST(greatest(ceil((count(*) - 6) / 3), 0) AS BIGINT) + 1 AS last FROM spoken GROUP BY 1),
cycles AS (SELECT *, unnest(range(0, last + 1)) AS cycle FROM sizes),
seen AS (SELECT *, CASE WHEN cycle = last THEN n ELSE least(n, 3 * cycle + 6) END AS now, least(n, 3 * cycle + 3) AS before FROM cycles),
p AS (SELECT session_id, cycle, now, before, unnest(range(0, now)) AS pos, cycle = last AS stop FROM seen),
bad AS (SELECT session_id, cycle, now, pos, pos >= before OR (NOT stop AND pos >= now - 3 AND (pos + cycle) % 11 = 0) <> (pos >= before - 3 AND (pos + cycle - 1) % 11 = 0) AS differs FROM p)
SELECT session_id, cycle, CAST(CASE WHEN cycle = 0 THEN 0 ELSE coalesce(min(pos) FILTER (WHERE differs), now) END AS BIGINT) AS agreed FROM bad GROUP BY session_id, cycle, now""")(lambda s: agreement(hypotheses(s)))
query("t2_cadence", """, n AS (SELECT media_id * 1000 + seg_no AS session_id, len(ws) AS c FROM word_lists WHERE len(ws) > 0),
k AS (SELECT session_id, unnest(range(0, CAST(greatest(ceil((c - 6) / 3), 0) AS BIGINT) + 2)) AS cycle FROM n)
SELECT session_id, CAST((cycle * 500) // 800 * 800 AS BIGINT) AS window_ms, max(cycle) AS cycle FROM k GROUP BY 1, 2""")(
    lambda s: L.cadence(hypotheses(s)).select("session_id", F.unix_millis("w.start").alias("window_ms"), "cycle")
)
query("t14_latest_actions", "SELECT media_id AS session_id, arg_max(role, ord) AS action FROM segments GROUP BY 1")(
    lambda s: L.latest_actions(s.select(F.col("media_id").alias("session_id"), F.col("role").alias("action"), F.col("ord").alias("seq")))
)
query("t15_append_only", """, n AS (SELECT media_id, ord, ws, len(ws) AS c, coalesce(max(len(ws)) OVER (PARTITION BY media_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM word_lists)
SELECT media_id AS session_id, ord AS cycle, list_slice(ws, known + 1, c) AS new_words FROM n WHERE c > known""")(
    lambda s: L.append_only(s.select(F.col("media_id").alias("session_id"), F.col("ord").alias("cycle"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("words")))
)
query("t16_graduated", "SELECT * FROM (SELECT media_id AS session_id, ord AS line_no, lead(start_ms) OVER (PARTITION BY media_id ORDER BY ord) AS left_at FROM segments) WHERE left_at IS NOT NULL")(
    lambda s: L.graduated(s.select(F.col("media_id").alias("session_id"), F.col("ord").alias("line_no"), "start_ms")).select("session_id", "line_no", "left_at")
)
query("t17_drafts", "SELECT media_id AS session_id, seg_no // 2 AS index, 'xx' AS lang, arg_max(text, seg_no) AS text FROM word_lists WHERE len(ws) >= 4 GROUP BY 1, 2")(
    lambda s: L.drafts_to_translate(s.select(F.col("media_id").alias("session_id"), F.floor(F.col("seg_no") / 2).cast("bigint").alias("index"), F.lit("xx").alias("lang"), "text", F.col("seg_no").alias("cycle")))
)
query("t18_drafts_of_finals", """, f AS (SELECT media_id AS session_id, seg_no AS index, 'xx' AS lang, text, start_ms FROM segments)
SELECT session_id, index, lang, text, CASE WHEN index % 3 <> 1 AND index % 4 <> 2 THEN concat('[', text, ']') END AS reused FROM f""")(
    lambda s: L.finals_with_drafts(finals(s), drafts(s)).drop("event_ts")
)
query("t12_rolling_context", "SELECT media_id AS session_id, seg_no AS line_no, coalesce(right(string_agg(text, ' ') OVER (PARTITION BY media_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 400), '') AS context FROM segments")(
    lambda s: L.rolling_context(s.select(F.col("media_id").alias("session_id"), F.col("seg_no").alias("line_no"), "text")).select("session_id", "line_no", "context")
)
query("t13_resumed", "SELECT media_id AS session_id, ord, start_ms + media_id * 1000 AS start_ms, end_ms + media_id * 1000 AS end_ms FROM segments")(
    lambda s: L.resumed(
        s.select(F.col("media_id").alias("session_id"), "ord", "start_ms", "end_ms"), s.select(F.col("media_id").alias("session_id"), (F.col("media_id") * 1000).alias("offset_ms")).distinct()
    )
)
