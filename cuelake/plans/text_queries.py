"""Queries over texts, levels, logs, names and rendered outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions import timecode as C
from cuelake.operators import aggregates as A
from cuelake.operators import filters as P
from cuelake.operators import joins as J
from cuelake.operators import sets as U
from cuelake.operators import textual as X
from cuelake.operators import windows as W
from cuelake.operators.models import apply_model, translate
from cuelake.plans import inputs as I
from cuelake.plans.inputs import CTE
from cuelake.plans.interval_queries import KEPT, cuts_of
from cuelake.sources import export as E
from cuelake.sources import readers as R
from cuelake.sources import scratch

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None):
    """A query over the derived segments."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(I.segments(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = CTE + sql
        return f

    return put


def over(table: str, name: str, sql: str | None):
    """A query over a given table."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(I.table(spark, sf_dir, table))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- times and numbers
over("conversations", "f1_clocks", """SELECT conv_id, turn, printf('%d:%02d.%02d', cs // 6000, (cs // 100) % 60, cs % 100) AS clock,
  printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS srt, printf('%d:%02d', ms // 60000, (ms // 1000) % 60) AS short,
  printf('%02d:%02d', ms // 60000, (ms // 1000) % 60) AS padded,
  CASE WHEN sec < 60 THEN printf('%ds', sec) ELSE printf('%dm %02ds', sec // 60, sec % 60) END AS spoken
FROM (SELECT *, (ms + 5) // 10 AS cs, (ms + 500) // 1000 AS sec FROM (SELECT conv_id, turn, conv_id * 7919 + turn * 100003 AS ms FROM conversations))""")(
    lambda t: t.withColumn("ms", F.col("conv_id") * 7919 + F.col("turn") * 100003).select(
        "conv_id", "turn", C.clock(F.col("ms")).alias("clock"), C.srt_time(F.col("ms")).alias("srt"), C.minutes_seconds(F.col("ms")).alias("short"),
        C.minutes_seconds(F.col("ms"), True).alias("padded"), C.spoken_duration(F.col("ms")).alias("spoken"),
    )
)
over("events", "f5_seconds_to_ms", "SELECT event_id, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS ms FROM events")(
    lambda t: t.select("event_id", C.seconds_to_ms(F.col("value")).alias("ms"))
)
query("f33_frames_ticks", "SELECT media_id, ord, CAST(floor(start_ms * 25 / 1000 + 0.5) AS BIGINT) AS frame, start_ms * 254016000 AS ticks, CAST(floor(floor(start_ms * 25 / 1000 + 0.5) * 1000 / 25 + 0.5) AS BIGINT) AS snapped FROM segments")(
    lambda s: s.select("media_id", "ord", C.frames(F.col("start_ms"), 25).alias("frame"), C.ticks(F.col("start_ms")).alias("ticks"), C.snap(F.col("start_ms"), 25).alias("snapped"))
)
query("f36_frame_rate", """SELECT media_id, CAST(CASE media_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 25 WHEN 2 THEN 30 ELSE 50 END AS DOUBLE) AS fps FROM media""")(
    lambda s: s.withColumn("fps", F.element_at(F.array(F.lit(24), F.lit(25), F.lit(30), F.lit(50)), (F.col("media_id") % 4 + 1).cast("int")))
    .groupBy("media_id").agg(F.collect_list((F.lit(254016000000).cast("double") / F.col("fps") * (F.col("ord") * 700 + 501)).cast("bigint")).alias("t"))
    .select("media_id", C.infer_frame_rate(F.col("t")).alias("fps"))
)
over("embeddings", "f32_pcm", """SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(CASE WHEN x < 0 THEN CAST(x AS DOUBLE) * 32768 ELSE CAST(x AS DOUBLE) * 32767 END) AS SMALLINT)) AS pcm FROM embeddings""")(
    lambda t: t.select("vec_id", C.pcm_encode(F.col("embedding")).alias("pcm"))
)
over("embeddings", "f32_pcm_back", """SELECT vec_id, CAST(round(list_max(list_transform(embedding, lambda x: abs(trunc(CASE WHEN x < 0 THEN CAST(x AS DOUBLE) * 32768 ELSE CAST(x AS DOUBLE) * 32767 END) / 32768 - x))) * 32768) AS BIGINT) AS worst FROM embeddings""")(
    lambda t: t.withColumn("b", C.pcm_decode(C.pcm_encode(F.col("embedding")))).select(
        "vec_id", F.round(F.array_max(F.zip_with("b", "embedding", lambda a, x: F.abs(a - x.cast("double")))) * 32768).cast("bigint").alias("worst")
    )
)
over("embeddings", "f35_decimate", "SELECT vec_id, list_transform(range(0, CAST(floor(len(embedding) * 16000 / 44100) AS BIGINT)), lambda i: embedding[CAST(floor(i * 44100 / 16000) AS BIGINT) + 1]) AS kept FROM embeddings")(
    lambda t: t.select("vec_id", C.decimate(F.col("embedding"), 44_100).alias("kept"))
)


# --- levels
@over("embeddings", "a5_peaks", """WITH x AS (SELECT CAST(label AS BIGINT) AS media_id, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings),
s AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY vec_id, p) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS total, abs(CAST(trunc(CASE WHEN e < 0 THEN CAST(e AS DOUBLE) * 32768 ELSE CAST(e AS DOUBLE) * 32767 END) AS INT)) AS a FROM x),
b AS (SELECT media_id, CAST(i // greatest(1, total // 800) AS BIGINT) AS bucket, max(a) AS peak FROM s GROUP BY 1, 2),
n AS (SELECT *, greatest(1, max(peak) OVER (PARTITION BY media_id)) AS most FROM b)
SELECT media_id, bucket, CAST(round(CAST(peak AS DOUBLE) / CAST(most AS DOUBLE), 4) * 10000 AS BIGINT) AS peak FROM n WHERE bucket < 800""")
def peaks(t: DataFrame) -> DataFrame:
    pcm = t.select(F.col("label").cast("bigint").alias("media_id"), F.col("vec_id").alias("chunk_no"), C.pcm_encode(F.col("embedding")).alias("samples"))
    return A.peaks(pcm).withColumn("peak", F.round(F.col("peak") * 10000).cast("bigint"))


#: Frames in the order of their ids, those of one id by level; levels are compared in double precision.
LEVELS = """WITH l AS (SELECT CAST(label AS BIGINT) AS media_id, vec_id, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS m FROM embeddings),
f AS (SELECT media_id, m, row_number() OVER (PARTITION BY media_id ORDER BY vec_id NULLS FIRST, m NULLS FIRST) - 1 AS frame_no FROM l),
q AS (SELECT *, frame_no - row_number() OVER (PARTITION BY media_id, m < 0.35 ORDER BY frame_no) AS island FROM f),
r AS (SELECT media_id, island, min(frame_no) * 30 AS start_ms, (max(frame_no) + 1) * 30 AS end_ms FROM q WHERE m < 0.35 GROUP BY 1, 2)
SELECT media_id, start_ms, end_ms, CASE WHEN end_ms - start_ms < 400 THEN 'breath' ELSE 'silence' END AS type FROM r WHERE end_ms - start_ms >= 120"""


@over("embeddings", "w18_silence_runs", LEVELS)
def silence_runs(t: DataFrame) -> DataFrame:
    level = F.array_max(F.transform("embedding", F.abs)).cast("double")
    frames = t.select(F.col("label").cast("bigint").alias("media_id"), "vec_id", level.alias("level_db"))
    numbered = frames.withColumn("frame_no", F.row_number().over(W.in_order("vec_id", "level_db")).cast("bigint") - 1)
    return W.silence_runs(numbered, threshold_db=0.35, min_ms=120)


over("events", "w21_window_tags", """SELECT event_id, to_timestamp(k * 600) AT TIME ZONE 'UTC' AS chunk_start FROM (SELECT event_id, epoch(ts) AS e, unnest([CAST(floor(epoch(ts)/600) AS BIGINT), CAST(floor(epoch(ts)/600) AS BIGINT) - 1]) AS k FROM events) WHERE k * 600 <= e AND e < k * 600 + 605""")(
    lambda t: W.window_tags(t).select("event_id", F.col("chunk.start").cast("timestamp_ntz").alias("chunk_start"))
)

# --- text
query("p6_drop_blank", "SELECT media_id, ord, CAST(len(list_filter(ws, lambda w: trim(w) <> '')) AS INT) AS n_words FROM word_lists WHERE trim(text) <> ''")(
    lambda s: P.drop_blank(s.withColumn("words", F.transform(F.split("text", r"\s+"), lambda w: F.struct(w.alias("word"))))).select("media_id", "ord", F.size("words").alias("n_words"))
)
#: Fixed values, beside those of the functions under test: made-up phrases, and languages with names and codes.
PHRASES_SQL = """['ghiền mì gõ', 'đăng ký kênh', 'subscribe cho kênh', 'nhấn chuông thông báo', 'cảm ơn các bạn đã xem', 'hẹn gặp lại các bạn', 'đừng quên like', 'đừng quên đăng ký', 'thanks for watching', 'thank you for watching', 'subscribe to my channel', 'see you next time', 'see you in the next video', 'don''t forget to subscribe', 'like and subscribe', '[music]', '[applause]', '[laughter]', '♪', '♫', 'ご視聴ありがとうございました', '字幕', '다음 영상에서']"""
LANGUAGES_SQL = """(VALUES ('vi', 'Vietnamese', 'vie_Latn'), ('en', 'English', 'eng_Latn'), ('zh', 'Chinese', 'zho_Hans'), ('ja', 'Japanese', 'jpn_Jpan'), ('ko', 'Korean', 'kor_Hang'), ('fr', 'French', 'fra_Latn'), ('de', 'German', 'deu_Latn'), ('es', 'Spanish', 'spa_Latn'), ('pt', 'Portuguese', 'por_Latn'), ('ru', 'Russian', 'rus_Cyrl'), ('th', 'Thai', 'tha_Thai'), ('id', 'Indonesian', 'ind_Latn'), ('ar', 'Arabic', 'arb_Arab'), ('hi', 'Hindi', 'hin_Deva'), ('bn', 'Bengali', 'ben_Beng'), ('ms', 'Malay', 'zsm_Latn'), ('tl', 'Filipino', 'tgl_Latn'), ('my', 'Burmese', 'mya_Mymr'), ('km', 'Khmer', 'khm_Khmr'), ('lo', 'Lao', 'lao_Laoo'), ('it', 'Italian', 'ita_Latn'), ('nl', 'Dutch', 'nld_Latn'), ('pl', 'Polish', 'pol_Latn'), ('uk', 'Ukrainian', 'ukr_Cyrl'), ('cs', 'Czech', 'ces_Latn'), ('sv', 'Swedish', 'swe_Latn'), ('da', 'Danish', 'dan_Latn'), ('fi', 'Finnish', 'fin_Latn'), ('no', 'Norwegian', 'nob_Latn'), ('el', 'Greek', 'ell_Grek'), ('tr', 'Turkish', 'tur_Latn'), ('he', 'Hebrew', 'heb_Hebr'), ('fa', 'Persian', 'pes_Arab'), ('hu', 'Hungarian', 'hun_Latn'), ('ro', 'Romanian', 'ron_Latn'), ('bg', 'Bulgarian', 'bul_Cyrl'), ('hr', 'Croatian', 'hrv_Latn'), ('sk', 'Slovak', 'slk_Latn'), ('sl', 'Slovenian', 'slv_Latn'), ('lt', 'Lithuanian', 'lit_Latn'), ('lv', 'Latvian', 'lvs_Latn'), ('et', 'Estonian', 'est_Latn'), ('ca', 'Catalan', 'cat_Latn'), ('gl', 'Galician', 'glg_Latn'), ('eu', 'Basque', 'eus_Latn'), ('af', 'Afrikaans', 'afr_Latn'), ('sw', 'Swahili', 'swh_Latn'), ('ta', 'Tamil', 'tam_Taml'), ('te', 'Telugu', 'tel_Telu'), ('ur', 'Urdu', 'urd_Arab'), ('ne', 'Nepali', 'npi_Deva'), ('si', 'Sinhala', 'sin_Sinh'), ('ka', 'Georgian', 'kat_Geor'), ('az', 'Azerbaijani', 'azj_Latn'), ('uz', 'Uzbek', 'uzn_Latn'), ('kk', 'Kazakh', 'kaz_Cyrl'), ('mn', 'Mongolian', 'khk_Cyrl')) AS languages(lang, name, code)"""


over("documents", "f7_made_up", f"WITH p AS (SELECT {PHRASES_SQL} AS ps) SELECT doc_id, len(list_filter(ps, lambda x: contains(lower(concat(text, ' So ', ps[CAST(doc_id % 46 + 1 AS INT)])), x))) > 0 AS hit FROM documents, p")(
    lambda t: t.select("doc_id", T.contains_made_up(F.concat("text", F.lit(" So "), F.coalesce(F.get(F.array(*[F.lit(p) for p in T.MADE_UP_PHRASES]), (F.col("doc_id") % 46).cast("int")), F.lit("")))).alias("hit"))
)
HALL = f""", w AS (SELECT media_id, seg_no, word_no, CASE WHEN word_no % 13 = 12 THEN '' ELSE concat(CASE WHEN word_no % 3 = 1 THEN ' ' ELSE '' END, CASE WHEN seg_no % 17 = 5 AND word_no < 3 THEN ['Thanks', 'for', 'watching'][word_no + 1] ELSE word END, CASE WHEN word_no % 5 = 1 THEN ' ' ELSE '' END) END AS word, prob * ((media_id % 5) + 1) / 4 AS p FROM words),
t AS (SELECT *, trim(lower(word), '.,!?;:、，。') AS token FROM w WHERE word <> ''),
x AS (SELECT *, token || ' ' || lead(token) OVER (PARTITION BY media_id, seg_no ORDER BY word_no) AS pair FROM t),
m AS (SELECT media_id, seg_no, avg(p) AS mean, count(*) FILTER (word <> '') AS n, lower(string_agg(trim(word), ' ' ORDER BY word_no) FILTER (word <> '')) AS joined FROM w GROUP BY 1, 2),
a AS (SELECT media_id, seg_no, max(c) AS top FROM (SELECT media_id, seg_no, token, count(*) AS c FROM x GROUP BY ALL) GROUP BY 1, 2),
b AS (SELECT media_id, seg_no, max(c) AS top2 FROM (SELECT media_id, seg_no, pair, count(*) AS c FROM x WHERE pair IS NOT NULL GROUP BY ALL) GROUP BY 1, 2)
SELECT m.media_id, m.seg_no, (round(mean, 9) < 0.35 OR len(list_filter({PHRASES_SQL}, lambda x: contains(joined, x))) > 0 OR (n >= 5 AND top / n > 0.55) OR (n >= 6 AND top2 / (n - 1) > 0.45)) AS bad
FROM m JOIN a USING (media_id, seg_no) LEFT JOIN b USING (media_id, seg_no)"""


@query("f9_hallucination", HALL)
def hallucination(s: DataFrame) -> DataFrame:
    thanks = F.get(F.array(F.lit("Thanks"), F.lit("for"), F.lit("watching")), F.col("word_no").cast("int"))
    said = F.when((F.col("seg_no") % 17 == 5) & (F.col("word_no") < 3), thanks).otherwise(F.col("word"))
    spaced = F.concat(F.when(F.col("word_no") % 3 == 1, " ").otherwise(""), said, F.when(F.col("word_no") % 5 == 1, " ").otherwise(""))
    w = I.words(s).withColumn("probability", F.col("prob") * ((F.col("media_id") % 5) + 1) / 4)
    w = w.withColumn("word", F.when(F.col("word_no") % 13 == 12, "").otherwise(spaced))
    held = w.groupBy("media_id", "seg_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "word", "probability"))).alias("words"))
    return held.select("media_id", "seg_no", T.is_hallucination(F.col("words")).alias("bad"))


query("f11_split_words", "SELECT media_id, ord AS parent_no, pos AS piece_no, w AS text, start_ms + pos * (end_ms - start_ms) // n AS start_ms, start_ms + (pos + 1) * (end_ms - start_ms) // n AS end_ms FROM (SELECT *, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM word_lists)")(
    lambda s: X.split_segments(s, "word").select("media_id", "parent_no", "piece_no", "text", "start_ms", "end_ms")
)
SHARES = """, u AS (SELECT media_id, ord, text AS whole, start_ms, end_ms, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM p),
v AS (SELECT *, sum(length(part)) OVER (PARTITION BY media_id, ord) AS total, sum(length(part)) OVER (PARTITION BY media_id, ord ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM u)
SELECT media_id, ord AS parent_no, pos AS piece_no, CASE WHEN n = 1 THEN whole ELSE trim(part) END AS text,
  CAST(start_ms + (end_ms - start_ms) * (upto - length(part)) // greatest(total, 1) AS BIGINT) AS start_ms, CAST(start_ms + (end_ms - start_ms) * upto // greatest(total, 1) AS BIGINT) AS end_ms FROM v"""
query("f12_split_punctuation", ", p AS (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?;,。！？，；])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS parts FROM segments)".replace("\\\\", "\\") + SHARES)(
    lambda s: X.split_segments(s, "punctuation").select("media_id", "parent_no", "piece_no", "text", "start_ms", "end_ms")
)
query("f13_split_max_words", ", p AS (SELECT *, list_transform(range(0, greatest(len(ws), 1), 6), lambda i: array_to_string(list_slice(ws, i + 1, i + 6), ' ')) AS parts FROM word_lists)" + SHARES)(
    lambda s: X.split_segments(s, "maxWords", 6).select("media_id", "parent_no", "piece_no", "text", "start_ms", "end_ms")
)
over("documents", "f15_sentences", r"""SELECT doc_id, pos AS sentence_no, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos FROM (
  SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS l FROM (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?。？！]+[.!?。？！]+|[^.!?。？！]+$'), lambda x: trim(x, ' ')), lambda x: x <> '') AS k FROM documents)))""")(
    lambda t: X.sentence_rows(t).select("doc_id", "sentence_no", "sentence")
)
query("f16_compose", "SELECT media_id, seg_no, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') AS text FROM segments".replace("\\\\", "\\"))(
    lambda s: I.words(s).groupBy("media_id", "seg_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("w")).select(
        "media_id", "seg_no", T.compose(F.transform("w", lambda x: x["word"])).alias("text")
    )
)
over("documents", "f17_compose_wide", r"""WITH w AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[^\s,.!?;:)»”’%]+|[,.!?;:)»”’%]'), ' ') AS t FROM documents)
SELECT doc_id, regexp_replace(t, ' ([,.!?;:…)»”''’%])', '\1', 'g') AS text FROM w WHERE t <> ''""")(
    lambda t: t.filter(F.col("text").rlike(r"\S")).select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\s,.!?;:)»”’%]+|[,.!?;:)»”’%]"), F.lit(0)).alias("w")).select("doc_id", T.compose_wide(F.flatten(F.transform("w", lambda w: F.array(w, F.lit(""))))).alias("text"))
)
over("pages", "f29_labels", "SELECT page_id, CASE WHEN p < 26 THEN concat('Speaker ', chr(CAST(65 + p AS INTEGER))) ELSE concat('Speaker ', p + 1) END AS label FROM (SELECT page_id, page_id % 40 AS p FROM pages)")(
    lambda t: t.select("page_id", T.label_of(F.col("page_id") % 40).alias("label"))
)
query("f28_requests", """, b AS (SELECT media_id, text, CAST(floor((row_number() OVER w - 1) / 3) AS BIGINT) AS batch_no, (row_number() OVER w - 1) % 3 + 1 AS k FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY ord)),
p AS (SELECT media_id, batch_no, string_agg(concat(k, '. ', CASE WHEN trim(text) = '' THEN '[EMPTY]' ELSE text END), chr(10) ORDER BY k) AS lines FROM b GROUP BY 1, 2)
SELECT media_id, batch_no, CAST(NULL AS VARCHAR) AS chat_system, concat('Translate the numbered lines from English to French. Answer with the same numbers, one line each.', chr(10), chr(10), lines) AS chat_user,
  'You translate speech from English to French. Keep its meaning, tone and style, and let it sound like talk.' AS roles_system,
  concat('Translate the numbered lines. Answer with the same numbers, one line each, and nothing else.', chr(10), chr(10), lines) AS roles_user FROM p""")(
    lambda s: X.prompts(W.batches(s, 3)).select("media_id", "batch_no", *[T.request_for(F.lit("English"), F.lit("French"), F.col("prompt"), x)[part].alias(f"{x}_{part}") for x in ("chat", "roles") for part in ("system", "user")])
)
query("f28_single_requests", """SELECT media_id, ord, CAST(NULL AS VARCHAR) AS line_system, concat('Translate to French. Answer with the translation only.', chr(10), 'Text: ', text, chr(10), 'Translation:') AS line_user,
  'You are a translator. Translate the text from English to French and answer with nothing but the translation.' AS single_system, text AS single_user FROM segments""")(
    lambda s: s.select("media_id", "ord", *[T.request_for(F.lit("English"), F.lit("French"), F.col("text"), x)[part].alias(f"{x}_{part}") for x in ("line", "single") for part in ("system", "user")])
)
over("documents", "f20_matches", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)tion')) AS BIGINT) AS n_matches FROM documents WHERE regexp_matches(text, '(?i)tion')")(
    lambda t: X.matches(t, " tion ", "doc_id")
)
over("documents", "f21_replace_all", "SELECT doc_id, md5(regexp_replace(text, '(?i)the', '$&x', 'g')) AS digest FROM documents")(
    lambda t: t.select("doc_id", F.md5(T.replace_all(F.col("text"), "the", "$&x").cast("binary")).alias("digest"))
)
over("documents", "f22_replace_first", "SELECT doc_id, md5(regexp_replace(text, '(?i)the', 'THE!')) AS digest FROM documents")(
    lambda t: t.select("doc_id", F.md5(T.replace_first(F.col("text"), "the", "THE!").cast("binary")).alias("digest"))
)
over("documents", "f23_highlight", r"SELECT doc_id, md5(regexp_replace(text, '(?i)ing\.', '<mark>\0</mark>', 'g')) AS digest FROM documents")(
    lambda t: t.select("doc_id", F.md5(T.highlight(F.col("text"), "ing.").cast("binary")).alias("digest"))
)
query("f24_match_navigation", """, c AS (SELECT media_id, ord, CAST(len(regexp_extract_all(text, '(?i)en')) AS BIGINT) AS n FROM segments),
r AS (SELECT media_id, ord, unnest(range(0, n)) AS match_no FROM c WHERE n > 0),
m AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ord, match_no) AS number, count(*) OVER (PARTITION BY media_id) AS total FROM r)
SELECT *, number - 1 = 41 % total AS selected FROM m""")(lambda s: X.match_navigation(s, "en", 41))
query("f25_draft_key", r"SELECT media_id, seg_no, lower(regexp_replace(trim(text), '[\s.!?。！？,;，；:]+$', '')) AS text_key FROM segments")(
    lambda s: s.select("media_id", "seg_no", T.draft_key(F.col("text")).alias("text_key"))
)
query("f26_prompts", """, b AS (SELECT media_id, text, CAST(floor((row_number() OVER w - 1) / 3) AS BIGINT) AS batch_no, (row_number() OVER w - 1) % 3 + 1 AS k FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY ord))
SELECT media_id, batch_no, count(*) AS n_lines, string_agg(concat(k, '. ', CASE WHEN trim(text) = '' THEN '[EMPTY]' ELSE text END), chr(10) ORDER BY k) AS prompt FROM b GROUP BY 1, 2""")(
    lambda s: X.prompts(W.batches(s, 3))
)


@query("f27_parse_numbered", """, r AS (SELECT media_id, ord, ord % 3 AS kind FROM segments)
SELECT media_id, ord AS batch_no, k AS in_batch, CASE kind WHEN 0 THEN ['a', '', concat('c', media_id)][k] WHEN 1 THEN ['first', 'second', ''][k] ELSE ['late', '', 'end'][k] END AS text FROM r, (VALUES (1::BIGINT), (2), (3)) n(k)""")
def parse_numbered(s: DataFrame) -> DataFrame:
    third = F.concat(F.lit("1. a\n3. c"), F.col("media_id").cast("string"), F.lit("\n9. far"))
    response = F.when(F.col("ord") % 3 == 0, third).when(F.col("ord") % 3 == 1, F.lit("first\n\n second\n")).otherwise(F.lit("1. early\n2. [EMPTY]\n3. end\n1. late"))
    return X.parsed_responses(s.select("media_id", F.col("ord").alias("batch_no"), F.lit(3).alias("n_lines"), response.alias("response")))


over("pages", "f30_stems", r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]+$', '') AS stem FROM pages")(
    lambda t: t.select("page_id", T.stem(F.col("url")).alias("stem"))
)
over("documents", "f31_masked", "SELECT doc_id, CASE WHEN source = '' THEN '' WHEN length(source || doc_id || 'key') < 9 THEN '...' ELSE left(source || doc_id || 'key', 4) || '...' || right(source || doc_id || 'key', 4) END AS masked FROM documents")(
    lambda t: t.select("doc_id", T.masked(F.concat("source", F.col("doc_id").cast("string"), F.lit("key"))).alias("masked"))
)
over("documents", "j13_languages", f"""WITH codes AS (SELECT list(lang ORDER BY lang) AS cs FROM {LANGUAGES_SQL}),
d AS (SELECT doc_id, coalesce(cs[CAST(doc_id % 60 + 1 AS INT)], 'xx') AS t, CASE WHEN doc_id % 2 = 0 THEN 'auto' ELSE lang END AS s FROM documents, codes)
SELECT doc_id, coalesce(a.name, t) AS target_name, coalesce(a.code, 'eng_Latn') AS target_code,
       CASE WHEN s = 'auto' THEN CASE WHEN t = 'vi' THEN 'eng_Latn' ELSE 'vie_Latn' END ELSE coalesce(b.code, 'eng_Latn') END AS source_code, upper(t) AS tag
FROM d LEFT JOIN {LANGUAGES_SQL.replace('AS languages', 'AS a')} ON a.lang = t LEFT JOIN {LANGUAGES_SQL.replace('AS languages', 'AS b')} ON b.lang = s""")(
    lambda t: J.language_names(
        t.select(
            "doc_id", F.when(F.col("doc_id") % 2 == 0, "auto").otherwise(F.col("lang")).alias("source_lang"),
            F.coalesce(F.get(F.array(*[F.lit(x) for x in sorted(x for x, _, _ in T.LANGUAGES)]), (F.col("doc_id") % 60).cast("int")), F.lit("xx")).alias("lang"),
        )
    ).select("doc_id", "target_name", "target_code", "source_code", F.upper("lang").alias("tag"))
)
over("documents", "u7_languages_left", f"SELECT lang FROM {LANGUAGES_SQL} WHERE lang NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")(
    lambda t: U.languages_left(J.languages(t.sparkSession), t.select("lang"))
)
over("conversations", "f38_control", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'fr' END AS language, turn * 100 AS offset_ms FROM conversations")(
    lambda t: t.withColumn(
        "m", R.parse_control(F.format_string('{"action": "start", "language": "%s", "offset_ms": %d}', F.when(F.col("turn") % 2 == 0, "auto").otherwise("fr"), F.col("turn") * 100))
    ).select("conv_id", "turn", "m.language", "m.offset_ms")
)

# --- sources and sinks
over("conversations", "io7_duration", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 ELSE (conv_id % 24) * 3600000 + turn * 60000 + 12340 END AS ms FROM conversations")(
    lambda t: t.select("conv_id", "turn", R.parse_duration(F.when(F.col("turn") % 3 == 0, "no length").otherwise(F.format_string("  Duration: %02d:%02d:12.34, start: 0", F.col("conv_id") % 24, F.col("turn")))).alias("ms"))
)


@query("io6_silence_log", ", n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY media_id) AS c FROM silence) SELECT media_id, 0::BIGINT AS chunk_no, k AS ord, start_ms, CASE WHEN k = c - 1 THEN m.duration_ms ELSE end_ms END AS end_ms, CASE WHEN CASE WHEN k = c - 1 THEN m.duration_ms ELSE end_ms END - start_ms < 400 THEN 'breath' ELSE 'silence' END AS type FROM n JOIN media m USING (media_id)")
def silence_log(s: DataFrame) -> DataFrame:
    quiet = I.silence(s)
    last = F.max("ord").over(W.Window.partitionBy("media_id"))
    lines = quiet.withColumn("last", last).withColumn(
        "line",
        F.concat(
            F.format_string("silence_start: %s", (F.col("start_ms") / 1000).cast("string")),
            F.when(F.col("ord") < F.col("last"), F.format_string("\nsilence_end: %s | silence_duration: 0", (F.col("end_ms") / 1000).cast("string"))).otherwise(""),
        ),
    )
    log = lines.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("log"))
    whole = log.join(I.media(s), "media_id").withColumn("chunk_no", F.lit(0).cast("bigint")).withColumn("chunk_start_ms", F.lit(0).cast("bigint"))
    return R.parse_silence_log(whole.withColumnRenamed("duration_ms", "chunk_end_ms"))


EXTENSIONS = "mp4 MOV mkv avi mxf webm flv wmv m4v wav mp3 m4a AAC flac ogg opus aiff wma mpg txt".split()
over("pages", "io3_media_kind", f"""WITH e AS (SELECT page_id, lower({EXTENSIONS}[page_id % {len(EXTENSIONS)} + 1]) AS x FROM pages)
SELECT page_id, CASE WHEN x IN ('mp4', 'mov', 'mkv', 'avi', 'mxf', 'webm', 'flv', 'wmv', 'm4v') THEN 'video' WHEN x IN ('wav', 'mp3', 'm4a', 'aac', 'flac', 'ogg', 'opus', 'aiff', 'wma') THEN 'audio' ELSE 'other' END AS kind FROM e""")(
    lambda t: t.select("page_id", R.media_kind(F.concat(F.lit("/a.b/take."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("page_id") % len(EXTENSIONS) + 1).cast("int")))).alias("kind"))
)
over("pages", "io4_choose_source", "SELECT page_id % 7 AS group_id, arg_min(p, r * 1000000 + page_id) AS path FROM (SELECT page_id, concat('f', page_id, ['.mp4', '.txt', '.wav'][page_id % 3 + 1]) AS p, [1, 2, 0][page_id % 3 + 1] AS r FROM pages) GROUP BY 1")(
    lambda t: R.choose_source(t.select((F.col("page_id") % 7).alias("group_id"), F.col("page_id").alias("ord"), F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".mp4"), F.lit(".txt"), F.lit(".wav")), (F.col("page_id") % 3 + 1).cast("int"))).alias("path")))
)
SRT = "SELECT media_id{1}, count(*) AS n_lines, string_agg(concat(number, chr(10), printf('%02d:%02d:%02d,%03d', s // 3600000, (s // 60000) % 60, (s // 1000) % 60, s % 1000), ' --> ', printf('%02d:%02d:%02d,%03d', e // 3600000, (e // 60000) % 60, (e // 1000) % 60, e % 1000), chr(10), t, chr(10)), chr(10) ORDER BY number) AS content FROM {0} GROUP BY ALL"
query("io9_srt_original", ", n AS (SELECT media_id, start_ms AS s, end_ms AS e, trim(text) AS t, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS number FROM segments WHERE trim(text) <> '') " + SRT.format("n", ""))(E.srt_original)
GONE = "CAST(coalesce((SELECT sum(CASE WHEN c.end_ms <= {0} THEN c.end_ms - c.start_ms WHEN c.start_ms < {0} THEN {0} - c.start_ms ELSE 0 END) FROM cuts c WHERE c.media_id = x.media_id), 0) AS BIGINT)"
query("io10_srt_after_cuts", f""", m AS (SELECT media_id, ord, trim(text) AS t, start_ms - {GONE.format('x.start_ms')} AS s, end_ms - {GONE.format('x.end_ms')} AS e FROM segments x WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.media_id = x.media_id AND c.start_ms <= x.start_ms AND c.end_ms >= x.end_ms)),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, ord) AS number FROM m WHERE e > s) """ + SRT.format("n", ""))(lambda s: E.srt_after_cuts(s, cuts_of(s)))
query("io11_srt_translated", f""", m AS (SELECT x.media_id, x.ord, lang, trim(tr.text) AS t, start_ms - {GONE.format('x.start_ms')} AS s, end_ms - {GONE.format('x.end_ms')} AS e FROM segments x JOIN translations tr ON tr.media_id = x.media_id AND tr.seg_no = x.seg_no WHERE trim(tr.text) <> '' AND trim(x.text) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id, lang ORDER BY s, ord) AS number FROM m WHERE e > s) """ + SRT.format("n", ", lang"))(lambda s: E.srt_translated(s, I.translations(s), cuts_of(s)))
query("io12_srt_live", ", n AS (SELECT media_id, start_ms AS s, end_ms AS e, text AS t, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS number FROM segments WHERE trim(text) <> '') " + SRT.format("n", ""))(E.srt_live)
query("io13_txt", "SELECT media_id, count(*) AS n_lines, string_agg(trim(text), chr(10) ORDER BY start_ms, ord) AS content FROM segments WHERE trim(text) <> '' GROUP BY 1")(E.txt)
query("a11_subtitle_lines", "SELECT media_id, count(*) AS n_lines FROM segments WHERE trim(text) <> '' GROUP BY 1")(lambda s: E.srt_original(s).select("media_id", "n_lines"))


@query("io14_edl", KEPT + """SELECT media_id, CAST(max(out_start + out_frame - in_frame) AS BIGINT) AS n_frames, concat('<sequence id="', media_id, '"><rate><timebase>30</timebase></rate><duration>', max(out_start + out_frame - in_frame), '</duration>', chr(10), '  <video>', chr(10),
  string_agg(concat('    <clipitem id="clip-', clip_no, '"><name>A &amp; B ', clip_no, '</name><start>', out_start, '</start><end>', out_start + out_frame - in_frame, '</end><in>', in_frame, '</in><out>', out_frame, '</out><track>', clip_no % 6 + 1, '</track></clipitem>'), chr(10) ORDER BY clip_no), chr(10), '  </video>', chr(10), '</sequence>', chr(10)) AS content FROM placed GROUP BY media_id""")
def edl(s: DataFrame) -> DataFrame:
    clips = W.timeline(W.kept_ranges(cuts_of(s), I.media(s)))
    return E.edl(clips.withColumn("name", F.concat(F.lit("A & B "), F.col("clip_no").cast("string"))).withColumn("camera", F.col("clip_no") % 6 + 1))


over("pages", "io15_dedupe_names", "SELECT page_id AS file_id, concat('clip', page_id % 9, CASE WHEN n = 1 THEN '' ELSE concat('_', n - 1) END, '.srt') AS name FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id % 9 ORDER BY page_id) AS n FROM pages)")(
    lambda t: E.dedupe_names(t.select(F.col("page_id").alias("file_id"), F.concat(F.lit("/x/clip"), (F.col("page_id") % 9).cast("string"), F.lit(".srt")).alias("path")))
)
over("pages", "io16_output_names", "SELECT page_id, concat('v', page_id, '_original.srt') AS original, concat('v', page_id, '_cut.srt') AS cut, concat('v', page_id, '_cut_fr.srt') AS fr FROM pages")(
    lambda t: t.withColumn("p", F.concat(F.lit("/m/v"), F.col("page_id").cast("string"), F.lit(".mp4"))).select(
        "page_id", E.output_name(F.col("p"), "original").alias("original"), E.output_name(F.col("p"), "cut").alias("cut"), E.output_name(F.col("p"), "cut", F.lit("fr")).alias("fr")
    )
)
SUBS = """, p AS (SELECT *, list_transform(range(0, greatest(len(ws), 1), 6), lambda i: array_to_string(list_slice(ws, i + 1, i + 6), ' ')) AS parts FROM word_lists),
u AS (SELECT media_id, ord, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM p),
k AS (SELECT *, len(list_filter(string_split(part, ' '), lambda x: x <> '')) AS nw FROM u),
t AS (SELECT k.*, tr.lang, tr.text AS whole, list_filter(regexp_split_to_array(tr.text, '\\s+'), lambda x: x <> '') AS tw, sum(nw) OVER (PARTITION BY k.media_id, k.ord, tr.lang) AS total FROM k JOIN translations tr ON tr.media_id = k.media_id AND tr.seg_no = k.ord),
g AS (SELECT *, greatest(1, CAST(floor(nw / greatest(total, 1) * len(tw) + 0.5) AS BIGINT)) AS take FROM t),
h AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY media_id, ord, lang ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM g)
SELECT media_id, ord AS parent_no, pos AS piece_no, lang, CASE WHEN n = 1 THEN whole WHEN pos = n - 1 THEN array_to_string(list_slice(tw, CAST(f + 1 AS BIGINT), len(tw)), ' ') ELSE array_to_string(list_slice(tw, CAST(f + 1 AS BIGINT), CAST(f + take AS BIGINT)), ' ') END AS translation FROM h"""
query("f18_split_translation", SUBS.replace("\\\\", "\\"))(
    lambda s: X.split_translation(X.split_segments(s, "maxWords", 6), I.translations(s)).select("media_id", "parent_no", "piece_no", "lang", "translation")
)


def shouting(prompts_: list[str]) -> list[str]:
    """A stand-in provider: the numbered lines in brackets after the first sentence of the request."""
    out = []
    for p in prompts_:
        head, body = p.split("\n\n", 1)
        said = head.split(".")[0]
        out.append("\n".join(f"{line.split('. ', 1)[0]}. {said}: <{line.split('. ', 1)[1]}>" for line in body.split("\n") if ". " in line))
    return out


query("x1_translate", r", l AS (SELECT media_id, seg_no, regexp_replace(text, '\s+', ' ', 'g') AS t FROM segments) SELECT media_id, seg_no, 'fr' AS lang, concat('Translate the numbered lines from English to French: <', t, '>') AS text FROM l")(
    lambda s: translate(s.withColumn("text", F.regexp_replace("text", r"\s+", " ")), lambda: shouting, "fr", source="en")
)


def every_tenth_second(frame):
    """A stand-in model: a row each ten seconds of a chunk."""
    rows = [(m, c, t, min(t + 10_000, e)) for m, c, s, e in frame.itertuples(index=False) for t in range(s, e, 10_000)]
    return frame.__class__(rows, columns=["media_id", "chunk_no", "start_ms", "end_ms"])


query("x2_apply_model", ", c AS (SELECT media_id, chunk_no, chunk_no * 60000 AS s, least(chunk_no * 60000 + 65000, duration_ms) AS e FROM media, range(1000) r(chunk_no) WHERE chunk_no * 60000 <= duration_ms - 1) SELECT media_id, chunk_no, t AS start_ms, least(t + 10000, e) AS end_ms FROM (SELECT *, unnest(range(s, e, 10000)) AS t FROM c)")(
    lambda s: apply_model(I.media(s), lambda: every_tenth_second, "media_id bigint, chunk_no bigint, start_ms bigint, end_ms bigint", 60_000)
)


# --- files and messages
query("io1_segments", "SELECT media_id, ord, start_ms, end_ms, type, text, language, speaker, CAST(NULL AS VARCHAR) AS speaker_label FROM segments")(
    lambda s: R.read_segments(
        s.sparkSession,
        scratch.written(s.select("media_id", "ord", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "type", "text", "language", "speaker"), "json"),
        "json",
    )
)


def transcripts(s: DataFrame) -> DataFrame:
    """Recogniser output of the turns as it stands in files: seconds and nested words."""
    word = F.struct("word_no", "word", (F.col("start_ms") / 1000).alias("start"), ((F.col("start_ms") + 5) / 1000).alias("end"), F.col("prob").alias("probability"))
    held = I.words(s).groupBy("media_id", F.col("seg_no").alias("ord")).agg(F.array_sort(F.collect_list(word)).alias("ws"))
    rows = s.join(held.hint("merge"), ["media_id", "ord"])
    return rows.select("media_id", "ord", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "language", F.transform("ws", lambda w: w.dropFields("word_no")).alias("words"))


query("io2_transcript_words", "SELECT media_id, seg_no, word_no, word, start_ms, start_ms + 5 AS end_ms, prob FROM words")(
    lambda s: R.words_of(R.read_transcripts(s.sparkSession, scratch.written(transcripts(s), "json")))
)
over("embeddings", "io5_samples", "SELECT CAST(label AS BIGINT) AS media_id, vec_id AS chunk_no, CAST(16000 AS INT) AS sample_rate, len(embedding) AS n, CAST(list_sum(list_transform(embedding, lambda x: trunc(CASE WHEN x < 0 THEN CAST(x AS DOUBLE) * 32768 ELSE CAST(x AS DOUBLE) * 32767 END))) AS BIGINT) AS total FROM embeddings")(
    lambda t: R.read_samples(
        t.sparkSession,
        scratch.written(t.select(F.col("label").cast("bigint").alias("media_id"), F.col("vec_id").alias("chunk_no"), F.lit(16_000).alias("sample_rate"), C.pcm_encode(F.col("embedding")).alias("samples")), "parquet"),
    ).select("media_id", "chunk_no", "sample_rate", F.size("samples").cast("bigint").alias("n"), F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
)


def raw_messages(s: DataFrame) -> DataFrame:
    """A message for each turn: starts, stops, audio, and five kinds of bad ones."""
    n = F.col("seg_no") % 9
    said = F.base64(F.encode(F.concat("role", F.lit("!"), F.when(F.length("role") % 2 == 0, "?").otherwise("")), "utf-8"))
    fields = {"session_id": F.col("media_id"), "action": F.lit("start"), "language": F.when(n == 0, "auto").otherwise("fr")}
    start = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    audio = F.to_json(F.struct(F.col("media_id").alias("session_id"), said.alias("audio")))
    made = F.when(n <= 1, start).when(n == 2, F.replace(start, F.lit("start"), F.lit("stop"))).when(n == 3, audio)
    made = made.when(n == 4, F.lit("no json")).when(n == 5, F.replace(start, F.lit("start"), F.lit("dance"))).when(n == 6, F.lit('{"action": "stop"}'))
    made = made.when(n == 7, F.replace(audio, F.lit('"audio":"'), F.lit('"audio":"*'))).otherwise(F.lit("{}"))
    return s.select("media_id", "seg_no", made.alias("value"), F.timestamp_millis("start_ms").alias("event_ts"))


query("io8_messages", """SELECT media_id, seg_no, seg_no % 9 <= 3 AS good, CASE seg_no % 9 WHEN 0 THEN 'start' WHEN 1 THEN 'start' WHEN 2 THEN 'stop' END AS action,
  CASE seg_no % 9 WHEN 1 THEN 'fr' WHEN 2 THEN 'fr' END AS language, CASE WHEN seg_no % 9 = 3 THEN len(role) + 1 + CASE WHEN len(role) % 2 = 0 THEN 1 ELSE 0 END END AS n_bytes FROM segments""")(
    lambda s: R.parsed_messages(raw_messages(s), "media_id", "seg_no").select(
        "media_id", "seg_no", F.col("reason").isNull().alias("good"), "message.action", "message.language", F.octet_length("message.pcm").cast("bigint").alias("n_bytes")
    )
)
