"""Fixed schemas, as DDL.  Times are BIGINT milliseconds; ord is the order in the source list."""

WORDS = "array<struct<word:string,start_ms:bigint,end_ms:bigint,probability:double>>"
MEDIA = "media_id bigint, path string, kind string, duration_ms bigint"
SEGMENTS = (
    "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, type string, text string, "
    "language string, speaker string, speaker_label string"
)
#: As written by recognisers: seconds with fractions.
SEGMENT_SECONDS = (
    "media_id bigint, ord bigint, start double, end double, type string, text string, "
    "language string, speaker string, speakerLabel string"
)
TRANSCRIPT_SECONDS = (
    "media_id bigint, ord bigint, start double, end double, text string, language string, no_speech_prob double, "
    "avg_logprob double, words array<struct<word:string,start:double,end:double,probability:double>>"
)
TURNS = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, speaker string"
SPEAKERS = "media_id bigint, speaker string, pos int, label string"
TRANSLATIONS = "media_id bigint, seg_no bigint, lang string, text string"
SAMPLES = "media_id bigint, chunk_no bigint, sample_rate int, samples array<smallint>"
FRAMES = "session_id bigint, frame_no bigint, is_speech boolean, event_ts timestamp"
HYPOTHESES = (
    "session_id bigint, cycle bigint, buffer_start_ms bigint, buffer_dur_ms bigint, kind string, "
    f"words {WORDS}, event_ts timestamp"
)
CONTROL = "action string, language string, offset_ms bigint, targets array<string>"
MESSAGE = "session_id bigint, action string, language string, model string, time_offset double, audio string, _corrupt string"
