"""Live sessions: utterances from frames, agreed words from successive hypotheses, lines from words.

Each operator has a step on one session's state.  Streams run it through
``transformWithStateInPandas`` keyed by session_id, with typed states; the batch
forms run the same step over a session's rows in order, so both give the same
rows.

A session ends with its stop, or when it has been silent for longer than
``silent_ms`` of event time: a timer then drops its state, with what it held, as
the end of a connection without a stop does.  A row that comes after such a
silence begins a new session under the old name, in streams and batches alike.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cuelake.functions.text import (
    CLINGS,
    KEY_EDGES,
    LEAST_PAIR_TOKENS,
    LEAST_TOKENS,
    MADE_UP_PHRASES,
    MAX_PAIR_SHARE,
    MAX_TOKEN_SHARE,
    MIN_MEAN_PROBABILITY,
    TOKEN_EDGES,
    draft_key,
)

FRAME_MS = 30
ONSET_FRAMES = 6
END_FRAMES = 12
MAX_BUFFER_MS = 12_000
AGREE_MS = 500
SURE, SURE_TAIL_MS = 0.72, 150
SENTENCES, MOST_WORDS, LEAST_PENDING = 2, 28, 8
LEAST_STOP_MS = 400
HARD = ".!?。？！"

REVEALED = "session_id bigint, cycle bigint, new_words array<string>"
GRADUATED = "session_id bigint, line_no bigint, start_ms bigint, left_at bigint"
UTTERANCES = "session_id bigint, start_ms bigint, end_ms bigint, forced boolean"
EVENTS = "session_id bigint, cycle bigint, event string, line_no bigint, text string, start_ms bigint, end_ms bigint"


def utterance_step(state: dict, frame_no: int, is_speech: bool) -> list[tuple[int, int, bool]]:
    """(start_ms, end_ms, forced) of an utterance that this frame ends."""
    if "start" not in state:
        state["run"] = state.get("run", 0) + 1 if is_speech else 0
        if not state["run"]:
            del state["run"]
        elif state["run"] == ONSET_FRAMES:
            state.update(start=frame_no - ONSET_FRAMES + 1, quiet=0, run=0)
        return []
    state["quiet"] = 0 if is_speech else state["quiet"] + 1
    length = (frame_no + 1 - state["start"]) * FRAME_MS
    ended, forced = state["quiet"] == END_FRAMES, length >= MAX_BUFFER_MS
    if not (ended or forced):
        return []
    out = [(state.pop("start") * FRAME_MS, (frame_no + 1) * FRAME_MS, not ended)]
    del state["quiet"], state["run"]
    return out


@lru_cache(1 << 16)
def _key(word: str) -> str:
    return word.strip().lower().strip(KEY_EDGES)


@lru_cache(1 << 16)
def _token(word: str) -> str:
    return word.lower().strip(TOKEN_EDGES)


def _compose(words: list[str]) -> str:
    out = ""
    for w in filter(None, words):
        out += w if not out or w.startswith(" ") or w[:1] in CLINGS else f" {w}"
    return out.strip()


def made_up(words: list[tuple]) -> bool:
    """The verdict of functions.text.is_hallucination on (word, start, end, probability) tuples."""
    if not words:
        return False
    said = [w[0] for w in words if w[0]]
    tokens = list(map(_token, said))
    pairs = list(zip(tokens, tokens[1:]))
    top = lambda xs: max(Counter(xs).values()) / len(xs)
    joined = " ".join(map(str.strip, said)).lower()
    return (
        sum(w[3] or 0.0 for w in words) / len(words) < MIN_MEAN_PROBABILITY
        or any(p in joined for p in MADE_UP_PHRASES)
        or (len(tokens) >= LEAST_TOKENS and top(tokens) > MAX_TOKEN_SHARE)
        or (len(tokens) >= LEAST_PAIR_TOKENS and top(pairs) > MAX_PAIR_SHARE)
    )


def agreed(before: list[tuple], now: list[tuple]) -> int:
    n = 0
    for a, b in zip(before, now):
        if _key(a[0]) != _key(b[0]) or abs(a[1] - b[1]) > AGREE_MS:
            break
        n += 1
    return n


def live_step(state: dict, cycle: int, kind: str, buffer_end_ms: int, buffer_dur_ms: int, words: list[tuple], skip_recommitted: bool = True) -> list[tuple]:
    """(event, line_no, text, start_ms, end_ms) of one decode cycle: partial, pause or stop.

    state: last_end of what is committed, the tail of the cycle before, pending
    words of the open line, the number of lines, and the last draft shown.  A
    made-up hypothesis gives no words: a partial cycle passes without a trace, a
    pause or stop still closes what is pending.  A pause shows the open line
    again, or clears the display if there is none.  A stop takes words only from
    a buffer of LEAST_STOP_MS or more, closes every line and leaves no state.
    """
    pending, out = state.setdefault("pending", []), []
    unreal = made_up(words)
    if kind == "partial" and (unreal or not words):
        return out
    heard = kind != "stop" or buffer_dur_ms >= LEAST_STOP_MS
    if unreal or not heard:
        words = []
    if skip_recommitted:
        words = [w for w in words if w[1] >= state.get("last_end", 0)]
    n = agreed(state.get("tail", []), words)
    if kind == "partial":
        while n < len(words) and (words[n][3] or 0) >= SURE and buffer_end_ms - words[n][2] >= SURE_TAIL_MS:
            n += 1
        if n == 0 and buffer_dur_ms >= MAX_BUFFER_MS:
            n = len(words)
    else:
        n = len(words)
    committed, state["tail"] = words[:n], words[n:]
    if committed:
        state["last_end"] = committed[-1][2]

    def close():
        text = _compose([w[0] for w in pending])
        if text:
            out.append(("final", state.get("lines", 0), text, pending[0][1], pending[-1][2]))
            state["lines"] = state.get("lines", 0) + 1
            state["draft"] = ""
        pending.clear()

    ends = sum(p[0].strip()[-1:] in HARD for p in pending if p[0].strip())
    for w in committed:
        pending.append(list(w))
        hard = w[0].strip() != "" and w[0].strip()[-1:] in HARD
        ends += hard
        if (hard and ends >= SENTENCES) or (not hard and len(pending) >= MOST_WORDS):
            close()
            ends = 0
    if pending and (kind == "stop" or (kind == "pause" and len(pending) >= LEAST_PENDING)):
        close()
    if kind == "pause":
        state["draft"] = ""
    draft = _compose([w[0] for w in pending])
    if draft and draft != state.get("draft", ""):
        state["draft"] = draft
        out.append(("draft", state.get("lines", 0), draft, pending[0][1], pending[-1][2]))
    tail = state["tail"]
    shown = " ".join(w[0].strip() for w in tail).strip()
    if shown:
        out.append(("partial", state.get("lines", 0), shown, tail[0][1], tail[-1][2]))
    elif not out if kind == "partial" else heard and not pending:
        out.append(("partial", state.get("lines", 0), "", None, None))
    if kind == "stop":
        state.clear()
    return out


def _ended(state: dict, at: int, silent_ms: int) -> None:
    """Empty the state of a session that has been silent for too long; keep the time of its latest row."""
    if at - state.get("seen", at) > silent_ms:
        state.clear()
    state["seen"] = max(at, state.get("seen", at))


def _millis(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[us]").astype("int64") // 1000).tolist()


def _frame_rows(session: int, rows: pd.DataFrame, state: dict, silent_ms: int) -> list[tuple]:
    out = []
    for frame_no, is_speech, at in zip(rows["frame_no"].tolist(), rows["is_speech"].tolist(), _millis(rows["event_ts"])):
        _ended(state, at, silent_ms)
        out += [(session, *u) for u in utterance_step(state, frame_no, bool(is_speech))]
    return out


def _cycle_rows(session: int, rows: pd.DataFrame, state: dict, silent_ms: int) -> list[tuple]:
    out = []
    for r, at in zip(rows.itertuples(index=False), _millis(rows["event_ts"])):
        _ended(state, at, silent_ms)
        words = [(w["word"], int(w["start_ms"]), int(w["end_ms"]), w["probability"]) for w in r.words]
        made = live_step(state, r.cycle, r.kind, r.buffer_start_ms + r.buffer_dur_ms, r.buffer_dur_ms, words)
        out += [(session, r.cycle, *e) for e in made]
    return out


def _cycle_batches(batches: Iterator[pa.RecordBatch], silent_ms: int) -> Iterator[pa.RecordBatch]:
    """The events of whole sessions, their rows in order; only the state of one session and one batch are held."""
    kinds = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in EVENTS.split(", ")])
    state: dict = {}
    for batch in batches:
        word, *others = batch.column("words").flatten().flatten()
        word = word.dictionary_encode()
        unlike = [*word.dictionary.to_pylist(), None]
        word = [unlike[i] for i in word.indices.fill_null(-1).to_numpy().tolist()]
        said = list(zip(word, *(x.to_pylist() if x.null_count else x.to_numpy().tolist() for x in others)))
        sizes = batch.column("words").value_lengths().fill_null(0).to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("session_id", "cycle", "kind", "buffer_start_ms", "buffer_dur_ms", "at", "place")]
        out, begin = [], 0
        for session, cycle, kind, start_ms, dur_ms, at, place, size in zip(*columns, sizes):
            if place == 1:
                state.clear()
            _ended(state, at, silent_ms)
            words = said[begin : begin + size]
            begin += size
            out += [(session, cycle, *e) for e in live_step(state, cycle, kind, start_ms + dur_ms, dur_ms, words)]
        columns = list(zip(*out)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def _pandas(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.astype({c: "Int64" for c in ("start_ms", "end_ms") if c in out})


WORDS = "word string, start_ms bigint, end_ms bigint, probability double"
#: The states of each operator: single values, then lists of tuples.
FRAME_STATE = ("seen bigint, start bigint, run bigint, quiet bigint", {})
LIVE_STATE = ("seen bigint, last_end bigint, lines bigint, draft string", {"pending": WORDS, "tail": WORDS})
KNOWN_STATE = ("seen bigint, known bigint", {})
HELD_STATE = ("seen bigint, held_line bigint, held_start bigint", {})


class _Session(StatefulProcessor):
    """A fold over the rows of each session, its dictionary kept as a value state and list states."""

    def __init__(self, order: str, fold, schema: str, states: tuple[str, dict[str, str]], silent_ms: int | None, whole_key: bool = False):
        self.order, self.fold, self.schema, self.states, self.silent_ms, self.whole_key = order, fold, schema, states, silent_ms, whole_key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.states[0])
        self.lists = {name: handle.getListState(name, schema) for name, schema in self.states[1].items()}
        self.names = [f.split()[0] for f in self.states[0].split(", ")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(self.names, self.value.get())) if self.value.exists() else {}
        held = {k: v for k, v in held.items() if v is not None}
        for name, state in self.lists.items():
            if state.exists():
                held[name] = [tuple(x) for x in state.get()]
        out = self.fold(key if self.whole_key else key[0], pd.concat(list(rows)).sort_values(self.order), held)
        self._forget()
        if set(held) - {"seen"}:
            self.value.update(tuple(held.get(name) for name in self.names))
            for name, state in self.lists.items():
                if held.get(name):
                    state.put([tuple(x) for x in held[name]])
            if self.silent_ms is not None:
                self.handle.registerTimer(held["seen"] + self.silent_ms + 1)
        yield _pandas(out, self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield _pandas([], self.schema)

    def _forget(self) -> None:
        self.value.clear()
        for state in self.lists.values():
            state.clear()
        for timer in list(self.handle.listTimers()) if self.silent_ms is not None else []:
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def _use_typed_states(df: DataFrame) -> None:
    """Typed states need this store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _streamed(df: DataFrame, order: str, fold, schema: str, states: tuple, silent_ms: int | None, late: str) -> DataFrame:
    _use_typed_states(df)
    timed = silent_ms is not None
    rows = df.withWatermark("event_ts", late) if timed else df
    return rows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Session(order, fold, schema, states, silent_ms), outputStructType=schema, outputMode="Append",
        timeMode="EventTime" if timed else "None",
    )


def session_fold(df: DataFrame, keys: tuple[str, ...], order: str, fold, schema: str, value: str) -> DataFrame:
    """A stream's fold(key, rows, held) by keys, held being a dictionary of the value state's fields."""
    _use_typed_states(df)
    processor = _Session(order, fold, schema, (value, {}), None, whole_key=True)
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def _batch(df: DataFrame, order: str, fold, schema: str) -> DataFrame:
    def whole(key, rows):
        return _pandas(fold(key[0], rows.sort_values(order), {}), schema)

    return df.groupBy("session_id").applyInPandas(whole, schema)


#: A session is over after an hour without a row.
SILENT_MS = 3_600_000
LATE = "10 seconds"


def utterances(frames: DataFrame, silent_ms: int = SILENT_MS, late: str = LATE) -> DataFrame:
    """Utterances of each session; rows of one trigger are taken in frame order."""
    read = frames.select("session_id", "frame_no", "is_speech", "event_ts")
    fold = partial(_frame_rows, silent_ms=silent_ms)
    if frames.isStreaming:
        return _streamed(read, "frame_no", fold, UTTERANCES, FRAME_STATE, silent_ms, late)
    return _batch(read, "frame_no", fold, UTTERANCES)


def live_transcript(hypotheses: DataFrame, silent_ms: int = SILENT_MS, late: str = LATE) -> DataFrame:
    """final, draft and partial events of each session."""
    read = hypotheses.select("session_id", "cycle", "kind", "buffer_start_ms", "buffer_dur_ms", "words", "event_ts")
    if hypotheses.isStreaming:
        return _streamed(read, "cycle", partial(_cycle_rows, silent_ms=silent_ms), EVENTS, LIVE_STATE, silent_ms, late)
    # The window brings the rows of a session together and in order; a call for each session would cost more than its rows.
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("cycle"))
    words = F.col("words").cast(f"array<struct<{WORDS.replace(' ', ':').replace(',:', ',')}>>")
    rows = read.withColumn("words", words).withColumn("place", place).withColumn("at", F.unix_millis("event_ts")).drop("event_ts")
    return rows.mapInArrow(partial(_cycle_batches, silent_ms=silent_ms), EVENTS)


def speech_sessions(frames: DataFrame, gap: str = "360 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Utterances as session windows over speech frames: built-in, with a watermark for late rows."""
    speech = frames.filter("is_speech")
    speech = speech.withWatermark("event_ts", late) if frames.isStreaming else speech
    return speech.groupBy("session_id", F.session_window("event_ts", gap).alias("w")).agg(F.count("*").alias("n_frames")).select(
        "session_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n_frames"
    )


def cadence(hypotheses: DataFrame, every: str = "800 milliseconds", least_ms: int = 400) -> DataFrame:
    """The last hypothesis of each session and interval that has enough of a buffer."""
    ready = hypotheses.filter(F.col("buffer_dur_ms") >= least_ms)
    ready = ready.withWatermark("event_ts", "10 seconds") if hypotheses.isStreaming else ready
    return ready.groupBy("session_id", F.window("event_ts", every).alias("w")).agg(F.max("cycle").alias("cycle"))


def latest_actions(actions: DataFrame) -> DataFrame:
    """Of actions that came while a session was busy, the last."""
    return actions.groupBy("session_id").agg(F.max_by("action", "seq").alias("action"))


def _new_words(session: int, rows: pd.DataFrame, state: dict) -> list[tuple]:
    out = []
    for cycle, words in zip(rows["cycle"].tolist(), rows["words"]):
        known = state.get("known", 0)
        if words is not None and len(words) > known:
            out.append((session, cycle, list(words[known:])))
            state["known"] = len(words)
    return out


def append_only(word_lists: DataFrame) -> DataFrame:
    """Only the words beyond those that the session has shown."""
    if word_lists.isStreaming:
        return _streamed(word_lists.select("session_id", "cycle", "words"), "cycle", _new_words, REVEALED, KNOWN_STATE, None, LATE)
    upto = Window.partitionBy("session_id").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.size("words")).over(upto), F.lit(0))
    new = word_lists.withColumn("known", known).filter(F.size("words") > F.col("known"))
    return new.select("session_id", "cycle", F.slice("words", F.col("known") + 1, F.size("words") - F.col("known")).alias("new_words"))


def _left_box(session: int, rows: pd.DataFrame, state: dict) -> list[tuple]:
    out = []
    for line_no, start_ms in zip(rows["line_no"].tolist(), rows["start_ms"].tolist()):
        if "held_line" in state:
            out.append((session, state["held_line"], state["held_start"], start_ms))
        state.update(held_line=line_no, held_start=start_ms)
    return out


def graduated(lines: DataFrame) -> DataFrame:
    """Lines that left the live box, and when: as the next one began; a stream gives the columns of GRADUATED."""
    if lines.isStreaming:
        return _streamed(lines.select("session_id", "line_no", "start_ms"), "line_no", _left_box, GRADUATED, HELD_STATE, None, LATE)
    order = Window.partitionBy("session_id").orderBy("line_no")
    return lines.withColumn("left_at", F.lead("start_ms").over(order)).filter(F.col("left_at").isNotNull())


def long_enough(drafts: DataFrame, least_words: int = 4) -> DataFrame:
    return drafts.filter(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least_words)


def drafts_to_translate(drafts: DataFrame, least_words: int = 4) -> DataFrame:
    """The latest draft of each line and language with words enough; ``changes.draft_changes`` gives a stream's superseded ones too."""
    return long_enough(drafts, least_words).groupBy("session_id", "index", "lang").agg(F.max_by("text", "cycle").alias("text"))


def finals_with_drafts(finals: DataFrame, drafts: DataFrame, within: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Finals, each with the translation that a draft of the same text got in the time before it; null without one.

    finals: session_id, index, lang, text, event_ts; drafts the same with cached.
    Of drafts with one text the earliest counts (in a stream the first to come).
    In a stream a final with a match goes out at once, one without as soon as the
    watermark shows that none can come.
    """
    key = ["session_id", "index", "lang", "text_key"]
    ready = drafts.filter(F.coalesce("cached", F.lit("")) != "").withColumn("text_key", draft_key(F.col("text")))
    if drafts.isStreaming:
        ready = ready.withColumnRenamed("event_ts", "draft_ts").withWatermark("draft_ts", late)
        ready = ready.select(*key, "draft_ts", F.col("cached").alias("reused")).dropDuplicatesWithinWatermark(key)
    else:
        ready = ready.groupBy(*key).agg(F.min(F.struct("event_ts", "cached")).alias("d"))
        ready = ready.select(*key, F.col("d.event_ts").alias("draft_ts"), F.col("d.cached").alias("reused"))
    said = finals.withWatermark("event_ts", late) if finals.isStreaming else finals
    f, d = said.withColumn("text_key", draft_key(F.col("text"))).alias("f"), ready.alias("d")
    same = F.expr(f"d.draft_ts BETWEEN f.event_ts - INTERVAL {within} AND f.event_ts")
    for c in key:
        same = same & (F.col(f"f.{c}") == F.col(f"d.{c}"))
    return f.join(d, same, "left").select(*[f"f.{c}" for c in finals.columns], "d.reused")


def on_batches(rows: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run call(rows, batch_id) for every batch of a stream, until all that is there has been read.

    A batch that failed is called again under the same number, so a call that
    writes should write by that number (see ``by_batch``).
    """
    return rows.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A call for ``on_batches`` that writes each batch to a folder of its own; a repeated batch replaces itself."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the recent batches of a query left out because they came after the watermark."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def session_summary(finals: DataFrame) -> DataFrame:
    return finals.groupBy("session_id").agg(F.count("*").alias("n_lines"), F.max("end_ms").alias("duration_ms"))


def rolling_context(finals: DataFrame, n: int = 400) -> DataFrame:
    """The last n characters said before each line, lines joined by a space.

    Lines stand at their offset in characters, so a frame of n characters holds
    every line that begins within reach, however short; the one before those
    may reach into it with its end.
    """
    order = Window.partitionBy("session_id").orderBy("line_no")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") + 1)
    placed = finals.withColumn("__at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    at = Window.partitionBy("session_id").orderBy("__at")
    begun = F.collect_list("text").over(at.rangeBetween(-(n + 1), -1))
    before = F.last("text", ignorenulls=True).over(at.rangeBetween(Window.unboundedPreceding, -(n + 2)))
    said = F.array_join(F.concat(F.filter(F.array(before), lambda t: t.isNotNull()), begun), " ")
    return placed.withColumn("context", F.right(said, F.lit(n))).drop("__at")


def resumed(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Times of a resumed session moved by what came before it."""
    moved = rows.join(offsets.select("session_id", "offset_ms"), "session_id", "left").withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0)))
    return moved.withColumn("start_ms", F.col("start_ms") + F.col("offset_ms")).withColumn("end_ms", F.col("end_ms") + F.col("offset_ms")).drop("offset_ms")
