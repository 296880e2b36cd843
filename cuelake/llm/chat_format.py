"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events (conv_id, seq, kind, turn, role, text):

* ``message`` begins a message at a turn, with text;
* ``delta`` appends streamed text to the turn's latest message;
* ``edit`` puts its text in place of that message's text;
* ``regenerate`` empties that message (later deltas fill it again) and drops
  what stood at later turns, as those answered a text that is gone.

The log is dealt by conversation and sorted by (turn, seq) inside each
partition by Spark, which spills; each task reads its rows once as a stream and
holds one message at a time plus the rendered conversation.

Template, for each turn: ``<s>[INST] role [/INST]\\ntext</s>\\n``.  Inside texts
and roles a backslash is doubled and each control string gets a backslash after
its first character, so no control string of the output comes from a text;
``unescape`` undoes this exactly.

Defined results: null text and null role are empty; events for a turn with no
message begin one with an empty role unless the event has one; equal events
stay separate; conversations with no message left give no row; a null conv_id
is a conversation; null turns and seqs sort first; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.common import table

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the (start, end) of each text that bears loss."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"<s>[INST] {escape(role)} [/INST]\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}</s>\n")
        at += len(parts[-1])
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def fold(events) -> Iterator[tuple[str, str]]:
    """The final messages of one conversation from its events in (turn, seq) order."""
    dropped_before = None  # the latest regeneration at an earlier turn
    here, turn, latest, message = [], object(), None, None
    for kind, at, seq, role, text in events:
        if at != turn:
            yield from ((r or "", "".join(t)) for r, t in here)
            if latest is not None and (dropped_before is None or latest > dropped_before):
                dropped_before = latest
            here, turn, latest, message = [], at, None, None
        if dropped_before is not None and seq is not None and seq < dropped_before:
            continue
        if kind == "message" or message is None:
            message = [role, []]
            here.append(message)
        if kind in ("edit", "regenerate"):
            message[1] = []
        if kind == "regenerate":
            latest = seq if latest is None or (seq is not None and seq > latest) else latest
        elif text:
            message[1].append(text)
    yield from ((r or "", "".join(t)) for r, t in here)


def events_of(messages: DataFrame) -> DataFrame:
    """A log, as a chat server would leave it, whose final messages are the given ones (conv_id, turn, role, text).

    Each message, by its number in the conversation, was sent whole; or streamed
    as three deltas; or sent with other words and edited; or streamed with other
    words, answered by a later turn, and then regenerated, which drops that
    answer.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    said, size = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    third = F.floor(size / 3).cast("int")

    def event(kind, text, role=False, after=0):
        return F.struct(
            F.lit(kind).alias("kind"), F.try_add(F.col("turn"), F.lit(after)).alias("turn"),
            (F.col("role") if role else F.lit(None).cast("string")).alias("role"), text.cast("string").alias("text"),
        )

    deltas = [event("delta", F.substring(said, F.lit(1), third)), event("delta", F.substring(said, third + 1, third)), event("delta", F.substring(said, 2 * third + 1, size))]
    wrong, none = F.concat(F.lit("no, wait: "), F.reverse(said)), F.lit(None)
    logs = (
        F.array(event("message", F.col("text"), True)),
        F.array(event("message", none, True), *deltas),
        F.array(event("message", wrong, True), event("edit", said)),
        F.array(
            event("message", none, True), event("delta", wrong), event("message", F.lit("an answer to words that are gone"), True, 1),
            event("regenerate", none), *deltas,
        ),
    )
    # A null or the last turn has none after it, so no answer to drop.
    later = F.coalesce(F.col("turn") < F.lit(2**63 - 1), F.lit(False))
    way = F.when(later, F.pmod(F.xxhash64("conv_id", "__number"), F.lit(len(logs)))).otherwise(0)
    log = F.when(way == 0, logs[0])
    for k, made in enumerate(logs[1:], 1):
        log = log.when(way == k, made)
    rows = messages.select("conv_id", "turn", "role", "text", number.alias("__number"))
    return rows.select("conv_id", "__number", F.posexplode(log).alias("__at", "__e")).select(
        "conv_id", (F.col("__number") * 16 + F.col("__at")).cast("bigint").alias("seq"), "__e.kind", "__e.turn", "__e.role", "__e.text"
    )


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation with a message."""
    schema = "conv_id bigint, formatted string, loss_spans array<struct<begin:bigint,end:bigint>>"
    kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
    columns = ("kind", "turn", "seq", "role", "text")

    def chats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(batch.column("conv_id").to_pylist(), zip(*(batch.column(c).to_pylist() for c in columns)))

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names=["conv_id", "formatted", "loss_spans"])

        done, held = [], 0
        for conv, events in groupby(rows(), key=lambda row: row[0]):
            if messages := list(fold(event for _, event in events)):
                formatted, spans = render(messages)
                done.append((conv, formatted, [{"begin": a, "end": b} for a, b in spans]))
                held += len(formatted)
            if held > 4_000_000 or len(done) >= 2_000:
                yield out(done)
                done, held = [], 0
        if done:
            yield out(done)

    ordered = (
        events.select(F.col("conv_id").cast("bigint"), *columns)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    )
    return ordered.mapInArrow(chats, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its loss mask say, read back from them alone."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                turns, whole, loss, n_loss = read_back(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["begin"] : span["end"]])
                    n_loss += len(said)
                    loss.update(said.encode())
                rows.append((conv, len(turns), whole.hexdigest(), n_loss, loss.hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(read, schema)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(events_of(given.unionByName(probe))))


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    length(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0#', 'g')) AS text_chars,
    length(regexp_replace(regexp_replace(role, '\\', '\\\\', 'g'), '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0#', 'g')) AS role_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length('<s>[INST]  [/INST]' || chr(10) || '</s>' || chr(10)) + role_chars + text_chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
