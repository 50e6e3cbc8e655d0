"""Operator 3: chat formatting by event-sourced reconstruction.

A conversation is a log: ``message`` starts a message, ``delta`` appends to it,
``edit`` and ``regenerate`` replace what it said, ``delete`` takes it away. The log is
partitioned by conversation and message, sorted by sequence number and folded: what
precedes the last replacement doesn't matter and is left out before the sort, so a
group holds the parts of one final text only. Messages stand in the order of their
first events.

Each message renders to a segment of its own, ``<s>[INST]role[/INST]text</s>`` and a
line feed; a conversation is its segments in order. Control strings within roles and
texts get one more backslash behind their first character, which reading back takes
away again, so any text survives. The loss mask covers the texts of ``assistant``.
A conversation isn't gathered: readers stream sorted segments.

Rows: null texts and roles are empty strings; events without a conversation or a
message form a group under null; exact repeats of an event count once; tied sequence
numbers sort by kind, then text. In a table of finished turns each row is a turn, also
those that tie, repeat or have no number. Deltas before any message stand. An empty log gives
no conversation. Other columns of the log are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorscape.llm.shared import table

RESETS = ("message", "edit", "regenerate", "delete")
#: What follows the first character of a control string.
_REST = r"(/?s>|/?INST\])"
_SEGMENT = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>\n", re.DOTALL)
_ESCAPED = re.compile(rf"([<\[])\\(\\*){_REST}")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*){_REST}", r"$1$2\\$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def reconstruct(events: DataFrame, finished: bool = False) -> DataFrame:
    """(conv_id, position, role, text, msg) from events (conv_id, msg, seq, kind, role, text).

    ``finished``: the log has no deltas, so that no text is shuffled to meet its tail.
    """
    group = ["conv_id", "msg"]
    e = events.select(*group, "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    reset = F.col("kind").isin(*RESETS)
    heads = e.groupBy(*group).agg(
        F.min("seq").alias("position"),
        F.max(F.when(reset, F.struct("seq", "kind", "text"))).alias("head"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
    )
    if finished:
        whole = heads.filter("head.kind <> 'delete'")
        return whole.select("conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), "head.text", "msg")
    parts = e.filter(~reset).join(heads.select(F.col("conv_id").alias("_c"), F.col("msg").alias("_m"), F.col("head.seq").alias("_at")), F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("msg").eqNullSafe(F.col("_m")))
    parts = parts.filter(F.col("_at").isNull() | (F.col("seq") > F.col("_at"))).groupBy("_c", "_m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda x: x["text"]), "").alias("tail"))
    out = heads.join(parts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("msg").eqNullSafe(F.col("_m")), "left")
    out = out.filter((F.coalesce(F.col("head.kind"), F.lit("")) != "delete") | F.col("tail").isNotNull())
    return out.select("conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.coalesce("head.text", F.lit("")), F.coalesce("tail", F.lit(""))).alias("text"), "msg")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, position, msg, segment, loss_from, loss_to): the mask in code points of the segment, empty if not the assistant's."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit("<s>[INST]"), role, F.lit("[/INST]"))
    start = F.length(head)
    mine = F.col("role") == "assistant"
    return messages.select("conv_id", "position", "msg", F.concat(head, text, F.lit("</s>\n")).alias("segment"), start.alias("loss_from"), F.when(mine, start + F.length(text)).otherwise(start).alias("loss_to"))


def digests(segments: DataFrame) -> DataFrame:
    """Read the formatted conversations back; one row each, streamed, so that memory doesn't grow with a conversation."""
    kind = segments.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, state, current = [], None, object()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in done], id_type), pa.array([r[1][0] for r in done], pa.int64()), pa.array([r[1][1].hexdigest() for r in done], pa.string()), pa.array([r[1][2] for r in done], pa.int64()), pa.array([r[1][3].hexdigest() for r in done], pa.string()), pa.array([r[1][4] for r in done], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            done.clear()
            return out

        for b in batches:
            id_type = b.schema.field(0).type
            for conv, segment, a, z in zip(*(b.column(k).to_pylist() for k in range(4))):
                if conv != current or state is None:
                    if state is not None:
                        done.append((current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = map(unescape, _SEGMENT.fullmatch(segment).groups())
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                under = unescape(segment[a:z])
                state[2] += len(under)
                state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if len(done) >= 4096:
                yield flush()
        if state is not None:
            done.append((current, state))
            yield flush()

    # The window brings each conversation together and sorts it, without a shuffle where that has been done.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("position", "msg"))
    return segments.select("conv_id", "segment", "loss_from", "loss_to", place.alias("place")).mapInArrow(run, schema)


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one ``message`` event for each row.

    Rows are numbered within their conversation by turn (nulls last), role and text, so rows that tie or repeat stay turns of their own.
    """
    said = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long")
    return said.withColumn("msg", place).select("conv_id", "msg", F.col("msg").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return digests(render(reconstruct(turn_events(given.unionByName(extra)), finished=True)))


_ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\2\\\3', 'g')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) + 21) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
