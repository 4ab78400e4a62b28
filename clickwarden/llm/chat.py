"""Chat formatting from an event log: fold deltas, edits and regenerations, then render.

An event has conv_id, turn, seq, kind, role and text. Kinds:

* ``message`` opens a message with this text in its turn;
* ``delta`` appends its text to the turn's latest message, which it opens where there is none;
* ``edit`` replaces the text of the turn's latest message;
* ``regenerate`` empties it, and what later turns held before that moment is withdrawn.

Events are moved by (conversation, turn), so a conversation that holds most rows is folded and
rendered by many tasks. Only the digests of a finished conversation are read in one stream.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a text gets a backslash
after its first character, and one that has backslashes there gets one more, so the output can be
read back exactly; line feeds and backslashes of a role are written as ``\\n`` and ``\\\\``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates without their first character.
_TAIL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_TAIL}", rf"([<\[])\\(\\*){_TAIL}"
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)
_UNESCAPER = re.compile(_UNESCAPE)
_ROLE_UNESCAPER = re.compile(r"\\(.)", re.DOTALL)
_KINDS = ("message", "delta", "edit", "regenerate")
_MESSAGE = "conv_id long, turn long, seq long, nth long, role string, text string"
_DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            yield from batch.slice(lo, 512).to_pylist()


def _batches(rows, schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == size:
            yield pa.RecordBatch.from_pylist(waiting, schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema=schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64()) for n in ("conv_id", "turn", "seq", "nth")] + [(n, pa.string()) for n in ("role", "text")])

    def messages():
        place, message, parts, nth = None, None, [], 0
        for e in _rows(batches):
            at = (e["conv_id"], e["turn"])
            if message and (at != place or e["kind"] == "message"):
                yield message | {"text": "".join(parts)}
                message = None
            if at != place:
                place, nth = at, 0
            if message is None:
                if e["kind"] == "regenerate":
                    continue
                message, parts, nth = {"conv_id": at[0], "turn": at[1], "seq": e["seq"], "nth": nth, "role": e["role"]}, [e["text"]], nth + 1
            elif e["kind"] == "delta":
                parts.append(e["text"])
            else:
                parts = [e["text"] if e["kind"] == "edit" else ""]
        if message:
            yield message | {"text": "".join(parts)}

    yield from _batches(messages(), schema)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, seq, nth (number within the turn), role, text.

    Order inside a turn is (seq, kind, role, text). A null kind is a message, a null text or role
    is empty, an unknown kind fails the job. Null conversation ids and turns are keys of their own,
    null turns come first. Rows repeated are events repeated: two equal message events are two
    messages. Other columns are ignored.
    """
    number = F.create_map(*[F.lit(x) for pair in zip(_KINDS, range(len(_KINDS))) for x in pair])
    kind = F.coalesce("kind", F.lit("message"))
    events = events.select(
        *(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn", "seq")),
        F.when(number[kind].isNull(), F.raise_error(F.concat(F.lit("unknown kind of event: "), kind))).otherwise(kind).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the latest regeneration in an earlier turn: one narrow row per turn
    turns = events.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    withdrawn = turns.withColumn("cut", F.max("again").over(earlier)).where("cut IS NOT NULL").select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), "cut")
    alive = events.join(withdrawn, events.conv_id.eqNullSafe(F.col("c")) & events.turn.eqNullSafe(F.col("t")), "left")
    alive = alive.where("cut IS NULL OR seq > cut").drop("c", "t", "cut")
    placed = alive.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", number[F.col("kind")], "role", "text")
    return placed.mapInArrow(_fold, _MESSAGE)


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\$3")


def escape_role(role: Column) -> Column:
    return escape_text(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_text(text: str) -> str:
    return _UNESCAPER.sub(r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return _ROLE_UNESCAPER.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape_text(role))


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Adds ``rendered`` and the loss span in it, in code points; only texts of role ``learn_from`` have one."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape_text(F.col("text"))
    learned = F.col("role") == learn_from
    return messages.withColumns({
        "rendered": F.concat(head, body, F.lit(CLOSE + "\n")),
        "loss_start": F.when(learned, F.char_length(head)),
        "loss_length": F.when(learned, F.char_length(body)),
    })


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests():
        conv, state = None, None

        def finish():
            if state["rest"]:
                raise ValueError(f"conversation {conv}: the formatted text ends inside a turn")
            return {"conv_id": conv, "n_turns": state["turns"], "turns_sha256": state["all"].hexdigest(), "loss_chars": state["chars"],
                    "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["size"]}

        for row in _rows(batches):
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    yield finish()
                conv = row["conv_id"]
                state = {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "rest": ""}
            formatted = row["rendered"]
            state["size"] += len(formatted)
            if row["loss_start"] is not None:
                learned = unescape_text(formatted[row["loss_start"]: row["loss_start"] + row["loss_length"]])
                state["chars"] += len(learned)
                state["loss"].update(learned.encode())
            # turns are found by the template's marks alone
            text, at = state["rest"] + formatted, 0
            while found := _TURN.match(text, at):
                state["turns"] += 1
                state["all"].update(f"{unescape_role(found[1])}\n{unescape_text(found[2])}\n".encode())
                at = found.end()
            state["rest"] = text[at:]
        if state is not None:
            yield finish()

    yield from _batches(digests(), schema)


def conversation_digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered turns in their order."""
    rows = rendered.select("conv_id", "turn", "seq", "nth", "rendered", "loss_start", "loss_length")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nth", "seq")
    return ordered.mapInArrow(_read_back, _DIGEST)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -1, which says control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    events = rows.unionByName(planted).withColumns({"seq": F.col("turn"), "kind": F.lit("message")})
    return conversation_digests(render(fold_events(events)))


QUERIES = {"op10_chat_format": op10_chat_format}
_SQL_ESCAPE = _ESCAPE.replace("'", "''")
SQL = {"op10_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, regexp_replace(text, '{_SQL_ESCAPE}', '\1\2\\\3', 'g') AS body,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{_SQL_ESCAPE}', '\1\2\\\3', 'g') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + {len(OPEN) + len(CLOSE) + 2}) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""}
