"""Chat formatting: fold an event log into final messages and render them.

Events are partitioned by conversation, sorted by sequence and folded in one stream:

* ``start`` opens a message (role, first text); ``delta`` appends text to it;
* ``edit`` puts another text in its place; ``delete`` takes it away;
* ``regenerate`` empties it and takes away every message opened after it.

A delta or edit of an unknown message opens it; other kinds are ignored. A task holds the messages
of one conversation at a time, and Spark's sort spills, so a long log of small deltas needs no more
memory than the texts that it ends in.

Rendering: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Control strings in a text get a
backslash after their first character, backslashes are doubled, and in roles the line feed gets a
backslash before it, so :func:`parse` gives back exactly the roles and texts. ``loss`` holds the
spans (code points) of the rendered assistant texts alone.

Defined results: null roles and texts are empty; a null conversation id is a conversation of its
own; events with equal sequence are ordered by kind and text; an empty log gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
CONTROL = [BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))
_TURN = re.compile(re.escape(BEGIN) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(END) + r"\n", re.S)
LEARNED_ROLE = "assistant"
_BATCH_CHARS = 1 << 21


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans that the loss covers."""
    out, at, spans = [], 0, []
    for role, text in messages:
        head = f"{BEGIN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
        body = escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


class _Fold:
    def __init__(self):
        self.messages: dict = {}  # by message id, in the order they were opened

    def event(self, message, kind: str | None, role: str | None, text: str | None) -> None:
        if kind == "regenerate":
            while message in self.messages:  # later messages come off the end, each once in its life
                last, held = self.messages.popitem()
                if last == message:
                    self.messages[last] = [held[0], []]
                    break
        elif kind == "delete":
            self.messages.pop(message, None)
        elif kind in ("start", "delta", "edit"):
            held = self.messages.get(message)
            if held is None or kind == "start":
                self.messages.pop(message, None)
                self.messages[message] = [role or "", [text or ""]]
            elif kind == "delta":
                held[1].append(text or "")
            else:
                held[1] = [text or ""]

    def result(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, fold, rows, size = (), _Fold(), [], 0

    def close() -> int:
        messages = fold.result()
        formatted, spans = render(messages)
        rows.append({"conv_id": now[0], "n_turns": len(messages), "formatted": formatted, "loss": [{"start": a, "end": b} for a, b in spans]})
        return len(formatted)

    for batch in batches:
        for conv, message, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (conv,):
                if now:
                    size += close()
                now, fold = (conv,), _Fold()
                if size > _BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, _OUT)
                    rows.clear()
                    size = 0
            fold.event(message, kind, role, text)
    if now:
        close()
    yield pa.RecordBatch.from_pylist(rows, _OUT)


def format_events(events: DataFrame, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) of each conversation of an event log with the columns
    conv_id (long), seq (of any type with an order), message (long), kind, role, text. ``in_order``:
    each conversation lies in one partition already, its events in order (as ``events_of`` gives them)."""
    own = events.select(F.col("conv_id").cast("long"), F.col("message").cast("long"), "kind", "role", "text", *([] if in_order else ["seq"]))
    if not in_order:
        own = own.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "text")
    return own.select("conv_id", "message", "kind", "role", "text").mapInArrow(_fold_sorted, "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def events_of(turns: DataFrame) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text), partitioned by conversation and in
    order. Each turn is opened and its first half streamed; then an assistant's answer is regenerated
    and streamed as two deltas, any other turn is edited to its text, as logs of live conversations
    have it. Turns that tie are ordered by role and text; repeated rows stay. A text moves once, as a
    turn; its events are made after the sort."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = ordered.withColumn("message", F.monotonically_increasing_id())
    half = F.floor(F.length("text") / 2).cast("int")
    step = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    first, second, none = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.length("text")), F.lit("")
    opened = [step("start", none), step("delta", first)]
    answer = F.array(*opened, step("regenerate", none), step("delta", first), step("delta", second))
    steps = F.when(F.col("role") == "assistant", answer).otherwise(F.array(*opened, step("edit", F.col("text"))))
    return rows.select("conv_id", "message", "role", F.explode(steps).alias("e")).select("conv_id", "message", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            turns = parse(r["formatted"])
            loss = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"])
            out.append((r["conv_id"], len(turns), digest("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), digest(loss), len(r["formatted"])))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the messages and of the text under the loss, parsed from the formatted text."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read_back, _READ)


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(format_events(events_of(turns.unionByName(probe)), in_order=True))


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text,
        '\\|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + n + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
