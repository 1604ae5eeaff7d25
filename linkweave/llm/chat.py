r"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all preceding turns as context
and that reply as the only trainable text.  Turns after the last reply (or of a
conversation without one) make a last example with nothing trainable, so the
examples hold every turn.

The template writes a turn as ``### role: text</turn>`` and a line break.  Inside
roles and texts ``\``, ``#``, ``<`` and ``:`` (in roles) are written ``\\``,
``\h``, ``\l`` and ``\c``, so no text can hold a control string, and all of it can
be read back.

Turns arrive sorted by (conversation, turn) and are consumed as a stream: the
state is one conversation's formatted prefix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

TURN, MIDDLE, END = "### ", ": ", "</turn>\n"
#: Characters of examples a batch holds before it is sent.
BATCH_CHARS = 8_000_000
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")
    return text.replace(":", "\\c") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an example."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(TURN) :].partition(MIDDLE)
        out.append((unescape(role), unescape(text)))
    return out


def _sorted_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    place = F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))  # turns without a conversation needn't meet
    return rows.repartition(place).sortWithinPartitions("conv_id", "turn", "role", "text")


_EXAMPLE = ["conv_id", "example", "formatted", "loss_start", "loss_end"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _EXAMPLE)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of turns in order; a batch is sent when its texts reach ``BATCH_CHARS``."""
    rows: list[tuple] = []
    held, last, prefix, example, open_turns = 0, None, [], 0, 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if conv is None or conv != last:
                if open_turns:
                    rows.append((last, example, "".join(prefix), 0, 0))
                    held += len(rows[-1][2])
                last, prefix, example, open_turns = conv, [], 0, 0
            head, body = f"{TURN}{escape(role, True)}{MIDDLE}", escape(text)
            prefix.append(f"{head}{body}{END}")
            open_turns += 1
            if role == "assistant":
                whole = "".join(prefix)
                end = len(whole) - len(END)
                rows.append((conv, example, whole, end - len(body), end))
                held += len(whole)
                prefix, example, open_turns = [whole], example + 1, 0
            if held > BATCH_CHARS:
                yield _batch(rows)
                rows, held = [], 0
    if open_turns:
        rows.append((last, example, "".join(prefix), 0, 0))
    if rows:
        yield _batch(rows)


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Examples (conv_id, example, formatted, loss_start, loss_end).

    ``loss_start`` and ``loss_end`` are code points of ``formatted`` around the
    trainable reply, equal if there is none.  Null texts and roles are empty; a turn
    with a null conversation is a conversation of its own; null turns come first; rows
    with equal turns are ordered by role and text.  Other columns are not read.

    A conversation is formatted in one task, as a stream; its examples are as long as
    their contexts, so they grow with the square of its length, and one of 2 GB is more
    than a string of Spark holds.
    """
    return _sorted_turns(turns, conv_col, turn_col, role_col, text_col).mapInArrow(B.lean(_expand), "conv_id long, example int, formatted string, loss_start long, loss_end long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest row per conversation, from its examples in order."""
    out: list[tuple] = []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    last, started, n, chars, size, before = None, False, 0, 0, 0, ""
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def done() -> tuple:
        return (last, n, turns.hexdigest(), chars, loss.hexdigest(), size)

    for batch in batches:
        for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
            if not started or conv is None or conv != last:
                if started:
                    out.append(done())
                last, started, n, chars, size, before = conv, True, 0, 0, 0, ""
                turns, loss = hashlib.sha256(), hashlib.sha256()
            if not text.startswith(before):  # what has been read is read again, as context
                raise ValueError(f"an example of conversation {conv} has another context than the turns before it")
            new = parse(text[len(before) :])
            for role, said in new:
                turns.update(f"{role}\n{said}\n".encode())
            n, before = n + len(new), text
            reply = unescape(text[start:end])
            if start and new[-1:] != [("assistant", reply)]:
                raise ValueError(f"an example of conversation {conv} doesn't end with the reply under its mask")
            loss.update(reply.encode())
            chars += len(reply)
            size += len(text)
        if len(out) > 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
            out = []
    if started:
        out.append(done())
    if out:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation's turns and trainable text, read from ``expand``'s rows in the order it gives them.

    Every example is read whole: its context must be what the examples before it said,
    and its mask must hold its last turn, an assistant's; else it raises ValueError.
    """
    return examples.mapInArrow(B.lean(_read_back), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
