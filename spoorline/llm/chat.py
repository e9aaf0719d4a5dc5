"""Chat formatting with a grammar round trip.

Every turn becomes ``open body close``: the role chooses the pair of marks. The formatted turn
is parsed again by a deterministic parser; if the recovered role and text differ from the
source, the body's control strings are escaped and the turn is rendered again, until they are
identical. Escaping puts one more word joiner (U+2060) behind the first character of a
control string, so it can be undone whatever the text held before.

    [INST] body [/INST]        user
    <s> body </s>              assistant; its body is under the loss mask
    <<SYS>> body <</SYS>>      system
    <<ROLE:name>> body <</ROLE>>   any other role, the name percent-encoded

Null text and null role count as empty. Turns come in the order of (turn, role, text), nulls
first, so ties and repeated rows have a fixed place; rows with a null conversation id form one
conversation. A conversation may have any length: its turns stream through a sorted partition
and only one turn is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.common import SLICE, slices

JOINER = "⁠"
MARKS = {
    "user": ("[INST] ", " [/INST]\n"),
    "assistant": ("<s> ", " </s>\n"),
    "system": ("<<SYS>> ", " <</SYS>>\n"),
}
_CONTROL = r"([\[<])({})(/?INST\]|/?s>|</?SYS>>|<ROLE:|</ROLE>>)"
_PLAIN = re.compile(_CONTROL.format(""))
_ANY = re.compile(_CONTROL.format(JOINER + "*"))
_ESCAPED = re.compile(_CONTROL.format(JOINER + "+"))
_OPEN = re.compile(r"\[INST\] |<s> |<<SYS>> |<<ROLE:([^<>\s]*)>> ")


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[1] + m[2] + JOINER + m[3], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def marks_of(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"<<ROLE:{quote(role, safe='')}>> ", " <</ROLE>>\n")


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """Role, text, where the body starts and ends, where the turn ends; None outside the grammar."""
    opened = _OPEN.match(text, at)
    if not opened:
        return None
    role = next((r for r, (o, _) in MARKS.items() if o == opened[0]), None)
    role = unquote(opened[1] or "") if role is None else role
    close = marks_of(role)[1]
    end = text.find(close, opened.end())
    if end < 0 or _PLAIN.search(text, opened.end(), end):
        return None
    return role, unescape(text[opened.end() : end]), opened.end(), end, end + len(close)


def render_turn(role: str, text: str) -> str:
    """The formatted turn, escaped as often as the round trip asks for."""
    start, close = marks_of(role)
    body = text
    for _ in range(2):
        out = start + body + close
        back = parse_turn(out)
        if back and back[:2] == (role, text) and back[4] == len(out):
            return out
        body = escape(text)
    raise ValueError("a turn does not survive the round trip")


def _stream(df: DataFrame, step, schema: str) -> DataFrame:
    """Run a generator over the rows of each partition, in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)
    names = arrow.names

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, SLICE):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in step(rows(batches)):
            held.append(row)
            if len(held) == SLICE:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names, r, strict=True)) for r in held], schema=arrow
                )
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(names, r, strict=True)) for r in held], schema=arrow
            )

    return df.mapInArrow(task, target)


def _format(rows):
    number, previous = 0, ()
    for conv, role, text in rows:
        number = number + 1 if (conv,) == previous else 0
        previous = (conv,)
        role = role or ""
        out = render_turn(role, text or "")
        _, _, start, end, _ = parse_turn(out)
        yield conv, number, out, *((start, end) if role == "assistant" else (None, None))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn in order: conv_id, seq (from 0), formatted, mask_start, mask_end.

    The mask holds the code points of the formatted turn that count for the loss. A
    conversation's formatted text is the concatenation of its turns.
    """
    ordered = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    schema = "conv_id bigint, seq bigint, formatted string, mask_start bigint, mask_end bigint"
    return _stream(ordered, _format, schema)


def _digests(rows):
    previous, n = None, 0
    for conv, number, formatted, start, end in rows:
        if (conv,) != previous:
            if previous is not None:
                yield previous[0], n, whole.hexdigest(), chars, loss.hexdigest(), length
            previous, n, chars, length = (conv,), 0, 0, 0
            whole, loss = hashlib.sha256(), hashlib.sha256()
        if number != n:
            raise ValueError("the turns of a conversation have to follow each other")
        parsed = parse_turn(formatted)
        if parsed is None or parsed[4] != len(formatted):
            raise ValueError("formatted text is outside the grammar")
        whole.update(f"{parsed[0]}\n{parsed[1]}\n".encode())
        if start is not None:
            masked = unescape(formatted[start:end])
            chars += len(masked)
            loss.update(masked.encode())
        n, length = n + 1, length + len(formatted)
    if previous is not None:
        yield previous[0], n, whole.hexdigest(), chars, loss.hexdigest(), length


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of what the parser recovers from `format_turns`, per conversation.

    ``in_order`` takes the rows as `format_turns` deals and sorts them, within one plan, and saves
    the shuffle. Stored turns come in any order. A missing turn is an error either way.
    """
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint"
    )
    return _stream(formatted, _digests, schema)


def with_conflict(turns: DataFrame) -> DataFrame:
    """Adds conversation -7, whose two texts hold the template's own control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
