"""Chat formatting with a grammar round trip.

A turn is rendered as `### Role:`, its text and `</turn>`. Each turn is first rendered as it stands
and parsed again; where the parser doesn't give back the source, the conflicting content is escaped
(one backslash more before each control string) and parsed again. Once is enough: no control string of an
escaped text is bare, so the text ends where it should, and the parser takes one backslash away from each
of them; a text that still differs is an error. Turns are rendered row by row; reading back sorts each
conversation's segments and streams them through the parser, so that no conversation, however long, is
held in memory. The grammar ends a turn by itself, so the turns of a conversation's text are those of its
segments one after the other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, text_or_empty, written

#: The template, fixed values: what opens a turn, what closes it, and the two control strings.
OPEN, CLOSE = "### {}:\n", "\n</turn>\n"
CONTROL = re.compile(r"(?<!\\)(\\*+)(###|</turn>)")
ESCAPED = re.compile(r"(?<!\\)\\(\\*+)(###|</turn>)")
#: Characters of a task that reads back; it streams sorted segments, so none of them is held.
PART_CHARS = 64 * 2**20
HEADER = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n", re.DOTALL)


def role_label(role: str) -> str:
    return re.sub(r"[\\:\n]", lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role[:1].upper() + role[1:] if role in ("user", "assistant", "system", "tool") else "=" + role)


def role_of(label: str) -> str:
    name = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], label)
    return name[1:] if name.startswith("=") else name[:1].lower() + name[1:]


def bare(segment: str, at: int) -> re.Match | None:
    """The next control string that isn't escaped. Read from the left: what follows an escaped one begins anew."""
    return next((m for m in CONTROL.finditer(segment, at) if not m[1]), None)


def parse(segment: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the text stands (start, length). ValueError where the grammar fails."""
    turns, at = [], 0
    while at < len(segment):
        head = HEADER.match(segment, at)
        end = bare(segment, head.end()) if head else None
        if not head or not end or end[2] != "</turn>" or segment[end.start() - 1 : end.end() + 1] != CLOSE or end.start() - 1 < head.end():
            raise ValueError(f"no turn at {at}")
        body = segment[head.end() : end.start() - 1]
        turns.append((role_of(head[1]), ESCAPED.sub(r"\1\2", body), head.end(), len(body)))
        at = end.end() + 1
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """A turn's segment and how often its content was escaped before it parsed to the source."""
    for escapes, body in enumerate((text, CONTROL.sub(r"\\\1\2", text))):
        segment = OPEN.format(role_label(role)) + body + CLOSE
        try:
            if [t[:2] for t in parse(segment)] == [(role, text)]:
                return segment, escapes
        except ValueError:
            pass
    raise ValueError("a turn doesn't survive the round trip")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [render(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        loss = [len(s) - len(CLOSE) - s.index(":\n") - 2 if r == "assistant" else 0 for (s, _), r in zip(done, batch.column("role").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array([s for s, _ in done], pa.string()), pa.array([len(s) - len(CLOSE) - n for (s, _), n in zip(done, loss)], pa.int64()), pa.array(loss, pa.int64()), pa.array([n for _, n in done], pa.int32())],
            names=["conv_id", "turn", "segment", "loss_start", "loss_length", "escapes"],
        )


def format_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_length (of the assistant's text in the segment), escapes.

    A conversation's formatted text is its segments in the order of turn, then segment. Null texts and
    roles are empty, a null turn comes first, rows with a null id are one conversation. Repeated rows stay.
    """
    picked = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    return picked.mapInArrow(_render, "conv_id long, turn long, segment string, loss_start long, loss_length long, escapes int")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("escaped_turns", pa.int64())])
    now: list | None = None  # conversation, turns, digest, loss characters, digest, characters, escaped turns

    def row() -> dict:
        return dict(zip(schema.names, (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6])))

    for batch in batches:
        out = []
        for conv, segment, start, length, escapes in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_length", "escapes"))):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(row())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text, _, _ in parse(segment):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            masked = ESCAPED.sub(r"\1\2", segment[start : start + length])
            now[3] += len(masked)
            now[4].update(masked.encode())
            now[5] += len(segment)
            now[6] += escapes > 0
        yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def read_back(segments: DataFrame) -> DataFrame:
    """A row for each conversation, from its formatted segments alone: counts and digests of turns and of the text under the loss mask."""
    spark = segments.sparkSession
    total = segments.agg(F.sum(F.length("segment"))).first()[0] or 0
    parts = parts_for(int(total), PART_CHARS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return segments.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(_read, READ)


def round_trip(conversations: DataFrame, **columns: str) -> DataFrame:
    """Formats into a table of the shared folder and reads it back."""
    return read_back(written(format_turns(conversations, **columns), "chat"))
