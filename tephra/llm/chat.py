"""Chat formatting by columnar byte assembly.

Turns of a conversation become ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Control strings inside roles and texts are escaped
reversibly: every ``<|`` becomes ``<\\|`` and every ``<\\`` becomes ``<\\\\``, so that no ``<|`` but the template's is left; a line end in a role becomes ``<\\n``. For a
batch of turns the lengths of all segments (header, role, separator, text, tail) are computed in numpy, their cumulative
offsets give each segment its place, and scatter indices copy headers and contents into one preallocated Arrow buffer.

Conversations are sorted by turn inside their partition and stream through; a long one is put out in parts of bounded
size, so that no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.session import bounded_batches

from .common import blocks, ranges, utf8

START, END = "<|im_start|>", "<|im_end|>"
ROLE_END, TURN_END = "\n", END + "\n"
#: The role whose text the loss covers.
LOSS_ROLE = "assistant"
#: Bytes after which a conversation goes on in another part.
PART_BYTES = 1 << 20
#: Bytes of texts that are formatted at a time.
SLICE_BYTES = 64 << 20


def escaped(column: pa.Array) -> pa.Array:
    """Control strings made harmless; null is empty."""
    column = pc.fill_null(column, "")
    return pc.replace_substring(pc.replace_substring(column, "<\\", "<\\\\"), "<|", "<\\|")


def unescaped(text: str) -> str:
    """The inverse of :func:`escaped` for one text."""
    out, at = [], 0
    while (found := text.find("<\\", at)) >= 0:
        out.append(text[at : found + 1])
        # After "<\" stands what has been escaped: "|" or "\", or "n" for a line end alone.
        if text[found + 2 : found + 3] == "n":
            out[-1] = out[-1][:-1] + "\n"
        else:
            out.append(text[found + 2 : found + 3])
        at = found + 3
    out.append(text[at:])
    return "".join(out)


def assembled(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn offsets, text begin, text end) of the formatted turns, scattered into one Arrow buffer of their size."""
    n = len(roles)
    contents = [utf8(pc.replace_substring(escaped(roles), "\n", "<\\n")), utf8(escaped(texts))]
    fixed = [np.frombuffer(x.encode(), np.uint8) for x in (START, ROLE_END, TURN_END)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0::2] = [len(x) for x in fixed]
    lengths[:, 1], lengths[:, 3] = np.diff(contents[0][1]), np.diff(contents[1][1])
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for k, part in zip((0, 2, 4), fixed):
        out[(begins[:, k, None] + np.arange(len(part))).ravel()] = np.tile(part, n)
    for k, (raw, _) in zip((1, 3), contents):
        out[np.repeat(begins[:, k], lengths[:, k]) + ranges(lengths[:, k])] = raw
    return buffer, np.append(0, ends[:, -1]) if n else np.zeros(1, np.int64), begins[:, 3], ends[:, 3]


def _code_points(raw: np.ndarray) -> np.ndarray:
    """Number of code points before each byte."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def _format(part_bytes: int):
    """Sorted (conv_id, turn, role, text) -> conv_id, part, text, loss spans in code points, turns."""

    def run(batches):
        now, part, filled = (object(),), 0, 0
        for batch in batches:
            ids, roles, texts = batch.column(0), batch.column(2), batch.column(3)
            # Slices of so few bytes that offsets of 32 bits hold them also where control strings double them.
            for lo, hi in blocks(utf8(texts)[1], SLICE_BYTES):
                conv = ids.slice(lo, hi - lo).to_pylist()
                role = roles.slice(lo, hi - lo)
                raw, at, begin, end = assembled(role, texts.slice(lo, hi - lo))
                points = _code_points(np.frombuffer(raw, np.uint8))
                loss = pc.fill_null(pc.equal(role, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
                # Parts: rows of one conversation next to each other, cut where the part is full.
                rows, first = [], 0
                while first < len(conv):
                    if (conv[first],) != now:
                        now, part, filled = (conv[first],), 0, 0
                    last = first
                    while last < len(conv) and conv[last] == conv[first] and (last == first or filled < part_bytes):
                        filled += int(at[last + 1] - at[last])
                        last += 1
                    rows.append((conv[first], part, first, last))
                    part, filled, first = part + 1, 0, last
                firsts, lasts = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
                offs = np.append(at[firsts], at[lasts[-1]])
                text = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offs.astype(np.int64).tobytes()), raw)
                spans = [
                    [
                        {"start": int(points[begin[k]] - points[at[a]]), "end": int(points[end[k]] - points[at[a]])}
                        for k in range(a, b) if loss[k]
                    ]
                    for a, b in zip(firsts, lasts)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        text.cast(pa.string()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(lasts - firsts)
                    ],
                    names=["conv_id", "part", "text", "loss", "n_turns"],
                )

    return run


def format_chats(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_bytes: int = PART_BYTES
) -> DataFrame:
    """(conv_id long, part long, text string, loss array<struct<start, end>>, n_turns long): formatted conversations.

    The parts of a conversation, in order, are its formatted text; ``loss`` has the spans, in code points of the part, of the
    escaped assistant texts. Null roles and texts are empty; a null turn comes first and equal turns order by role and text;
    rows of null conv_id are one conversation; repeated rows stay. An empty table gives no rows.
    """
    bounded_batches(turns.sparkSession)
    given = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return given.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _format(part_bytes),
        "conv_id long, part long, text string, loss array<struct<start: long, end: long>>, n_turns long"
    )


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for turn in text.split(START)[1:]:
        role, _, rest = turn.partition(ROLE_END)
        out.append((unescaped(role), unescaped(rest[: rest.rindex(TURN_END)])))
    return out


def _digests(batches):
    """Parts in order -> one row for each conversation, read from the formatted text alone."""
    state: list | None = None

    def row(s):
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def out(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        )

    done: list = []
    for batch in batches:
        for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parsed(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescaped(text[span["start"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if len(done) >= 1024:
            yield out(done)
            done = []
    if state is not None:
        done.append(row(state))
    if done:
        yield out(done)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the parts of :func:`format_chats` alone."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "part")]
    ordered = formatted.select("conv_id", "part", "text", "loss").repartition("conv_id").sortWithinPartitions(*order)
    return ordered.mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
