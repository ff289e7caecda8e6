"""Chat formatting with offset-aligned masks.

A whole conversation is rendered by the template and encoded once, with the offset of every token. The spans of assistant
texts are sorted, so the tokens that touch each span are found by binary search on the offsets. A token that also holds
characters of a mark is cut at the span: the loss mask is kept in characters as well as in tokens.

Template: each turn is <|role|>NEWLINE text <|end|> NEWLINE. Inside texts a backslash becomes two and "<|" becomes "<\\|"; inside
roles each "|" gets the backslash. So no text can hold a mark, and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import byte_level_offsets

LEARNT = "assistant"
_ESCAPED = re.compile(r"\\(\\|\|)")
_TURN = re.compile(r"<\|((?:[^\\|]|\\.)*)\|>\n((?:[^\\<]|\\.|<(?!\|))*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("|", "\\|")


def render(turns: list[tuple[str, str]], learnt: str = LEARNT) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of the learnt role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{_escape_role(role)}|>\n", escape(text)
        parts += [head, body, "<|end|>\n"]
        if role == learnt:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len("<|end|>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For sorted token offsets (rows of start, end) and sorted spans: 0 or 1 for each token, and the pieces of the spans that
    tokens cover. The tokens that touch a span are found by binary search."""
    offsets = np.asarray(offsets, np.int64).reshape(-1, 2)
    mask, pieces = np.zeros(len(offsets), np.int8), []
    for lo, hi in spans:
        a, b = np.searchsorted(offsets[:, 1], lo, "right"), np.searchsorted(offsets[:, 0], hi, "left")
        if lo == hi or a >= b:
            continue
        mask[a:b] = 1
        # several tokens may stand for the bytes of one character and have the same offsets
        start, reach = np.maximum(offsets[a:b, 0], lo), np.maximum.accumulate(np.minimum(offsets[a:b, 1], hi))
        breaks = np.flatnonzero(start[1:] > reach[:-1])
        pieces += zip(start[np.append(0, breaks + 1)].tolist(), reach[np.append(breaks, b - a - 1)].tolist())
    return mask, pieces


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else [], kind))


FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, mask array<tinyint>, spans array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _whole(turns: DataFrame) -> DataFrame:
    """conv_id and its turns, in order."""
    small_batches(turns.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))


def _format(path: str, learnt: str):
    def run(batches):
        encode = byte_level_offsets(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rendered = [render([(t["role"], t["text"]) for t in own], learnt) for own in part.column(1).to_pylist()]
                encoded = [encode(r[0]) for r in rendered]
                masks = [masked_tokens(offsets, spans) for (_, offsets), (_, spans) in zip(encoded, rendered)]
                columns = [
                    part.column(0),
                    pc.list_value_length(part.column(1)).cast(pa.int64()),
                    pa.array([r[0] for r in rendered], pa.string()),
                    _lists([ids for ids, _ in encoded], pa.int32()),
                    _lists([m for m, _ in masks], pa.int8()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s in masks], _SPANS),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "ids", "mask", "spans"])

    return run


def _digest(batches):
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        rows: list[tuple] = []
        sizes = pc.list_value_length(batch.column(3)).to_pylist()
        learnt = [int(m.values.to_numpy(zero_copy_only=False).sum()) for m in batch.column(4)]
        for conv_id, text, spans, size, masked in zip(*(batch.column(k).to_pylist() for k in (0, 2, 5)), sizes, learnt):
            turns = parse(text)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            loss = unescape("".join(text[s["start"] : s["end"]] for s in spans))
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
            rows.append((conv_id, len(turns), digest[0], len(loss), digest[1], len(text), size, masked))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names)


def formatted_conversations(turns: DataFrame, path: str, learnt: str = LEARNT) -> DataFrame:
    """conv_id, n_turns, formatted, ids, mask (of the ids), spans (of the learnt text in formatted): a row for each conversation.

    turns: conv_id, turn, role, text; other columns are ignored. A null role or text counts as empty. Turns go by turn, then
    role, then text; rows that repeat are turns of their own. Rows without conv_id form one conversation with a null id. An
    empty table gives an empty result. A conversation is one unit of training text and is held in memory whole.
    """
    return _whole(turns).mapInArrow(_format(path, learnt), FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens, read back from the rows of
    formatted_conversations(); a row for each. An empty table gives an empty result."""
    return formatted.select("conv_id", "n_turns", "formatted", "ids", "mask", "spans").mapInArrow(_digest, DIGESTS)


def conversation_digests(turns: DataFrame, path: str, learnt: str = LEARNT) -> DataFrame:
    """digests(formatted_conversations(turns)), for rows and edge cases as there, without sending the texts back to the JVM between
    the two."""
    run = _format(path, learnt)
    return _whole(turns).mapInArrow(lambda batches: _digest(run(batches)), DIGESTS)
