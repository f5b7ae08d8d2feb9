"""Chat formatting (operator 8) by columnar byte assembly.

Rows of a conversation lie together and in order (one shuffle by conv_id, a sort within partitions).
For each batch of whole conversations the lengths of all segments, their cumulative offsets and the
scatter indices are computed in numpy, and headers and contents are copied into one preallocated
buffer, which becomes the Arrow column of formatted texts.

The template is OPEN role LF text CLOSE for each turn. Inside roles and texts each control string
(those of this template and of common others) gets a ! after its first character, also where ! stand
there already, so no text can close or open a turn, and taking one ! away gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,length:long>>"
_CONTROLS = (("<!*", r"\||/?s>"), (r"\[!*", r"/?INST\]"))


def escape(texts: pa.Array) -> pa.Array:
    for head, tail in _CONTROLS:
        texts = pc.replace_substring_regex(texts, f"({head})({tail})", r"\1!\2")
    return texts


def unescape(text: str) -> str:
    for head, tail in _CONTROLS:
        text = re.sub(f"({head})!({tail})", r"\1\2", text)
    return text


def escape_role(roles: pa.Array) -> pa.Array:
    """Roles end at the first line feed, so theirs are written as backslash and n."""
    roles = pc.replace_substring(roles, "\\", "\\\\")
    return escape(pc.replace_substring(roles, "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets into them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def assemble(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The rows' segments one after the other, of large_string columns or one constant: bytes, and each row's end."""
    parts = [_bytes(c) for c in columns]
    lengths = np.stack([np.diff(offsets) for _, offsets in parts], axis=1)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (raw, offsets) in enumerate(parts):
        n = lengths[:, k]
        total = int(n.sum())
        before = np.cumsum(n) - n
        within = np.arange(total) - np.repeat(before, n)
        out[np.repeat(starts[:, k], n) + within] = raw[offsets[0] : offsets[0] + total]
    return out, ends.reshape(lengths.shape)[:, -1] if len(ends) else np.zeros(0, np.int64)


def _format(rows: pa.Table, loss_role: str) -> pa.RecordBatch:
    """Rows of whole conversations, sorted."""
    conv = rows.column("conv_id").combine_chunks()
    conv = conv.chunk(0) if isinstance(conv, pa.ChunkedArray) else conv
    keys = conv.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    last = np.append(first[1:], len(keys)) - 1

    def text(name: str) -> pa.Array:
        got = pc.fill_null(rows.column(name).cast(pa.large_string()), "").combine_chunks()
        return got.chunk(0) if isinstance(got, pa.ChunkedArray) else got

    roles = text("role")
    spoken = pc.equal(roles, loss_role).to_numpy(zero_copy_only=False)
    contents = escape(text("text"))
    header = pc.binary_join_element_wise(pa.scalar(OPEN, pa.large_string()), escape_role(roles), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    footer = pa.array([CLOSE] * len(rows), pa.large_string())
    data, ends = assemble([header, contents, footer])
    offsets = np.concatenate([[0], ends[last]])
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    # the loss mask in code points: where each turn's content begins in its conversation, and its length
    head, body = (pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (header, contents))
    turn = head + body + len(CLOSE)
    before = np.cumsum(turn) - turn
    owner = np.repeat(np.arange(len(first)), last - first + 1)
    start = before - before[first][owner] + head
    masked = np.flatnonzero(spoken)
    spans = pa.StructArray.from_arrays([pa.array(start[masked]), pa.array(body[masked])], names=["start", "length"])
    counts = np.bincount(owner[masked], minlength=len(first))
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array((last - first + 1).astype(np.int64)), formatted.cast(pa.string()) if len(data) < 1 << 31 else formatted, spans], names=["conv_id", "n_turns", "formatted", "loss_spans"])


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conversations (conv_id, turn, role, text) to conv_id, n_turns, formatted, loss_spans: a row for each conversation.

    Turns are ordered by turn (nulls first), then role and text, so ties and repeated rows all stay and have one order.
    Null roles and texts count as empty. Rows without conv_id form one conversation without id. loss_spans: start and
    length, in code points of formatted, of each text of loss_role. Other columns are ignored; no rows give no rows.
    """

    def run(batches):
        kept: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ids = table.column("conv_id").to_pylist()
            if kept and ids[0] == ids[-1] == kept[0].column("conv_id")[0].as_py():
                kept.append(table)
                continue
            cut = len(ids)  # the last conversation may go on in the next batch
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if kept or cut:
                whole = pa.concat_tables([*kept, table.slice(0, cut)])
                if kept and cut == 0 and kept[0].column("conv_id")[0].as_py() == ids[-1]:
                    kept.append(table)
                    continue
                yield _format(whole, loss_role)
            kept = [table.slice(cut)]
        if kept:
            yield _format(pa.concat_tables(kept), loss_role)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, FORMATTED)


def read_back(formatted: str, spans: list) -> tuple[list[tuple[str, str]], str]:
    """The turns (role, text) of a formatted conversation, and the text under its loss mask."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest.removesuffix(CLOSE))))
    loss = "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in spans)
    return turns, loss


def digests(formatted: DataFrame) -> DataFrame:
    """What format_conversations wrote, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns, loss = read_back(text, spans)
                said = hashlib.sha256("".join(f"{role}\n{words}\n" for role, words in turns).encode()).hexdigest()
                rows.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
