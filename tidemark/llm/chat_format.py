r"""Chat formatting with a grammar round trip.

    conversation = { turn }
    turn         = head role ": " body "</turn>\n"
    head         = "### " (body as it stands) | "###! " (body and role escaped)

In an escaped part a backslash gives the next character as itself. Rendering starts with all turns
as they stand, parses the result with the deterministic parser, and escapes the turns that did not
come back identical, until all do. The loss mask is the spans of the assistant's bodies.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"[\\#:]|<(?=/turn>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"###(!?) ")
END = "</turn>\n"
_RAW_ROLE, _ESCAPED_ROLE = re.compile(r"[^:#]*"), re.compile(r"(?:[^\\:#]|\\.)*+", re.S)
_ESCAPED_BODY = re.compile(r"(?:[^\\#<]|\\.|<(?!/turn>))*+", re.S)
_RAW_BODY = re.compile(r"(?:[^#<]|#(?!##)|<(?!/turn>))*+", re.S)


def escape(s: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn. Stops where the grammar does: what follows is one turn without a role."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        role = (_ESCAPED_ROLE if head[1] else _RAW_ROLE).match(text, head.end()) if head else None
        if role and text.startswith(": ", role.end()):
            body = (_ESCAPED_BODY if head[1] else _RAW_BODY).match(text, role.end() + 2)
            if text.startswith(END, body.end()):
                back = unescape if head[1] else str
                turns.append((back(role[0]), back(body[0]), body.start(), body.end()))
                at = body.end() + len(END)
                continue
        return [*turns, ("", text[at:], at, len(text))]
    return turns


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The formatted conversation and its parse, which equals ``turns``."""
    escaped = [False] * len(turns)
    while True:
        parts = [f"###! {escape(r)}: {escape(t)}{END}" if e else f"### {r}: {t}{END}" for (r, t), e in zip(turns, escaped, strict=True)]
        text = "".join(parts)
        back = parse(text)
        if [x[:2] for x in back] == turns:
            return text, back
        at = 0
        for i, (part, turn) in enumerate(zip(parts, turns, strict=True)):
            if [x[:2] for x in parse(part)] != [turn]:
                if escaped[i]:
                    raise AssertionError("an escaped turn does not come back")
                escaped[i] = True
                at += 1
        if not at:  # each turn comes back alone: only their joints can be at fault
            escaped = [True] * len(turns)


OUT = "conv_id long, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>"


def _formatted(loss_role: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, starts, ends = [], [], [], []
            for turns in b.column(1).to_pylist():
                text, back = render([(t["role"] or "", t["text"] or "") for t in turns])
                texts.append(text)
                counts.append(len(back))
                mask = [x[2:] for x in back if x[0] == loss_role]
                starts.append([a for a, _ in mask])
                ends.append([z for _, z in mask])
            spans = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(starts, spans), pa.array(ends, spans)], [x.split()[0] for x in OUT.split(", ")])

    return run


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, and the spans of formatted under the loss mask.

    Turns are ordered by turn, role and text (null turns first); repeated rows are turns of their own. Null roles and
    texts count as empty. Rows with a null conv_id are conversations of one turn each. An empty table gives an empty result.
    A conversation is one document and is held whole, in one task; conversations are many. Only the columns conv_id, turn,
    role and text are read.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    known = t.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = t.filter("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    return known.unionByName(alone).mapInArrow(_formatted(loss_role), OUT)
