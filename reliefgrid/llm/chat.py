"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. The turns of a conversation are
rendered prefix by prefix; what a turn adds to the output is its span. If a longer prefix does not
begin with the shorter one's output, the template rewrites history, and the turn is marked.

Every turn is rendered on its full prefix, whatever the length of the conversation, because a black box may
rewrite any of it; between turns only the messages and the previous output are held. A conversation therefore is one task
and costs the square of its length.

Results: rows are ordered by turn, then role and text; null roles and texts count as empty; a null
conversation id is a conversation of its own, a null turn comes first; repeated rows are turns of their
own; an empty table gives an empty one; other columns are not looked at. A marked turn has the rest of
its prefix's output behind the common part as its piece; nothing is dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "\n": "\\n", "\r": "\\r"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}


def escape(text: str, role: bool = False) -> str:
    """Reversible; leaves no ``<`` or ``>``, so no control string can stand inside a text."""
    chars = r"[\\<>\n\r]" if role else r"[\\<>]"
    return re.sub(chars, lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def turn_template(messages: list[tuple[str, str]]) -> str:
    """Each turn as ``<turn ROLE>``, a line break, the text and ``</turn>``."""
    return "".join(f"<turn {escape(role, True)}>\n{escape(text)}</turn>\n" for role, text in messages)


_TURN = re.compile(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n")


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the text) of each turn of :func:`turn_template`'s output."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}: {formatted[at : at + 60]!r}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


class Increments:
    """Feeds turns to a template and returns (piece, stable) for each, always on the full prefix."""

    def __init__(self, template: Template):
        self.template, self.held, self.before = template, [], ""

    def add(self, message: tuple[str, str]) -> tuple[str, bool]:
        self.held.append(message)
        after = self.template(self.held)
        stable = after.startswith(self.before)
        same = len(self.before)
        if not stable:
            same = next((i for i, (a, b) in enumerate(zip(self.before, after)) if a != b), min(len(self.before), len(after)))
        self.before = after
        return after[same:], stable


def format_turns(turns: DataFrame, template: Template = turn_template, assistant: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``turn_no`` (from 0), ``role``, ``piece``, ``start`` (its place in the output), ``loss``, ``stable``.

    The pieces of a conversation, in order, are its formatted text; ``loss`` marks assistant turns. The
    rows of a partition are sorted by conversation and number.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "_text")

    def run(frames):
        conv, state, number, at = object(), None, 0, 0
        for pdf in frames:
            out = []
            for c, role, text in zip(pdf["conv_id"].astype("Int64"), pdf["role"], pdf["_text"]):
                c = None if pd.isna(c) else int(c)
                if c != conv:
                    conv, state, number, at = c, Increments(template), 0, 0
                piece, stable = state.add((role, text))
                out.append((c, number, role, piece, at, role == assistant, stable))
                number, at = number + 1, at + len(piece)
            pdf = pd.DataFrame(out, columns=["conv_id", "turn_no", "role", "piece", "start", "loss", "stable"])
            yield pdf.astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, "conv_id bigint, turn_no bigint, role string, piece string, start bigint, loss boolean, stable boolean")


def digests(formatted: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row per conversation, read back from the pieces of :func:`format_turns` in their partitions."""

    def run(frames):
        conv, have = None, False

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "stable": True}

        def row(c, s):
            return (c, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["stable"])

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "stable"]
        s = fresh()
        for pdf in frames:
            out = []
            for c, piece, stable in zip(pdf["conv_id"].astype("Int64"), pdf["piece"], pdf["stable"]):
                c = None if pd.isna(c) else int(c)
                if not have or c != conv:
                    if have:
                        out.append(row(conv, s))
                    conv, have, s = c, True, fresh()
                for role, text, _, _ in read_turns(piece):
                    s["n"] += 1
                    s["turns"].update(f"{role}\n{text}\n".encode())
                    if role == assistant:
                        s["loss"].update(text.encode())
                        s["loss_chars"] += len(text)
                s["chars"] += len(piece)
                s["stable"] = s["stable"] and bool(stable)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if have:
            yield pd.DataFrame([row(conv, s)], columns=names).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, stable boolean")
