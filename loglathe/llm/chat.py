r"""Chat formatting: turn-aligned windows under a token budget, with a loss mask over each assistant turn once.

Template: every turn becomes ``### <role>: <text></turn>\n``. Inside roles and texts the characters ``\``, ``<`` and
``#`` are escaped with a backslash (in roles ``:`` too), so no text can forge a mark, and unescaping is exact.

Windows: prefix sums of the turns' token counts choose maximal spans of new turns that fit the budget together with
the conversation's leading system turn (kept in every window) and at most ``history`` earlier turns (repeated as
context). A turn's count is that of its formatted, escaped text; a window's is their sum, which is that of the whole window, as no token of the
vocabulary's splitting spans two turns. Loss covers assistant texts among the *new* turns only; repeated ones are masked. Turns are
not split: one that exceeds the budget, alone or with the system turn, gets a window that exceeds it too.

Edge cases: null text or role counts as empty; ties of ``turn`` are ordered by role and text; repeated rows are turns
of their own; null ``conv_id`` is a conversation; an empty table gives an empty result; extra columns are ignored.
Conversations are streamed in sorted order; one conversation is held at a time only as its windows need it: the last
``history`` turns, the system turn and the turns of the window being built.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_parts, id_whole
from .tokens import Encoder

_ESCAPE = re.compile(r"[\\<#]")
_ESCAPE_ROLE = re.compile(r"[\\<#:]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.DOTALL)

WINDOWS = "conv_id long, no_id boolean, window int, formatted string, loss array<struct<start:int,end:int>>, fresh array<boolean>, n_tokens int"
DIGESTS = "conv_id long, no_id boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str, pattern: re.Pattern = _ESCAPE) -> str:
    return pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text lies in it."""
    head, body = f"### {escape(role, _ESCAPE_ROLE)}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


class _Windows:
    """The windows of one conversation, built turn by turn."""

    def __init__(self, conv: tuple, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.past: list[tuple] = []  # the last turns already trained on
        self.new: list[tuple] = []
        self.new_cost = 0
        self.number = 0
        self.turns = 0

    def _context(self) -> list[tuple]:
        """The system turn, and as much of the recent history as leaves the new turns' room."""
        room = self.budget - self.new_cost - (self.system[2] if self.system else 0)
        kept: list[tuple] = []
        for t in reversed(self.past[-self.history :] if self.history else []):
            room -= t[2]
            if room < 0:
                break
            kept.append(t)
        return ([self.system] if self.system and self.number else []) + kept[::-1]

    def _close(self) -> tuple:
        text, loss, fresh, at, cost = [], [], [], 0, 0
        for turns, is_new in ((self._context(), False), (self.new, True)):
            for role, body, tokens in turns:
                s, a, b = format_turn(role, body)
                if is_new and role == "assistant":
                    loss.append({"start": at + a, "end": at + b})
                text.append(s)
                fresh.append(is_new)
                at += len(s)
                cost += tokens
        out = (*self.conv, self.number, "".join(text), loss, fresh, cost)
        self.past = [*self.past, *(t for t in self.new if t is not self.system)][-self.history :] if self.history else []
        self.new, self.new_cost = [], 0
        self.number += 1
        return out

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        fixed = self.system[2] if self.system and self.number else 0
        if self.new and fixed + self.new_cost + tokens > self.budget:
            yield self._close()
        if not self.turns and role == "system":
            self.system = turn
        self.turns += 1
        self.new.append(turn)
        self.new_cost += tokens

    def end(self) -> Iterator[tuple]:
        if self.new:
            yield self._close()


def format_conversations(rows: DataFrame, budget: int = 512, history: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Windows of every conversation: :data:`WINDOWS` without ``no_id``, a conversation's windows in order in one partition.

    Token counts come from the BPE vocabulary at ``vocabulary`` (default: the 50k byte-level one).
    """
    windows = _formatted(rows, budget, history, vocabulary)
    return windows.select(id_whole("conv_id"), *(c for c in windows.columns if c not in ("conv_id", "no_id")))


def _formatted(rows: DataFrame, budget: int, history: int, vocabulary: str | None) -> DataFrame:
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, state = Encoder(vocabulary), None
        out: list[tuple] = []
        for pdf in batches:
            for conv, no, role, text in zip(pdf["conv_id"], pdf["no_id"], pdf["role"], pdf["text"], strict=True):
                if state is None or state.conv != (conv, no):
                    out += state.end() if state else ()
                    state = _Windows((conv, no), budget, history)
                out += state.add(role, text, len(encoder.encode(format_turn(role, text)[0])))
                if len(out) >= 1024:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state:
            yield pd.DataFrame(list(state.end()), columns=names)

    clean = rows.select(*id_parts("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id", "no_id").sortWithinPartitions("conv_id", "no_id", "turn", "role", "text")
    return dealt.select("conv_id", "no_id", "role", "text").mapInPandas(build, WINDOWS)


class _Digest:
    def __init__(self, conv: tuple) -> None:
        self.conv, self.turns, self.loss, self.chars, self.windows = conv, 0, 0, 0, 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, loss: list, fresh: list) -> None:
        for is_new, m in zip(fresh, _TURN.finditer(text), strict=True):
            if is_new:
                self.turns += 1
                self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        for span in loss:
            target = unescape(text[span["start"] : span["end"]])
            self.loss += len(target)
            self.under.update(target.encode())
        self.chars += len(text)
        self.windows += 1

    def row(self) -> tuple:
        return (*self.conv, self.turns, self.all.hexdigest(), self.loss, self.under.hexdigest(), self.chars, self.windows)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from nothing but the windows' text, spans and flags: :data:`DIGESTS` without ``no_id``.

    ``windows`` must come from :func:`format_conversations` or be sorted by (conv_id, window) within partitions
    that hold whole conversations.
    """
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out = None, []
        for pdf in batches:
            for conv, no, text, loss, fresh in zip(pdf["conv_id"], pdf["no_id"], pdf["formatted"], pdf["loss"], pdf["fresh"], strict=True):
                if state is None or state.conv != (conv, no):
                    if state:
                        out.append(state.row())
                    state = _Digest((conv, no))
                state.read(text, loss, fresh)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state:
            yield pd.DataFrame([state.row()], columns=names)

    digests = windows.select(*id_parts("conv_id"), "formatted", "loss", "fresh").mapInPandas(read, DIGESTS)
    return digests.select(id_whole("conv_id"), *(c for c in digests.columns if c not in ("conv_id", "no_id")))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    from .common import table

    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(extra)))
