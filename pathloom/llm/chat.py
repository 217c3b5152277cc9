"""Chat formatting in budgeted windows.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  A control string inside a text can't be
mistaken for one: in ``<``, any backslashes, ``|`` one more backslash is inserted, and
reading removes it.  Turns are measured first (in tokens, each turn encoded by itself), spread
evenly.  Then running sums of the turns' tokens choose windows of whole turns: each holds the
system turn (if the conversation begins with one), as many earlier turns as fit in ``history``,
and as many new turns as fit in ``budget``.  Repeated turns are masked, so each assistant text
is a target in exactly one window.

A conversation passes through its task turn by turn, sorted by Spark: only one window and one
history are held at a time, however long it is.

Defined results: null texts and roles are empty; rows of one conversation are ordered by
turn, role and text, and repeated rows stay; a null conv_id is one conversation; a new turn
that alone exceeds the budget has a window without history; other columns of the rows, of any
name, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import bpe
from pathloom.llm.kernel import blocks, lean

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 4096, 1024
WINDOWS = "conv_id long, window long, formatted string, repeated int, turns int, mask array<struct<start:int,end:int>>"
_windows = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("repeated", pa.int32()), ("turns", pa.int32()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
#: Characters of windows that a task hands on at a time.
OUT_CHARS = 1 << 20
_to_escape, _to_restore = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _to_escape.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _to_restore.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape; line ends are escaped too, as one ends the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def formatted(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


class Windows:
    """The windows of one conversation, turn by turn."""

    def __init__(self, budget: int = BUDGET, history: int = HISTORY):
        self.budget, self.history = budget, history
        #: The system turn, and what of it this window repeats.
        self.lead: list[tuple[str, str, int]] = []
        self.system: list[tuple[str, str, int]] = []
        #: Turns that a next window may repeat, and the current window's repeated and new turns: (role, text, size).
        self.recent: deque[tuple[str, str, int]] = deque()
        self.held = 0
        self.back: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.total, self.first = 0, True

    def add(self, role: str, text: str, size: int) -> dict | None:
        """Take a turn; the window that it closes, if it doesn't fit."""
        turn, done = (role, text, size), None
        if self.new and self.total + size > self.budget:
            done = self.close()
            # The latest turns that fit in the history, less those that leave no room for this turn.
            self.back = list(self.recent)
            self.total = sum(t[2] for t in self.system) + self.held
            while self.back and self.total + size > self.budget:
                self.total -= self.back.pop(0)[2]
        self.new.append(turn)
        self.total += size
        if self.first and role == "system":
            self.lead = [turn]
        else:
            self.recent.append(turn)
            self.held += size
            while self.held > self.history:
                self.held -= self.recent.popleft()[2]
        self.first = False
        return done

    def close(self) -> dict:
        """The current window."""
        shown = [*self.system, *self.back, *self.new]
        repeated = len(shown) - len(self.new)
        place, mask, parts = 0, [], []
        for k, (role, text, _) in enumerate(shown):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if k >= repeated and role == "assistant":
                mask.append({"start": place + len(head), "end": place + len(head) + len(body)})
            parts.append(f"{head}{body}{END}\n")
            place += len(parts[-1])
        self.system, self.back, self.new = self.lead, [], []
        return {"formatted": "".join(parts), "repeated": repeated, "turns": len(shown), "mask": mask}


def windows(turns: Iterable[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY, size: Callable[[str], int] = len) -> Iterator[dict]:
    """The windows of one conversation of (role, text) turns; ``size`` measures a formatted turn."""
    own = Windows(budget, history)
    for role, text in turns:
        if (done := own.add(role, text, size(formatted(role, text)))) is not None:
            yield done
    if own.new:
        yield own.close()


def token_sizes(ranks: str) -> Callable[[list[str]], list[int]]:
    """Measures many formatted turns at once by their tokens in the vocabulary file ``ranks``."""

    def run(turns: list[str]) -> list[int]:
        return [len(ids) // 4 for ids, _ in bpe.encode_texts(turns, bpe.merger_for(ranks))]

    return run


def read_window(window: dict) -> tuple[list[tuple[str, str]], list[str]]:
    """The new turns of a window and the texts under its mask, both unescaped."""
    text, at, turns = window["formatted"], 0, []
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn must begin here")
        line = text.index("\n", at)
        stop = text.index(END, line)
        turns.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns[window["repeated"] :], [unescape(text[m["start"] : m["end"]]) for m in window["mask"]]


def measured(rows: DataFrame, sizes: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """(conv_id, turn, role, text, size) of conversation rows; ``sizes`` measures formatted turns, None in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in batches:
                for a, b, _, _ in blocks(whole.column(3)):
                    batch = whole.slice(a, b - a)
                    turns = [formatted(*t) for t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                    size = list(map(len, turns)) if sizes is None else sizes(turns)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64())], names=["conv_id", "turn", "role", "text", "size"])
        finally:
            bpe.forget()

    texts = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts)
    return plain.mapInArrow(lean(run), "conv_id long, turn long, role string, text string, size long")


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, sizes: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """A row of WINDOWS for each window of conversation rows (conv_id, turn, role, text); ``sizes`` measures formatted turns, None in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, own, out, chars = (), 0, None, [], 0

        def made(window: dict) -> None:
            nonlocal number, chars
            out.append({"conv_id": now[0], "window": number, **window})
            number += 1
            chars += len(window["formatted"])

        for batch in batches:
            for conv, role, text, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if now != (conv,):
                    if own is not None:
                        made(own.close())
                    now, number, own = (conv,), 0, Windows(budget, history)
                if (done := own.add(role, text, size)) is not None:
                    made(done)
                if chars >= OUT_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=_windows)
                    out, chars = [], 0
        if own is not None:
            made(own.close())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_windows)

    ordered = measured(rows, sizes).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lean(run), WINDOWS)


def read_back(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from windows (rows of WINDOWS)."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = (), []
        turns = loss = None
        n = chars = size = 0

        def handed() -> pa.RecordBatch:
            made = [pa.array([r[i] for r in out], pa.string() if i in (2, 4) else pa.int64()) for i in range(6)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            for window in batch.to_pylist():
                if now != (window["conv_id"],):
                    if now:
                        out.append((*now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    now, turns, loss = (window["conv_id"],), hashlib.sha256(), hashlib.sha256()
                    n = chars = size = 0
                new, targets = read_window(window)
                n += len(new)
                size += len(window["formatted"])
                turns.update("".join(f"{role}\n{text}\n" for role, text in new).encode())
                chars += sum(map(len, targets))
                loss.update("".join(targets).encode())
            yield handed()
        if now:
            out.append((*now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            yield handed()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
