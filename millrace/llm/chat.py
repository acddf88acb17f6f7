"""Chat formatting in budgeted windows.

A turn is written as <|im_start|>role NEWLINE text <|im_end|> NEWLINE. Prefix sums of the turns' tokens, counted by a
tokenizer, cut a conversation into turn-aligned windows within a budget. Each later window starts with the system turn and as
many of the last turns as fit the history limit and the budget; what is repeated is masked, and of the new turns the
assistant's texts carry the loss. Where a turn leaves no room for history, that goes first, then the system turn; only a turn
that is itself longer than the budget overruns it, in a window of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Query, keep, partitions, table
from millrace.llm.tokens import default_path, encoder

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY, MARKS = 1024, 256, 2
WINDOWS = "conv_id long, window long, n_turns int, n_repeated int, n_tokens long, formatted string, loss array<struct<lo:int,hi:int>>"


def escape(text: str) -> str:
    """Puts a backslash into every "<|", "<\\|", ... so that no control string is left; unescape() takes it out."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def tokens(turns: list[tuple[str, str]], path: str) -> list[int]:
    """Tokens of each turn (role, text) as it is written: ids of the role and the text, and one for each mark."""
    ids = encoder(path).batch([x for role, text in turns for x in (escape_role(role), escape(text))])
    return [(len(r) + len(t)) // 4 + MARKS for r, t in zip(ids[::2], ids[1::2])]


def _write(conv, window: int, repeated: list, turns: list) -> tuple:
    out, at, loss = [], 0, []
    for i, (role, text, _) in enumerate(repeated + turns):
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        if role == "assistant" and i >= len(repeated):
            loss.append({"lo": at + len(head), "hi": at + len(head) + len(body)})
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return conv, window, len(repeated) + len(turns), len(repeated), sum(t[2] for t in repeated + turns), "".join(out), loss


def windows(turns: Iterator[tuple], budget: int, history: int) -> Iterator[tuple]:
    """turns: conversation, role, text, tokens, each conversation's together and in order. Holds a window and its history."""
    conv: object = windows
    number, system, repeated, new, used = 0, None, [], [], 0
    recent: deque = deque()
    for c, role, text, size in turns:
        if c != conv:
            if new:
                yield _write(conv, number, repeated, new)
            conv, number, system, repeated, new, used = c, 0, None, [], [], 0
            recent.clear()
        turn = (role, text, size)
        if new and used + turn[2] > budget:
            yield _write(conv, number, repeated, new)
            number += 1
            head = [system] if system and system[2] + turn[2] <= budget else []
            room = min(history, budget - turn[2] - sum(t[2] for t in head))
            past: list = []
            for t in reversed(recent):
                if t is system or sum(x[2] for x in past) + t[2] > room:
                    break
                past.insert(0, t)
            repeated, new = head + past, []
            used = sum(t[2] for t in repeated)
        new.append(turn)
        used += turn[2]
        if role == "system" and system is None:
            system = turn
        recent.append(turn)
        while len(recent) > 1 and sum(t[2] for t in recent) > history:
            recent.popleft()
    if new:
        yield _write(conv, number, repeated, new)


def _format(frames: Iterator[pd.DataFrame], budget: int, history: int, path: str) -> Iterator[pd.DataFrame]:
    def turns() -> Iterator[tuple]:
        for frame in frames:
            for lo in range(0, len(frame), 256):
                some = frame.iloc[lo : lo + 256]
                says = [(role or "", text or "") for role, text in zip(some["role"], some["text"])]
                for conv, turn, n in zip(some["conv_id"].array, says, tokens(says, path)):
                    yield None if pd.isna(conv) else int(conv), *turn, n

    names, held, size = ["conv_id", "window", "n_turns", "n_repeated", "n_tokens", "formatted", "loss"], [], 0
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
    for row in windows(turns(), budget, history):
        held.append(row)
        size += len(row[5])
        if size > 4_000_000:
            yield frame(held)
            held, size = [], 0
    if held:
        yield frame(held)


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """conv_id, window, n_turns, n_repeated, n_tokens, formatted, loss (spans of code points with loss, escapes included).

    Rows go by turn (null first), then role and text where turns tie, so repeated rows are turns of their own. A null text
    or role is an empty one; all rows with a null conv_id are one conversation. A window keeps to the budget unless its only turn
    is longer. A conversation streams through one task, which holds a window and its history. No rows give no rows; other
    columns are ignored.
    """
    path = tokenizer or default_path()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInPandas(lambda it: _format(it, budget, history, path), WINDOWS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn that a window shows."""
    out = []
    for part in formatted.split(START)[1:]:
        if not part.endswith(END + "\n"):
            raise ValueError("a turn has no end")
        role, text = part[: -len(END) - 1].split("\n", 1)
        out.append((unescape_role(role), unescape(text)))
    return out


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv: object = _digest
    rows: list = []
    n = loss_n = size = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for frame in frames:
        for c, repeated, formatted, spans in zip(frame["conv_id"].array, frame["n_repeated"], frame["formatted"], frame["loss"]):
            c = None if pd.isna(c) else int(c)
            if c != conv:
                if conv is not _digest:
                    rows.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
                conv, n, loss_n, size = c, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in parse(formatted)[repeated:]:
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for s in spans:
                text = unescape(formatted[s["lo"] : s["hi"]])
                loss.update(text.encode("utf-8", "surrogatepass"))
                loss_n += len(text)
            size += len(formatted)
    if conv is not _digest:
        rows.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))
    yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows' text and masks: turns, their digest, the text under the mask and its digest."""
    rows = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.select("conv_id", "n_repeated", "formatted", "loss").mapInPandas(_digest, schema)


def op8_chat_windows(spark, sf_dir):
    says = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return read_back(keep(format_chats(rows.unionByName(added)), "chats"))


QUERIES: dict[str, Query] = {"op8_chat_windows": op8_chat_windows}
ORACLES: dict[str, str] = {}
