"""Conversations as training windows of a token budget.

Prefix sums of turn tokens choose spans of whole turns. A window holds the system turn of its conversation, a limited
run of the turns before its span, and the span; the loss mask covers assistant texts of the span only, so every target
is learned once. A turn longer than the budget has a window of its own and is not cut.

Template: ``<s>[INST]role[/INST]text</s>`` and a line break for each turn. Inside roles and texts a backslash follows
the first character of each control string, and backslashes are doubled; `unescape` undoes both.

Conversations stream through sorted partitions, and only the turns of the current window are in memory, however long a
conversation is. Turns are ordered by turn, role and text, nulls first. A null role or text is empty, a null
conversation id is an id of its own, equal rows are turns each for itself, other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm import text as T
from shiftledger.llm.tokens import TOKENIZER, encoder

BUDGET, HISTORY = 1024, 256
#: Strings that mark turns here or in templates in common use.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
MARK_TOKENS = 8  # of the marks around one turn
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>\n", re.DOTALL)
WINDOWS = ("conv_id bigint, window int, text string, loss array<struct<start:int,end:int>>, n_tokens bigint, "
           "n_repeated int, n_turns int")
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_tokens", pa.int64()),
    ("n_repeated", pa.int32()), ("n_turns", pa.int32())])
ROWS = 512  # windows in one batch

Turn = tuple[str, str, int]  # role, text, tokens


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def render(turns: list[Turn], n_repeated: int) -> tuple[str, list[dict[str, int]]]:
    """The text of a window and the spans under its loss mask."""
    parts, at, loss = [], 0, []
    for k, (role, text, _) in enumerate(turns):
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        if role == "assistant" and k >= n_repeated:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, "</s>\n"]
        at += len(head) + len(body) + 5
    return "".join(parts), loss


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]


def spans(turns: Iterable[Turn], budget: int, history: int) -> Iterator[tuple[list[Turn], int]]:
    """The turns of each window, and how many of them at its start are repeated."""
    system: list[Turn] = []
    window: list[Turn] = []
    repeated = upto = 0  # prefix sum of the tokens of the window
    for turn in turns:
        if len(window) > repeated and upto + turn[2] > budget:
            yield window, repeated
            room = min(history, budget - turn[2] - sum(t[2] for t in system))
            past, kept = window[len(system):], []
            while past and past[-1][2] <= room:
                room -= past[-1][2]
                kept.append(past.pop())
            window = system + kept[::-1]
            repeated, upto = len(window), sum(t[2] for t in window)
        if not window and turn[0] == "system":
            system = [turn]
        window.append(turn)
        upto += turn[2]
    if len(window) > repeated:
        yield window, repeated


def _sorted_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Training windows of all conversations (conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turn]]:
        for batch in batches:
            ids, roles = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last, data, at in T.segments(batch.column(3)):
                counts = encoder(tokenizer).encode(data, at)[1].tolist()
                texts = batch.column(3).slice(first, last - first).to_pylist()
                for k in range(first, last):
                    yield ids[k], (roles[k], texts[k - first], counts[k - first] + MARK_TOKENS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for conv, own in groupby(turns(batches), key=lambda x: x[0]):
                for k, (shown, repeated) in enumerate(spans((t for _, t in own), budget, history)):
                    text, loss = render(shown, repeated)
                    yield {"conv_id": conv, "window": k, "text": text, "loss": loss, "n_tokens": sum(t[2] for t in shown),
                           "n_repeated": repeated, "n_turns": len(shown)}

        yield from _batched(rows(), _ARROW)

    return _sorted_rows(rows, "conv_id", "turn", "role", "text").mapInArrow(build, WINDOWS)


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """What windows say when they are read back: turns and loss texts of each conversation, as counts and digests."""
    columns = ["conv_id", "window", "text", "loss", "n_repeated"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = (r for batch in batches for r in batch.to_pylist())

        def rows() -> Iterator[dict]:
            for conv, own in groupby(shown, key=lambda r: r["conv_id"]):
                turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for r in own:
                    for role, text in parse(r["text"])[r["n_repeated"]:]:
                        turns.update(f"{role}\n{text}\n".encode())
                        n_turns += 1
                    for span in r["loss"]:
                        target = unescape(r["text"][span["start"]:span["end"]])
                        loss.update(target.encode())
                        loss_chars += len(target)
                    chars += len(r["text"])
                yield {"conv_id": conv, "n_turns": n_turns, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                       "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

        yield from _batched(rows(), _DIGESTS)

    return _sorted_rows(formatted.select(columns), "conv_id", "window").mapInArrow(read, DIGESTS)
