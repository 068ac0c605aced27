"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, `<|im_start|>role<|im_sep|>text<|im_end|>` a
turn, and encoded once with character offsets. The control strings are special
tokens, so no token spans a turn's border. The turns' spans are sorted, as the
tokens' are; binary search finds for each token the span that it may lie in,
and it is under the loss if it lies in a text of a trained role.

Inside roles and texts every `<`, backslashes, `|` gets one backslash more, so
no control string can arise there; taking one away restores it.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from halyard.llm.common import python_ready

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = ("assistant",)
#: Characters that are encoded in one call.
BLOCK_CHARS = 1_000_000
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted character spans of the
    (escaped) texts of trained roles."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        parts += [head, body, END]
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


@cache
def tokenizer(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    return out


def mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: the last span that starts at or before the
    token has to reach its end. Empty spans and tokens are under none."""
    spans = [s for s in spans if s[1] > s[0]]
    if not spans:
        return np.zeros(len(starts), bool)
    begin, end = np.array(spans).T
    at = np.searchsorted(begin, starts, side="right") - 1
    return (at >= 0) & (ends <= end[np.maximum(at, 0)]) & (ends > starts)


def encode(conversations: list[list[tuple[str, str]]], path: str, trained: tuple[str, ...] = TRAINED):
    """(formatted, ids, starts, ends, loss) of each conversation, encoded once."""
    done, total = [], len(conversations)
    rendered = [render(c, trained) for c in conversations]
    at = 0
    while at < total:
        to, size = at, 0
        while to < total and (to == at or size + len(rendered[to][0]) <= BLOCK_CHARS):
            size += len(rendered[to][0])
            to += 1
        for (text, spans), e in zip(rendered[at:to], tokenizer(path).encode_batch([t for t, _ in rendered[at:to]], add_special_tokens=False)):
            starts, ends = np.array(e.offsets, np.int64).reshape(-1, 2).T
            done.append((text, e.ids, starts, ends, mask(spans, starts, ends)))
        at = to
    return done


def loss_text(formatted: str, starts, ends, loss) -> str:
    """The unescaped text under the loss mask: the characters that its tokens
    cover, each once. Every masked stretch is one text or part of it."""
    parts, low, high = [], 0, 0
    for a, b, under in zip(starts, ends, loss):
        if not under:
            continue
        if a > high:
            parts.append(formatted[low:high])
            low = a
        high = max(high, b)
    parts.append(formatted[low:high])
    return "".join(map(unescape, parts))


def format_chats(turns: DataFrame, tokenizer_path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row per conversation: `conv`, `formatted`, `ids`, `starts`, `ends`
    (character offsets of the tokens) and `loss` (a boolean a token).

    Rows go by turn (nulls first), then role and text, so that rows of equal
    turn have one order; repeated rows are turns of their own. Null roles and
    texts are empty. Rows without a conversation id form one conversation. A
    conversation is the unit of encoding, so its rows meet in one task.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            chats = [[(t["role"], t["text"]) for t in c] for c in b.column(1).to_pylist()]
            for at in range(0, len(chats), 200):
                found = encode(chats[at : at + 200], tokenizer_path, trained)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(found)), pa.array([x[0] for x in found], pa.string()), *(pa.array([np.asarray(x[k], np.int32) for x in found], pa.list_(pa.int32())) for k in (1, 2, 3)), pa.array([x[4].tolist() for x in found], pa.list_(pa.bool_()))],
                    names=[conv, "formatted", "ids", "starts", "ends", "loss"],
                )

    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grouped = python_ready(turns).select(conv, row.alias("__turn")).groupBy(conv).agg(F.array_sort(F.collect_list("__turn")).alias("turns"))
    kind = grouped.schema[conv].dataType.simpleString()
    return grouped.mapInArrow(run, f"`{conv}` {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What a reader gets back from formatted rows: turns and text under the loss."""

    def run(batches):
        for b in batches:
            rows = []
            for text, starts, ends, loss in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
                turns, under = parse(text), loss_text(text, starts, ends, loss)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    source = python_ready(formatted).select(conv, "formatted", "starts", "ends", "loss")
    kind = source.schema[conv].dataType.simpleString()
    return source.mapInArrow(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
