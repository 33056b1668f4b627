"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context and only its
text is trainable. Turns after the last assistant turn (or all turns, where there is none) close the
conversation as one more example without a trainable part, so the output holds every turn.

Template: <|start|>role<|text|>text<|end|> for each turn, in order, nothing between. Control strings
inside roles and texts are escaped by one backslash after their first character; those that already
hold backslashes there get one more, so that taking one away restores any text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
#: Strings that no text may hold as they are: this template's own and those of other common ones.
CONTROL = (START, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")

_rest = [(re.escape(c[0]), re.escape(c[1:])) for c in CONTROL]
_plain = re.compile("|".join(rf"{a}(?=\\*{b})" for a, b in _rest))
_escaped = re.compile("|".join(rf"{a}\\(?=\\*{b})" for a, b in _rest))
_turn = re.compile(f"{re.escape(START)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)

SCHEMA = "conv_id long, example long, context_turns long, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _plain.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[0][0], text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends there. Null role or text: empty."""
    head = START + escape(role or "") + TEXT
    body = escape(text or "")
    return head + body + END, len(head), len(head) + len(body)


def expand(turns: list[tuple[str | None, str | None]]) -> Iterator[tuple[int, str, int, int]]:
    """(turns before the last, formatted, loss start, loss end) of each example of one conversation; 0, 0 without loss."""
    prefix = ""
    open_turns = False
    for k, (role, text) in enumerate(turns):
        one, a, b = format_turn(role, text)
        if role == ASSISTANT:
            yield k, prefix + one, len(prefix) + a, len(prefix) + b
        prefix += one
        open_turns = role != ASSISTANT
    if open_turns:
        yield len(turns) - 1, prefix, 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    return [(unescape(a), unescape(b)) for a, b in _turn.findall(formatted)]


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example (SCHEMA), a conversation's examples in order and next to each other.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, role
    and text, nulls first; rows that repeat are turns of their own. The result holds each context as
    often as the method asks for; Python writes it example by example and holds one conversation.
    """
    turn = F.struct("turn", "role", "text")
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size = 0
        for pdf in batches:
            for conv, turns in zip(pdf["conv_id"], pdf["turns"]):
                for n, (before, formatted, a, b) in enumerate(expand([(t["role"], t["text"]) for t in turns])):
                    out.append((conv, n, before, formatted, a, b))
                    size += len(formatted)
                    if size > 4_000_000 or len(out) >= 1024:
                        yield pd.DataFrame(out, columns=_names)
                        out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=_names)

    return convs.mapInPandas(run, SCHEMA)


_names = [c.split()[0] for c in SCHEMA.split(", ")]
