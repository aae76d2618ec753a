"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are context, and only
its text is under the loss. Turns after the last assistant turn, or a conversation without
one, give a last example without loss, so that the output holds every turn.

Template: ``<<SYS>> t <</SYS>>``, ``[INST] t [/INST]``, `` t </s>`` for system, user and
assistant, ``[ROLE name] t [/ROLE]`` for others. Inside texts a backslash precedes each control
string and each backslash, which ``parse`` undoes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE|\[/ROLE\]"
ESCAPED = re.compile(rf"\\|(?={CONTROL})")
UNESCAPED = re.compile(r"\\(.)", re.S)
TOKEN = re.compile(rf"\\.|{CONTROL}", re.S)
ROLE_NAME = re.compile(r" ((?:\\.|[^\]\\])*)\] ", re.S)
OPEN = {"system": "<<SYS>> ", "user": "[INST] ", "assistant": "<s> "}
CLOSE = {"system": " <</SYS>>", "user": " [/INST]", "assistant": " </s>"}
ENDS = {"<<SYS>>": ("system", "<</SYS>>"), "[INST]": ("user", "[/INST]"), "<s>": ("assistant", "</s>")}
#: characters of examples in one output batch
BATCH_CHARS = 4_000_000
SCHEMA = "conv_id long, example long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def opening(role: str) -> str:
    return OPEN.get(role) or "[ROLE " + re.sub(r"([\\\]])", r"\\\1", role) + "] "


def turn_text(role: str, text: str) -> str:
    return opening(role) + escape(text) + CLOSE.get(role, " [/ROLE]")


def parse(example: str) -> list[tuple[str, str]]:
    """The turns of an example: role and text."""
    out, at = [], 0
    while at < len(example):
        m = TOKEN.match(example, at)
        if m[0] in ENDS:
            (role, end), start = ENDS[m[0]], m.end() + 1
        else:
            name = ROLE_NAME.match(example, m.end())
            role, end, start = unescape(name[1]), "[/ROLE]", name.end()
        at = start
        while (m := TOKEN.search(example, at))[0] != end:
            at = m.end()
        out.append((role, unescape(example[start : m.start() - 1])))
        at = m.end()
    return out


def examples(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """``text, loss_start, loss_end`` in code points; equal ends: no loss."""
    context, open_turns = "", False
    for role, text in turns:
        if role == "assistant":
            start = len(context) + len(OPEN[role])
            context += turn_text(role, text)
            yield context, start, len(context) - len(CLOSE[role])
            open_turns = False
        else:
            context += turn_text(role, text)
            open_turns = True
    if open_turns:
        yield context, len(context), len(context)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def _expand(batches):
    """Rows arrive by conversation and turn; a conversation is kept until its last row is read."""
    rows, size, now, turns = [], 0, None, []

    def flush():
        yield from ((now[0], i, *x) for i, x in enumerate(examples(turns)))

    for b in batches:
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if now != (conv,):
                for x in flush() if now else ():
                    rows.append(x)
                    size += len(x[2])
                    if size > BATCH_CHARS:
                        yield _batch(rows)
                        rows, size = [], 0
                now, turns = (conv,), []
            turns.append((role or "", text or ""))
    for x in flush() if now else ():
        rows.append(x)
        size += len(x[2])
        if size > BATCH_CHARS:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end`` from rows ``conv_id, turn, role, text``.

    Null texts and roles are empty; null turns come first, equal turns by role and text;
    repeated rows are repeated turns; rows without conv_id are one conversation. A conversation
    is the unit of work, held in memory by one task while its examples are written out one by
    one. No rows give no examples.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, SCHEMA)


def _read(batches):
    for b in batches:
        got = []
        for text, a, z in zip(*(b.column(c).to_pylist() for c in ("text", "loss_start", "loss_end"))):
            turns = parse(text)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            got.append((len(turns), digest, unescape(text[a:z]), len(text)))
        cols = list(zip(*got)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("example"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            ["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"],
        )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the examples: turns, text under the loss, size."""
    read = formatted.mapInArrow(_read, "conv_id long, example long, n_turns long, turns_sha256 string, loss string, chars long")
    whole = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by("turns_sha256", "example").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("_losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("_losses", lambda x: x["loss"]), "")
    whole = whole.withColumn("_loss", loss)
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars"
    )
