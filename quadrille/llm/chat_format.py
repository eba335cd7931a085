"""Chat formatting in Spark expressions only: one string and one loss mask per conversation.

Template, per run of adjacent turns of one role::

    <|start|>role<|sep|>text<|join|>text...<|end|>

Turns are collected as structs and sorted by (turn, role, text); adjacent turns of one role become one block, their
texts parted by the join mark, so that single turns can be read back. A control string inside a role or text gets a
backslash after its first character, and one more if it has some already; ``unescape`` takes one away.

Defined results: null texts and roles are empty; a null turn sorts first; rows with equal (turn, role, text) all stay;
a null conversation id is a conversation of its own; an empty table gives an empty result; other columns are dropped.
One conversation is one output value, so it must fit into a task, as any row must.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, JOIN, END = "<|start|>", "<|sep|>", "<|join|>", "<|end|>"
CONTROL = (START, SEP, JOIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

_first = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_rest = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([{_first}])(\\*)({_rest})"
UNESCAPE = rf"([{_first}])\\(\\*)({_rest})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans): loss_spans holds start and length, in code points of formatted, of each text of loss_role."""
    rows = turns.select(
        F.col(conv).alias(conv),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    one = rows.groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("raw"))
    one = one.select(conv, F.transform("raw", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    n = F.size("turns")
    at = lambda i: F.get(F.col("turns"), i)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"]))
    one = one.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            at(s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s + 1, F.coalesce(F.get(F.col("starts"), k + 1), n) - s), lambda t: t["text"]
            ).alias("texts"),
        ),
    )
    one = one.withColumn("blocks", blocks)
    whole = F.transform(
        "blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], JOIN), F.lit(END))
    )
    return one.select(conv, F.array_join(whole, "").alias("formatted"), loss_spans(F.col("blocks"), loss_role).alias("loss_spans"))


def loss_spans(blocks: Column, loss_role: str) -> Column:
    """Walks the blocks with the position reached so far."""
    empty = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def over_text(state: Column, text: Column) -> Column:
        span = F.struct(state["pos"].alias("start"), F.char_length(text).alias("length"))
        return F.struct(
            (state["pos"] + F.char_length(text) + len(JOIN)).alias("pos"),
            F.concat(state["spans"], F.array(span)).alias("spans"),
        )

    def over_block(state: Column, block: Column) -> Column:
        begin = state["pos"] + len(START) + F.char_length(block["role"]) + len(SEP)
        told = F.aggregate(block["texts"], F.struct(begin.alias("pos"), state["spans"].alias("spans")), over_text)
        return F.struct(
            (told["pos"] - len(JOIN) + len(END)).alias("pos"),
            F.when(block["role"] == loss_role, told["spans"]).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(blocks, empty, over_block, lambda s: s["spans"])


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped and in order."""
    blocks = F.filter(F.split(formatted, re.escape(END)), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.split(F.substr(block, F.lit(len(START) + 1)), re.escape(SEP), 2)
        return F.transform(
            F.split(head[1], re.escape(JOIN)),
            lambda t: F.struct(unescape(head[0]).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, with nothing between them."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
