"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|turn|>", "<|end|>\n"
#: Strings that a tokenizer or a template may take for control; fixed values.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: The first character of any control string, wherever one begins.
BEGINS = "([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string; null counts as empty.

    What comes out holds no control string, and ``unescape`` gives the text back.
    """
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, BEGINS, "$1\\\\")


def unescape(text: Column) -> Column:
    """A backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, text, loss_start, loss_length, n_context.

    Each assistant turn becomes an example: all turns before it and the reply,
    formatted; only the reply's text is trainable. loss_start and loss_length
    count code points of ``text``. If a conversation doesn't end with an
    assistant turn, one more example holds all its turns and trains nothing
    (null loss), so that the output always holds every turn. ``example`` is
    the number of the example's last turn, from 1.

    A turn is ``<|turn|>role\\ntext<|end|>\\n``, with role and text escaped.
    Turns go by turn, null first, then by role and text, so repeated turn
    numbers have a fixed order; repeated rows stay. Null roles and texts count
    as empty, null conv_ids make one conversation. Other columns are ignored.
    An empty table gives no examples. A conversation's turns meet in one task,
    as each example needs all of them; conversations spread over tasks.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("__role"), F.coalesce("text", F.lit("")).alias("__text"))
    head = F.concat(F.lit(START), escape_role(F.col("__role")), F.lit("\n"))
    rows = rows.withColumns({"__head": head, "__body": escape(F.col("__text"))})
    rows = rows.withColumn("__turn", F.concat("__head", "__body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "__role", "__text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id",
        "__role",
        F.count(F.lit(1)).over(so_far).alias("example"),
        F.collect_list("__turn").over(so_far).alias("__turns"),
        F.sum(F.length("__turn")).over(so_far).alias("__chars"),
        F.length("__turn").alias("__own"),
        F.length("__head").alias("__head"),
        F.length("__body").alias("__body"),
        F.lead(F.lit(1)).over(order).isNull().alias("__last"),
    )
    reply = F.col("__role") == "assistant"
    rows = rows.where(reply | F.col("__last"))
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.array_join("__turns", "").alias("text"),
        F.when(reply, F.col("__chars") - F.col("__own") + F.col("__head")).cast("long").alias("loss_start"),
        F.when(reply, F.col("__body")).cast("long").alias("loss_length"),
        (F.col("example") - 1).cast("long").alias("n_context"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What a reader of the formatted examples finds, per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars:
    the turns as parsed from the longest example, and the text under the loss
    masks of all examples, unescaped, in order.
    """
    turn = r"(?s)<\|turn\|>((?:[^\\\n]|\\.)*+)\n(.*?)<\|end\|>\n"
    roles, texts = (F.regexp_extract_all("text", F.lit(turn), F.lit(i)) for i in (1, 2))
    loss = F.when(F.col("loss_start").isNotNull(), F.struct("example", unescape(F.expr("substring(text, CAST(loss_start AS INT) + 1, CAST(loss_length AS INT))")).alias("reply")))
    convs = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"), F.sort_array(F.collect_list(loss)).alias("losses"), F.sum(F.length("text")).cast("long").alias("formatted_chars")
    )
    pairs = F.arrays_zip(roles.alias("role"), texts.alias("text"))
    convs = convs.select("conv_id", "formatted_chars", pairs.alias("turns"), F.array_join(F.col("losses.reply"), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(unescape(x["role"]), F.lit("\n"), unescape(x["text"]), F.lit("\n"))), "")
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
