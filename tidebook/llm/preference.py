"""Preference formatting: pairs of a chosen and a rejected conversation as prompt and masked completions.

The longest common prefix of turns (same role, same text) is rendered once, as the prompt; what follows in either
conversation is its completion. A completion is a list of segments, each with its text and whether it is trained on:
of a trained role's turns the text and the end mark are, headers and other roles' turns aren't. Only built-in
functions are used, each linear in the number of turns.

Rows: a missing conversation counts as one without turns; a turn's null role or text counts as empty; equal
conversations have an empty completion each; where one is a prefix of the other, only the longer has a completion; text
that looks like a mark of the template is broken up (``<|`` becomes ``< |``), so that no turn can forge another;
an empty table gives an empty result; other columns stay, except those that the result names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = ("assistant",)
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order; turns that share a number go by role and text. Rows with
    a null id belong to no conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = turns.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("conv_id"))
    plain = F.transform(F.array_sort(F.collect_list(one)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.agg(plain.alias("turns"))


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns at the start the two have in common."""
    n = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, 1, n), F.slice(rejected, 1, n), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n).cast("int")


def _cleaned(turns: Column) -> Column:
    def guarded(x: Column) -> Column:
        return F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))

    known = F.coalesce(turns, F.array().cast(TURNS))
    return F.transform(known, lambda t: F.struct(guarded(t["role"]).alias("role"), guarded(t["text"]).alias("text")))


def _header(t: Column) -> Column:
    return F.concat(F.lit(BEGIN), t["role"], F.lit("\n"))


def _segments(turns: Column, trained: tuple[str, ...]) -> Column:
    def of(t: Column) -> Column:
        def segment(text: Column, learn: Column) -> Column:
            return F.struct(text.alias("text"), learn.alias("trained"))

        body = segment(F.concat(t["text"], F.lit(END)), t["role"].isin(*trained))
        return F.array(segment(_header(t), F.lit(False)), body)

    return F.flatten(F.transform(turns, of))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``pairs`` with ``n_shared``, ``prompt``, and ``chosen_completion`` and ``rejected_completion``, lists of
    (text, trained). The columns of turns are dropped."""
    rows = pairs.withColumns({"_c": _cleaned(F.col(chosen)), "_r": _cleaned(F.col(rejected))}).drop(chosen, rejected)
    rows = rows.withColumn("n_shared", shared_turns(F.col("_c"), F.col("_r")))
    common = F.slice("_c", 1, F.col("n_shared"))
    prompt = F.array_join(F.transform(common, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")

    def rest(turns: str) -> Column:
        return _segments(F.slice(turns, F.col("n_shared") + 1, F.size(turns)), trained)

    rows = rows.withColumns({"prompt": prompt, "chosen_completion": rest("_c"), "rejected_completion": rest("_r")})
    return rows.drop("_c", "_r")


def mismatched(table: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """(conv_id, chosen, rejected) for every conversation: chosen as it is; rejected with its last reply exchanged for
    the last reply of the neighbour with which it shares ``conv_id`` div 2 (left out where there is none)."""
    last = F.element_at(F.filter("turns", lambda t: t["role"].isin(*trained)), -1)
    replies = table.where(F.exists("turns", lambda t: t["role"].isin(*trained)))
    replies = replies.select(F.col("conv_id").bitwiseXOR(1).alias("conv_id"), last["role"].alias("_role"), last["text"].alias("_text"))
    rows = table.join(replies, "conv_id", "left")
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"].isin(*trained))), True) + 1
    other = F.struct(F.col("_role").alias("role"), F.col("_text").alias("text"))
    reply = F.when(F.col("_role").isNull(), F.array().cast(TURNS)).otherwise(F.array(other))
    at = F.when(at <= F.size("turns"), at).otherwise(F.size("turns") + 1).cast("int")
    before, after = F.slice("turns", 1, F.col("_at") - 1), F.slice("turns", F.col("_at") + 1, F.size("turns"))
    exchanged = F.when(F.col("_at") > F.size("turns"), F.col("turns")).otherwise(F.concat(before, reply, after))
    return rows.withColumn("_at", at).select("conv_id", F.col("turns").alias("chosen"), exchanged.alias("rejected"))
