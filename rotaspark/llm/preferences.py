"""Preference formatting: the turns that a chosen and a rejected conversation share are rendered once, as the prompt.

What follows the longest common turn prefix is a completion on either side: segments of text with a flag that says
whether a model is trained on them. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.common import staged, successors

TRAINED_ROLE = "assistant"
_TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def segments(turns: Column) -> Column:
    """(text, train) in order: each turn's head, never trained on, and its body, trained on if the assistant speaks."""
    mine = lambda t: F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False))
    pair = lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("train")), F.struct(_body(t).alias("text"), mine(t).alias("train"))
    )
    return F.flatten(F.transform(turns, pair))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns from the start have the same role and text on both sides; NULLs equal NULLs."""
    shared = F.least(F.size(a), F.size(b))
    same = lambda i: F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])
    places = F.filter(F.sequence(F.lit(0), shared - 1), lambda i: ~same(i))
    return F.when(shared == 0, 0).otherwise(F.coalesce(F.get(places, F.lit(0)), shared))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """The columns of pairs but chosen and rejected, then n_prompt_turns, prompt, chosen, rejected.

    pairs has chosen and rejected, arrays of turns with role and text; in the result they are segments (text, train)
    after the common turns. Two equal conversations have an empty completion on both sides; NULL arrays count as
    empty; NULL roles and texts are rendered as empty. An empty table gives no rows.
    """
    none = F.array().cast(_TURNS)
    rows = pairs.withColumns({c: F.coalesce(c, none) for c in ("chosen", "rejected")})
    rows = rows.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    n = F.col("n_prompt_turns")
    rest = lambda c: segments(F.slice(c, n + 1, F.size(c)))
    kept = [F.col(f"`{c}`") for c in pairs.columns if c not in ("chosen", "rejected", "n_prompt_turns", "prompt")]
    return rows.select(
        *kept, n.cast("int").alias("n_prompt_turns"), rendered(F.slice("chosen", F.lit(1), n)).alias("prompt"),
        rest(F.col("chosen")).alias("chosen"), rest(F.col("rejected")).alias("rejected"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, other_id, n_turns, chosen, rejected: a preference pair for every conversation.

    turns has conv_id, turn, role and text. chosen is the conversation up to its last reply of the assistant; rejected
    is the same with that reply replaced by the last reply of the next conversation, in ascending conv_id, that has one
    (after the last: the first). A conversation without a reply has other_id NULL and itself on both sides, so its
    completions are empty; so has a conversation whose text equals the next reply. Turns are ordered by turn, role and
    text, repeated turns stay; a row without conv_id is a conversation of its own. Other columns are ignored.

    A conversation is one row by nature; all its turns meet in it. Successors are found in blocks of ids.
    """
    whole = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), whole.alias("t"))
    known = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = known.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("t").alias("turns")))
    at = F.array_max(
        F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)), lambda i: i.isNotNull())
    )
    convs = staged(convs.select("conv_id", "turns", at.alias("at")), "preference-turns")
    replies = convs.where("at IS NOT NULL AND conv_id IS NOT NULL")
    first = replies.agg(F.min("conv_id")).first()[0]
    following = successors(replies.select("conv_id"), "conv_id").select(F.col("conv_id").alias("c"), F.col("next_key"))
    placed = convs.join(following, F.col("conv_id") == F.col("c"), "left").withColumn(
        "other_id", F.when(F.col("at").isNotNull(), F.coalesce("next_key", F.lit(first).cast("long")))
    )
    texts = replies.select(F.col("conv_id").alias("o"), F.get("turns", F.col("at"))["text"].alias("reply"))
    rows = placed.join(texts, F.col("other_id") == F.col("o"), "left")
    chosen = F.when(F.col("at").isNull(), F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.col("at") + 1))
    last = F.get("turns", F.col("at"))
    swapped = F.concat(
        F.slice("turns", F.lit(1), F.col("at")),
        F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), F.col("reply").alias("text"))),
    )
    rejected = F.when(F.col("other_id").isNull(), chosen).otherwise(swapped)
    return rows.select(
        "conv_id", "other_id", F.size("turns").alias("n_turns"), chosen.alias("chosen"), rejected.alias("rejected")
    )
