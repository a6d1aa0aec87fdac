"""Preference formatting of chat conversations, in DataFrame functions only.

A pair's chosen and rejected conversations share their first turns: all turns before the first turn number at which their contents
differ. That prefix is rendered once, as prompt; what follows is rendered for either side as completion, with the character spans that
are to be learned (what assistants say, and the end mark); everything else is masked.

Roles and texts are escaped ("<|" becomes "<\\|", and "<\\" becomes "<\\\\"), so no turn can hold a mark that begins or ends another one.

A conversation is one record here, like a document's text: its turns are brought together, and no more than those of its pair.

Defined cases: a null turn number comes first, a null role or text is empty; a turn row that is repeated counts once, different rows with
one turn number are turns in the order of role and text; equal conversations have empty completions; pairs of which a side has no turns
have an empty prompt and an empty completion there, pairs without any turns are left out; null conversation ids are ignored; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """The text without any "<|"; the text itself can be had back."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def _rendered(turns: str, learned: str) -> tuple[Column, Column]:
    """The turns as text, and the learned spans (start, stop) in it, in code points, end exclusive."""
    each = f"transform({turns}, x -> concat('<|', x.role, '|>\\n', x.text, '<|end|>\\n'))"
    spans = f"""filter(aggregate({turns}, struct(0 AS at, CAST(array() AS array<struct<start:int,stop:int>>) AS out),
        (a, x) -> struct(a.at + length(x.role) + length(x.text) + 13 AS at,
                         IF(x.role = '{learned}', array_append(a.out, named_struct('start', a.at + length(x.role) + 5, 'stop', a.at + length(x.role) + length(x.text) + 12)), a.out) AS out),
        a -> a.out), s -> s IS NOT NULL)"""
    return F.expr(f"array_join({each}, '')"), F.expr(spans)


def preferences(turns: DataFrame, pairs: DataFrame, learned: str = LEARNED) -> DataFrame:
    """pair_id, chosen_id, rejected_id, the prompt and both completions with their learned spans, and the numbers of turns.

    turns: conv_id, turn, role, text; pairs: pair_id, chosen_id, rejected_id, each pair_id once.
    """
    sides = pairs.select("pair_id", "chosen_id", "rejected_id", F.inline(F.expr("array(struct(chosen_id AS conv_id, true AS c), struct(rejected_id AS conv_id, false AS c))"))).where("conv_id IS NOT NULL")
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), *[escaped(F.coalesce(c, F.lit(""))).alias(c) for c in ("role", "text")])
    both = rows.join(sides, "conv_id").groupBy("pair_id", "chosen_id", "rejected_id", "turn", "role", "text").agg(F.bool_or("c").alias("c"), F.bool_or(~F.col("c")).alias("r"))
    df = both.groupBy("pair_id", "chosen_id", "rejected_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "c", "r"))).alias("ts"))
    df = df.withColumn("cut", F.expr("array_min(transform(filter(ts, x -> NOT (x.c AND x.r)), x -> x.turn))"))
    df = df.select(
        "pair_id", "chosen_id", "rejected_id",
        F.expr("filter(ts, x -> cut IS NULL OR x.turn < cut)").alias("p"), F.expr("filter(ts, x -> x.c AND x.turn >= cut)").alias("c"), F.expr("filter(ts, x -> x.r AND x.turn >= cut)").alias("r"),
    )
    prompt, _ = _rendered("p", learned)
    (chosen, chosen_spans), (rejected, rejected_spans) = _rendered("c", learned), _rendered("r", learned)
    return df.select(
        "pair_id", "chosen_id", "rejected_id", prompt.alias("prompt"), chosen.alias("chosen"), chosen_spans.alias("chosen_learned"), rejected.alias("rejected"), rejected_spans.alias("rejected_learned"),
        *[F.size(x).cast("long").alias(f"n_{name}") for x, name in (("p", "prompt"), ("c", "chosen"), ("r", "rejected"))],
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2 k (chosen) and 2 k + 1 (rejected) of which there are turns."""
    ids = turns.where(F.col("conv_id").isNotNull()).select(F.expr("shiftright(CAST(conv_id AS bigint), 1)").alias("pair_id")).distinct()
    return ids.select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))


def listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.start, ':', s.stop)), ',')")
