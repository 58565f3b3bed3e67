"""Preference formatting: one prompt from the longest common turn prefix of two conversations, and two masked completions.

Each conversation is gathered to one row (which the output is, too), the two rows of a pair meet in one join, and the
prefix, the texts and the masks are expressions over the two arrays of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
TRAINED = "assistant"


def gather(turns: DataFrame, id_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: ``turns``, an array of (role, text) in the order of turns, ties by role and text."""
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("__t")).select(id_col, F.expr("transform(__t, t -> struct(t.role as role, t.text as text))").alias("turns"))


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('<|', t.role, '|>\n', t.text, '{CLOSE}')), '')"


def _mask(turns: str) -> str:
    """Start and end character offsets, in the rendered turns, of what a model is trained on: its text and end mark."""
    head, tail = "length(t.role) + 5", f"length(t.text) + {len(CLOSE)}"
    step = f"struct(a.upto + {head} + {tail} as upto, if(t.role = '{TRAINED}', concat(a.spans, array(struct(cast(a.upto + {head} as long) as start, cast(a.upto + {head} + {tail} as long) as end))), a.spans) as spans)"
    return f"aggregate({turns}, struct(0 as upto, cast(array() as array<struct<start: bigint, end: bigint>>) as spans), (a, t) -> {step}, a -> a.spans)"


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """``id_col``, ``prompt_turns``, ``prompt``, ``chosen``, ``rejected``, ``chosen_mask``, ``rejected_mask``.

    ``chosen_col`` and ``rejected_col`` are arrays of (role, text). Turns are common if role and text are equal. A
    completion may be empty (one conversation begins the other, or both are equal), a prompt too. A null array counts as
    empty; null roles are ``unknown`` and null texts empty if the arrays come from ``gather``. Repeated pairs give
    repeated rows; other columns are left out.
    """
    none = F.expr("cast(array() as array<struct<role: string, text: string>>)")
    both = pairs.select(id_col, F.coalesce(chosen_col, none).alias("__c"), F.coalesce(rejected_col, none).alias("__r"))
    differ = "filter(transform(__c, (t, i) -> if(i < size(__r) and t <=> get(__r, i), -1, i)), x -> x >= 0)"
    both = both.withColumn("__n", F.expr(f"coalesce(get({differ}, 0), size(__c))"))
    both = both.withColumns({"__p": F.expr("slice(__c, 1, __n)"), "__c": F.expr("slice(__c, __n + 1, size(__c))"), "__r": F.expr("slice(__r, __n + 1, size(__r))")})
    return both.select(id_col, F.col("__n").alias("prompt_turns"), *[F.expr(_rendered(t)).alias(c) for t, c in (("__p", "prompt"), ("__c", "chosen"), ("__r", "rejected"))], F.expr(_mask("__c")).alias("chosen_mask"), F.expr(_mask("__r")).alias("rejected_mask"))


#: Ids of a range are ordered in one task; what follows a range is found from the smallest id of each.
ID_RANGE = 100_000


def next_ids(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col`` and ``next_id``: each distinct id (integer, not null) and the one that follows it; the first follows the last."""
    ids = rows.select(F.col(id_col).cast("long").alias(id_col)).distinct().withColumn("__range", F.expr(f"{id_col} div {ID_RANGE}"))
    inside = ids.withColumn("__next", F.lead(id_col).over(Window.partitionBy("__range").orderBy(id_col)))
    ranges = ids.groupBy("__range").agg(F.min(id_col).alias("__first"))  # a row for each range of ids
    after = ranges.select("__range", F.coalesce(F.lead("__first").over(Window.orderBy("__first")), F.min("__first").over(Window.partitionBy())).alias("__after"))
    return inside.join(after, "__range").select(id_col, F.coalesce("__next", "__after").alias("next_id"))


def reply_pairs(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Weak preference pairs ``pair_id, chosen, rejected``: a conversation up to its last reply, and the same with a worse end.

    The end comes from the next conversation that has a reply (the first follows the last). With an even id it is that
    conversation's last reply in the place of the own one. With an odd id the two part in the middle: after half of the
    turns before the last reply the other conversation goes on in the place of this one, up to its last reply (that reply
    alone, if it is no longer than that). ``conversations`` comes from ``gather``, with integer ids. Conversations without
    a reply, and one that is the only one with a reply, give no pair.
    """
    last = F.expr(f"array_max(transform(turns, (t, i) -> if(t.role = '{TRAINED}', i + 1, 0)))")
    known = conversations.select(F.col(id_col).cast("long").alias(id_col), "turns").withColumn("__last", last).where("__last > 0")
    others = known.select(F.col(id_col).alias("next_id"), F.expr("slice(turns, 1, __last)").alias("__other"))
    met = known.join(next_ids(known, id_col), id_col).where(F.col(id_col) != F.col("next_id")).join(others, "next_id")
    met = met.withColumn("__kept", F.expr(f"if({id_col} % 2 = 0, __last - 1, (__last - 1) div 2)").cast("int"))
    end = f"if({id_col} % 2 = 0 or size(__other) <= __kept, slice(__other, -1, 1), slice(__other, __kept + 1, size(__other)))"
    return met.select(F.col(id_col).alias("pair_id"), F.expr("slice(turns, 1, __last)").alias("chosen"), F.expr(f"concat(slice(turns, 1, __kept), {end})").alias("rejected"))
