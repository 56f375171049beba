"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

The longest common prefix of two conversations' turns (equal role and text, turn by turn) is rendered once as
the prompt; what follows is rendered as two completions. A completion's mask lists the character spans, [start,
end), that a loss counts: the text of assistant turns with the turn's end mark.

Defined cases: turns order by (turn, role, text), so repeated turn numbers have a fixed order; a null role or
text renders as the empty string and equals only null; null turn numbers come first; rows with a null
conversation are dropped; a pair of which one side has no turns gives an empty prompt and an empty completion on that side; equal
conversations give two empty completions; an empty table gives no pairs; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{BEGIN}', coalesce(t.role, ''), '\\n', coalesce(t.text, ''), '{END}')), '')"


def _mask(turns: str) -> str:
    head, tail = len(BEGIN) + 1, len(END)
    size = f"({head} + length(coalesce(t.role, '')) + length(coalesce(t.text, '')) + {tail})"
    step = f"""aggregate({turns}, struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as spans), (a, t) -> struct(a.at + {size} as at,
        if(t.role = 'assistant', concat(a.spans, array(struct(a.at + {head} + length(t.role) as start, a.at + {size} - 1 as end))), a.spans) as spans))"""
    return f"{step}.spans"


def _turn() -> Column:
    return F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair from ``pair_id, chosen (boolean), turn, role, text``: prompt, completions and masks."""
    rows = turns.filter("pair_id is not null and chosen is not null").select("pair_id", "chosen", _turn().alias("t"))
    sides = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), F.col("t")))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.col("t")))).alias("r"),
    )
    return format_sides(sides)


def format_sides(sides: DataFrame) -> DataFrame:
    """``preference_pairs`` of ``pair_id, c, r``: the turns of either side in order."""
    same = "zip_with(c, r, (a, b) -> a is not null and b is not null and a.role <=> b.role and a.text <=> b.text)"
    common = F.expr(f"cast(if(array_position({same}, false) = 0, size(c), array_position({same}, false) - 1) as int)")
    cut = sides.withColumn("n_common", common)
    for side in "cr":
        cut = cut.withColumn(f"{side}_rest", F.expr(f"slice({side}, n_common + 1, size({side}))"))
    return cut.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        F.size("c").cast("long").alias("n_chosen"),
        F.size("r").cast("long").alias("n_rejected"),
        F.expr(_render("slice(c, 1, n_common)")).alias("prompt"),
        F.expr(_render("c_rest")).alias("chosen"),
        F.expr(_render("r_rest")).alias("rejected"),
        F.expr(_mask("c_rest")).alias("chosen_mask"),
        F.expr(_mask("r_rest")).alias("rejected_mask"),
    )


def answers_swapped(conversations: DataFrame) -> DataFrame:
    """``pair_id, c, r`` for each conversation: itself as chosen, and itself with another last answer as rejected.

    The other answer is the last assistant turn's text of the conversation with the next identifier or, where that
    has none, of the first conversation that has one. A conversation without an assistant turn has equal sides.
    """
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), _turn().alias("t"))
    whole = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias("c"))
    whole = whole.withColumn("_last", F.expr("array_max(transform(c, (t, i) -> if(t.role = 'assistant', i, null)))"))
    answers = turns.filter("t.role = 'assistant'").groupBy("pair_id").agg(F.max("t").alias("t")).select((F.col("pair_id") - 1).alias("_of"), F.struct(F.col("t.text").alias("text")).alias("_next"))
    first = answers.agg(F.min_by("_next", "_of").alias("_first"))  # one row
    swapped = whole.join(answers, F.col("pair_id") == F.col("_of"), "left").crossJoin(F.broadcast(first))
    rejected = "transform(c, (t, i) -> if(i <=> _last, struct(t.turn as turn, t.role as role, coalesce(_next, _first).text as text), t))"
    return swapped.select("pair_id", "c", F.expr(rejected).alias("r"))
