"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source's documents are shuffled by a seeded hash and served again and again, at most ``max_repeat``
times. A served copy's virtual finish time is the source's tokens served up to and with it, divided by the
source's target; all copies are put in order of finish time and the order is cut at the total budget. In equal
spans of virtual time each source serves in proportion to its target, so any prefix of the mix is balanced.

Running sums are taken in levels (sums of groups of hash slices, of slices, then inside a slice), so a source with a
third of all rows is spread over many tasks. The global order is by spans of virtual time, which hold about equal
numbers of tokens by construction; their running sum has two levels, too. Rows alike in doc_id, source and text
are counted first and numbered, so copies of one row are shuffled to places of their own.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size
0 are never taken (``taken`` 0); repeated rows are served each on its own; an empty table gives an empty
result; all further columns are ignored (``mix``) or carried (``mixed_rows``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm.common import SPACE, nested, row_keys, same, sums_before, unnested
from pointspark.shared import discard, materialize

WEIGHTS = (5, 2, 1)


def word_count(text: str = "text"):
    """Number of words of a text; null has none."""
    gaps = F.split(F.col(text), SPACE)
    ends = F.when(F.col(text).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(F.col(text).rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    inner = F.size(gaps) - ends
    return F.when(F.col(text).isNull() | (F.length(text) == 0) | F.col(text).rlike(r"^[\x20\x09-\x0D]+\z"), 0).otherwise(inner).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """``_source, source_size, target``: one row per source (``sizes`` has ``_source, size``).

    Sources in code-point order, null last, get the weights in turn. The budget is ``share`` times all sizes;
    no target exceeds ``max_repeat`` times its source's size and the excess goes to the others by weight.
    With sources ordered by cap / weight, the first k are capped and the rest share what is left: the common
    rate is the last one that is not below the caps before it.
    """
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("_source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    per = per.withColumn("_w", w).withColumn("_cap", cap)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = (
        per.withColumn("_total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_rate", F.when(F.col("_rest") > 0, (F.col("_total") - F.col("_capped")) / F.col("_rest")))
    )
    # the rate grows with every source rightly capped and falls with every further one
    rate = F.max(F.when(F.col("_rate") <= F.col("_cap") / F.col("_w"), F.col("_rate"))).over(whole)
    target = F.coalesce(F.least(F.col("_cap"), rate * F.col("_w")), F.col("_cap"))
    return per.select("_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2, seed: int = 0, slice_rows: int = 500, text: str = "text") -> DataFrame:
    """``_k1, _k2, doc_id, size, source_size, target, taken`` per document row; ``_k1, _k2`` identify its content."""
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("_source"), word_count(text).alias("size"), *row_keys("doc_id", "source", text))
    written = materialize(sizes.groupBy("doc_id", "_source", "size", "_k1", "_k2").agg(F.count("*").alias("_m")), "sizes")
    n = written.agg(F.sum("_m")).first()[0] or 0
    slices = max(16, -(-n // slice_rows))
    width = math.isqrt(slices)
    sizes = written.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_m"))).drop("_m")
    sizes = sizes.withColumn("_h", F.xxhash64(F.lit(seed), "_k1", "_k2", "_i")).withColumn("_slice", F.pmod(F.col("_h"), F.lit(slices)))
    targets = source_targets(sizes, weights, share, max_repeat)

    # tokens served before each slice of a source, then within the slice
    per = sizes.groupBy("_source", "_slice").agg(F.sum("size").alias("_n"))
    base = sums_before(per, ["_source"], "_slice", "_n", width).select(F.col("_source").alias("_bs"), F.col("_slice").alias("_bk"), F.col("_before").alias("_base"))
    inside = Window.partitionBy("_source", "_slice").orderBy("_h", "_k1", "_k2", "_i").rowsBetween(Window.unboundedPreceding, 0)
    run = sizes.withColumn("_in", F.sum("size").over(inside)).join(base, same("_source", "_bs") & same("_slice", "_bk"))
    targets = targets.withColumnRenamed("_source", "_ts")
    run = run.join(targets, same("_source", "_ts")).select("doc_id", "_source", "size", "_k1", "_k2", "_i", "_h", "source_size", "target", (F.col("_base") + F.col("_in")).alias("_upto"))
    run = materialize(run, "served")
    discard(written)

    # every copy has its finish time; the order of finish times is cut at the budget
    copies = run.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    finish = (F.col("_copy") * F.col("source_size") + F.col("_upto")) / F.col("target")
    copies = copies.withColumn("_finish", finish).withColumn("_span", F.floor(F.col("_finish") * F.lit(slices)).cast("long"))
    budget = F.floor(F.sum("size") * F.lit(share)).cast("long")
    spans = sums_before(copies.groupBy("_span").agg(F.sum("size").alias("_n")), [], "_span", "_n", width)
    spans = spans.crossJoin(F.broadcast(run.agg(budget.alias("_budget"))))  # one row
    spans = spans.filter("_before < _budget").select(F.col("_span").alias("_sp"), "_before", "_budget", (F.col("_before") + F.col("_n") <= F.col("_budget")).alias("_whole"))
    served = copies.join(spans, F.col("_span") == F.col("_sp"))
    order = Window.partitionBy("_span").orderBy("_finish", F.col("_source").asc_nulls_last(), "_h", "_k1", "_k2", "_i", "_copy")
    edge = served.filter("not _whole").withColumn("_at", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = served.filter("_whole").select("_k1", "_k2", "_i", "size").unionByName(edge.filter("_at <= _budget").select("_k1", "_k2", "_i", "size"))
    taken = kept.groupBy("_k1", "_k2", "_i").agg(F.sum("size").alias("_taken")).select(F.col("_k1").alias("_t1"), F.col("_k2").alias("_t2"), F.col("_i").alias("_ti"), "_taken")
    out = run.join(taken, (F.col("_k1") == F.col("_t1")) & (F.col("_k2") == F.col("_t2")) & (F.col("_i") == F.col("_ti")), "left")
    return out.select("_k1", "_k2", "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, block: int = 1000, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, all columns kept, others dropped.

    Rows alike in doc_id, source and text share what was taken of them, and one of them stands for all; more than
    ``block`` of them are made in several tasks.
    """
    text = options.get("text", "text")
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    copies = mix(docs, **options).groupBy("_k1", "_k2").agg(F.sum(times).alias("_all"), F.count("*").alias("_rows")).filter("_all > 0")
    k1, k2 = row_keys("doc_id", "source", text)
    rows = docs.select(nested(docs), k1.alias("_r1"), k2.alias("_r2")).join(copies.hint("shuffle_hash"), (F.col("_r1") == F.col("_k1")) & (F.col("_r2") == F.col("_k2")))
    lone = rows.filter("_rows = 1").select("_row", "_all")
    alike = rows.filter("_rows > 1").dropDuplicates(["_r1", "_r2"]).withColumn("_b", F.explode(F.expr(f"sequence(0, cast((_all - 1) div {block} as int))")))
    alike = alike.repartition("_r1", "_r2", "_b").select("_row", F.expr(f"least({block}, _all - _b * {block})").alias("_all"))
    return lone.unionByName(alike).withColumn("_n", F.explode(F.expr("sequence(1, cast(_all as int))"))).select(*unnested(docs))
