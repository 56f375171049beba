"""Substring dedup by sliding sentence spans.

A text is cut into sentences that together are the whole text: each runs to and with its end marks (. ! ? or a
line feed) and the white space after them. Runs of consecutive sentences are hashed over their normalised words
(A-Z lower-cased, white space collapsed): from each sentence on, and back from each sentence, the shortest run
that has ``span`` sentences and ``min_words`` words at least, since shorter ones meet by chance where a text has
short sentences. A passage that holds such a run is covered by its runs from end to end. Runs whose
128-bit hash occurs elsewhere are repeated; the first in (doc_id, place) order stays and the sentences under all
others are removed.

The first shuffle counts one 64-bit hash, pre-aggregated in each task; the second moves only identifiers of
runs; texts move once, to be cut. No pair of documents is ever made.

Defined cases: a null text stays null with 0 sentences; a text of fewer than ``span`` sentences
or ``min_words`` words is never cut;
rows alike in doc_id and text are one document and come out alike; rows with a null doc_id order last; runs
repeated within one document count as repeated; an empty table gives an empty result. All input columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import LOWER, UPPER, field, nested, row_keys, unnested
from pointspark.shared import discard, materialize

SENTENCE = r"[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+"


def sentences(text):
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def _windows(span: int, min_words: int) -> str:
    """SQL for the runs of a text: from each start the shortest that is long enough, and the same back from each end.

    Only a text's first sentence can be without words, so ``min_words`` further sentences are enough. A run is the
    number start * 2^32 + end, as sets of numbers are hashed.
    """
    more, n = span + min_words, "size(_h)"
    words = "aggregate(slice(_w, {}, {}), 0, (a, w) -> a + w)".format
    enough = f"a.n >= {span} and a.s >= {min_words}"
    # sentences of the shortest run that begins a list of counts
    taken = f"aggregate({{}}, struct(0 as s, 0 as n), (a, w) -> if({enough}, a, struct(a.s + w as s, a.n + 1 as n)), a -> if({enough}, a.n, null))".format
    forward = f"if({words('i', span)} >= {min_words}, i + {span - 1}, i - 1 + {taken(f'slice(_w, i, {more})')})"
    back = f"if({words(f'j - {span - 1}', span)} >= {min_words}, j - {span - 1}, j + 1 - {taken(f'reverse(slice(_w, greatest(j - {more - 1}, 1), least(j, {more})))')})"
    forward = f"transform(sequence(1, {n} - {span - 1}), i -> shiftleft(cast(i as bigint), 32) + {forward})"
    back = f"transform(sequence({span}, {n}), j -> shiftleft(cast({back} as bigint), 32) + j)"
    runs = f"filter(array_union({forward}, {back}), r -> r is not null)"
    return f"if({n} < {span}, cast(array() as array<bigint>), {runs})"


def remove_repeats(docs: DataFrame, span: int = 2, min_words: int = 20, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; adds ``n_sentences``, ``n_removed`` and ``removed``.

    ``removed`` lists the 0-based, half-open runs of sentences taken out.
    """
    k1, k2 = row_keys("doc_id", text)
    keyed = docs.filter(F.col(text).isNotNull()).select("doc_id", k1, k2, F.translate(F.regexp_replace(F.col(text), r"[\x20\x09\x0B-\x0D]+", " "), UPPER, LOWER).alias("_n"))
    sents = keyed.withColumn("_s", F.transform(sentences("_n"), lambda x: F.trim(F.translate(x, "\n", " "))))
    hashed = sents.select("doc_id", "_k1", "_k2", F.transform("_s", lambda x: F.xxhash64(F.lit(1), x)).alias("_h"), F.transform("_s", lambda x: F.xxhash64(F.lit(2), x)).alias("_g"), F.transform("_s", lambda x: F.length(x) - F.length(F.translate(x, " ", "")) + F.when(x == "", 0).otherwise(1)).alias("_w"))
    runs = hashed.withColumn("_r", F.expr(_windows(span, min_words)))
    runs = runs.select("doc_id", "_k1", "_k2", F.explode(F.expr("transform(_r, r -> struct(cast(shiftright(r, 32) as int) as i, cast(r & 4294967295 as int) as e, xxhash64(1, slice(_h, cast(shiftright(r, 32) as int), cast((r & 4294967295) - shiftright(r, 32) + 1 as int))) as h, xxhash64(2, slice(_g, cast(shiftright(r, 32) as int), cast((r & 4294967295) - shiftright(r, 32) + 1 as int))) as g))")).alias("w"))
    runs = runs.select("doc_id", "_k1", "_k2", "w.i", "w.e", "w.h", "w.g")
    runs = materialize(runs, "runs")
    often = runs.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("h").alias("_h"))
    often = materialize(often, "often")
    again = materialize(runs.join(often, F.col("h") == F.col("_h")).drop("_h"), "again")
    discard(runs, often)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k1", "_k2", "i")
    firsts = again.groupBy("h", "g").agg(F.min(place).alias("_first")).select(F.col("h").alias("_h"), F.col("g").alias("_g"), "_first")
    firsts = materialize(firsts, "firsts")
    is_first = (F.col("_first._k1") == F.col("_k1")) & (F.col("_first._k2") == F.col("_k2")) & (F.col("_first.i") == F.col("i"))
    cut = again.join(firsts, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).filter(~is_first)
    cut = cut.groupBy(F.col("_k1").alias("_d1"), F.col("_k2").alias("_d2")).agg(F.array_sort(F.collect_set(F.struct("i", "e"))).alias("_at"))
    own = docs.select(nested(docs), k1, k2).join(cut.hint("shuffle_hash"), (F.col("_k1") == F.col("_d1")) & (F.col("_k2") == F.col("_d2")), "left")
    # repeated runs, merged into disjoint half-open runs of sentences
    merged = """aggregate(_at, cast(array() as array<struct<start:int,end:int>>), (a, r) ->
        if(size(a) > 0 and element_at(a, -1).end >= r.i - 1,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, r.e) as end))),
           concat(a, array(struct(r.i - 1 as start, r.e as end)))))"""
    own = own.withColumn("_cut", F.coalesce(F.expr(merged), F.expr("cast(array() as array<struct<start:int,end:int>>)")))
    own = own.withColumn("_s", sentences(field(text)))
    spared = "concat(transform(_cut, (c, k) -> slice(_s, if(k = 0, 0, _cut[k - 1].end) + 1, c.start - if(k = 0, 0, _cut[k - 1].end))), array(slice(_s, element_at(_cut, -1).end + 1, size(_s))))"
    cleaned = F.when(F.size("_cut") == 0, field(text)).otherwise(F.expr(f"array_join(flatten({spared}), '')"))
    n_removed = F.aggregate("_cut", F.lit(0), lambda n, c: n + c.end - c.start)
    return own.select(*unnested(docs, text, "n_sentences", "n_removed", "removed"), cleaned.alias(text), F.greatest(F.size("_s"), F.lit(0)).cast("long").alias("n_sentences"), n_removed.cast("long").alias("n_removed"), F.col("_cut").alias("removed"))
