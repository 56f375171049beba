"""Line dedup by content-defined chunks, in DataFrame operations only.

A rolling hash over the hashes of ``window`` consecutive lines ends a chunk after a line where it is 0 modulo
``divisor`` (and at the end of the text), so an inserted or removed line moves only the boundaries next to it.
A chunk goes on while it has fewer than ``min_lines`` lines, and a shorter rest of the text belongs to the chunk
before it, so every line of a text of ``min_lines`` lines is compared. Chunks whose 128-bit hash occurs more than once are candidates; each is
compared byte for byte with the first of its hash in (doc_id, chunk) order and removed if equal. Lines are
what stands between line feeds; the other bytes of a text stay as they are.

Work on a text grows with its length: lines are hashed once, chunks are hashed over their lines' hashes, and what
is exploded are the chunks themselves, never the text beside each. Keys that hold more than a thousandth of all
chunks meet their first occurrence in a broadcast of bounded size instead of in one task.

Defined cases: a null text stays null with 0 lines, an empty one has one empty line; the first occurrence
stays, also within one document; rows alike in doc_id and text are one occurrence and come out alike; rows
with a null doc_id order last; an empty table gives an empty result. ``dedup_lines`` keeps all input columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import HEAVY, ROW, field, join_heavy, nested, row_keys, unnested
from pointspark.shared import discard, materialize

#: What the first occurrences of heavy chunks may weigh in all to be broadcast.
BROADCAST_BYTES = 32 << 20


def chunk_bounds(window: int, divisor: int, min_lines: int, lines: str = "_lines", block: int = 512) -> str:
    """SQL for the 1-based last lines of a text's chunks. Bounds are gathered in arrays of ``block``, so none is copied often."""
    rolling = f"pmod(aggregate(sequence(i - {window - 1}, i), cast(0 as bigint), (h, j) -> xxhash64(h, {lines}[j - 1])), {divisor}) = 0"
    found = f"filter(sequence(1, size({lines})), i -> i < size({lines}) and i >= {window} and {rolling})"
    step = f"if(i - x.last >= {min_lines}, struct(i as last, concat(x.own, array(i)) as own), x)"
    own = f"aggregate(b, struct(a.last as last, cast(array() as array<int>) as own), (x, i) -> {step}, x -> struct(x.last as last, concat(a.parts, array(x.own)) as parts))"
    parts = f"transform(sequence(0, size(f) div {block}), k -> slice(f, k * {block} + 1, {block}))"
    kept = f"aggregate({parts}, struct(0 as last, cast(array() as array<array<int>>) as parts), (a, b) -> {own}, a -> flatten(a.parts))"
    # a rest of the text that is too short belongs to the chunk before it
    ends = f"concat(if(size(a) > 0 and size({lines}) - element_at(a, -1) < {min_lines}, slice(a, 1, size(a) - 1), a), array(size({lines})))"
    return f"transform(transform(array({found}), f -> {kept}), a -> {ends})[0]"


def dedup_lines(docs: DataFrame, window: int = 2, divisor: int = 4, min_lines: int = 2, text: str = "text") -> DataFrame:
    """``docs`` with repeated multi-line chunks taken out of ``text``, and ``n_lines``, ``n_removed`` added (or replaced)."""
    out = cleaned_lines(docs, window, divisor, min_lines, text)
    return out.select(*unnested(docs, text, "n_lines", "n_removed"), F.col("_cleaned").alias(text), F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


def cleaned_lines(docs: DataFrame, window: int = 2, divisor: int = 4, min_lines: int = 2, text: str = "text") -> DataFrame:
    """``_row`` (a row of ``docs``), ``_cleaned`` (its text without repeated chunks), ``_n_lines``, ``_n_removed``."""
    k1, k2 = row_keys("doc_id", text)
    keyed = docs.select("doc_id", F.col(text).alias("_text"), k1, k2)
    # line hashes once per line; the rolling hash and the chunks' hashes read them
    hashed = keyed.filter(F.col("_text").isNotNull()).select("doc_id", "_k1", "_k2", F.split("_text", "\n", -1).alias("_lines"))
    hashed = hashed.select("doc_id", "_k1", "_k2", F.expr("transform(_lines, x -> xxhash64(x))").alias("_h"), F.expr("transform(_lines, x -> xxhash64(1, x))").alias("_g"))
    hashed = hashed.filter(F.size("_h") >= min_lines).withColumn("_ends", F.expr(chunk_bounds(window, divisor, min_lines, "_h")))
    spans = "transform(_ends, (e, k) -> struct(k as k, if(k = 0, 1, _ends[k - 1] + 1) as s, e as e))"
    spans = f"transform({spans}, c -> struct(c.k as k, c.s as s, c.e as e, xxhash64(1, slice(_h, c.s, c.e - c.s + 1)) as _c1, xxhash64(2, slice(_g, c.s, c.e - c.s + 1)) as _c2))"
    chunks = materialize(hashed.select("doc_id", "_k1", "_k2", F.explode(F.expr(spans)).alias("c")).select("doc_id", "_k1", "_k2", "c.*"), "chunks")

    # rows alike in doc_id and text count once, so the occurrences are told apart by content key and place
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k1", "_k2", "k")
    firsts = chunks.groupBy("_c1", "_c2").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_n")).filter("_first <> _last or (_first.z and not _first <=> _last)")
    firsts = materialize(firsts.select(F.col("_c1").alias("_f1"), F.col("_c2").alias("_f2"), "_first", "_n"), "firsts")
    on = [("_c1", "_f1"), ("_c2", "_f2")]
    total = chunks.count()
    is_first = (F.col("_first._k1") == F.col("_k1")) & (F.col("_first._k2") == F.col("_k2")) & (F.col("_first.k") == F.col("k"))
    found = join_heavy(chunks, firsts, on, "_n", total).select("_k1", "_k2", "s", "e", "_c1", "_c2", "_n", is_first.alias("_is_first"))
    found = materialize(found, "repeats")
    discard(chunks, firsts)

    # texts of the repeated chunks only, for the comparison
    per_doc = found.groupBy(F.col("_k1").alias("_d1"), F.col("_k2").alias("_d2")).agg(F.collect_set(F.struct("s", "e", "_c1", "_c2", "_n", "_is_first")).alias("_cs"))
    on_doc = (F.col("_k1") == F.col("_d1")) & (F.col("_k2") == F.col("_d2"))
    bodies = keyed.select("_k1", "_k2", "_text").join(per_doc.hint("shuffle_hash"), on_doc).withColumn("_lines", F.split("_text", "\n", -1))
    body = "transform(_cs, c -> struct(c.s as s, c.e as e, c._c1 as _c1, c._c2 as _c2, c._n as _n, c._is_first as _is_first, cast(array_join(slice(_lines, c.s, c.e - c.s + 1), '\\n') as binary) as _b))"
    bodies = materialize(bodies.select("_k1", "_k2", F.explode(F.expr(body)).alias("c")).select("_k1", "_k2", "c.*"), "bodies")
    discard(found)
    kept = bodies.filter("_is_first").dropDuplicates(["_c1", "_c2"]).select(F.col("_c1").alias("_f1"), F.col("_c2").alias("_f2"), F.col("_b").alias("_fb"), F.col("_n").alias("_fn"))
    kept = materialize(kept, "kept")
    others = bodies.filter("not _is_first")
    heavy = F.col("_fn") * HEAVY > total
    if (kept.filter(heavy).agg(F.sum(F.length("_fb"))).first()[0] or 0) <= BROADCAST_BYTES:
        compared = join_heavy(others, kept, on, "_fn", total)
    else:  # heavy chunks of unusual length: AQE splits the join
        compared = others.join(kept, [F.col(a) == F.col(b) for a, b in on])
    removed = compared.filter(F.col("_b") == F.col("_fb")).groupBy(F.col("_k1").alias("_d1"), F.col("_k2").alias("_d2")).agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("_cut"))

    own = docs.select(nested(docs), k1, k2).join(removed.hint("shuffle_hash"), on_doc, "left")
    gone = F.expr("aggregate(_cut, 0, (n, c) -> n + c.e - c.s + 1)")
    own = own.withColumn("_l", F.when(F.col("_cut").isNotNull(), F.split(field(text), "\n", -1)))
    # what lies between the cut spans
    spared = "concat(transform(_cut, (c, i) -> slice(_l, if(i = 0, 1, _cut[i - 1].e + 1), c.s - if(i = 0, 1, _cut[i - 1].e + 1))), array(slice(_l, element_at(_cut, -1).e + 1, size(_l))))"
    cleaned = F.when(F.col("_cut").isNull(), field(text)).otherwise(F.expr(f"array_join(flatten({spared}), '\\n')"))
    n_lines = F.when(field(text).isNull(), 0).otherwise(F.length(field(text)) - F.length(F.translate(field(text), "\n", "")) + 1)
    return own.select(ROW, cleaned.alias("_cleaned"), n_lines.cast("long").alias("_n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("_n_removed"))
