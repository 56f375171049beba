"""N-gram Jaccard self-join with several global token orders, up to connected components.

Texts of Jaccard similarity of at least ``percent`` / 100 over their sets of ``k``-word shingles are linked.
Two such sets share, under any global order of shingles, one of the first |x| - ceil(t |x|) + 1. All orders begin
with shingles of one document, which meet nothing, and go by frequency, the first by counts as far as they are
known, the further ones by their magnitude; ties go by a hash of each order's own. The first order's prefixes are
indexed and make the candidates; a candidate must share a prefix shingle under every further order, too. These
filters, and one on signatures, are intersected on short arrays before anything long is moved. What passes is
verified on the sets of 64-bit shingle hashes, without the shingles of one document, which cannot be common.

Frequencies are kept in tables of fixed size (``bits``, ``entries``) that are broadcast. An order may be any
function of the shingle, so a table too small for a corpus costs candidates, never links.

Texts with equal sets are one class from the start. In a posting list only pairs with a few pivots are made at
first; linked texts are merged, and once little is left, the remaining pairs across components are compared, of
which each has a member outside of the list's largest component. So a group of thousands of near copies that link
costs pairs in proportion to its size, and no link is lost.

Defined cases: a null or wordless text has an empty set and links with nothing; a text of fewer than ``k``
words is one shingle; repeated rows share a class; rows with one doc_id count as one document in links; rows
with a null doc_id get a null component_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import ROW, mix, nested, release, row_keys, shingle_set, small_batches, unnested
from pointspark.operators.components import connected_components
from pointspark.shared import discard, materialize

#: Salts of the further orders.
ORDERS = (11, 23)
#: Up to so many pairs, their identifiers are broadcast (16 bytes a pair) to leave out other classes' arrays.
BROADCAST_PAIRS = 500_000


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set it is linked to."""
    return -(-n * percent // 100)


def prefix_size(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1 if n else 0


def signature(s: np.ndarray, longs: int = 48) -> np.ndarray:
    """Which of 64 * longs slots hold a shingle. Two sets differ in at least as many shingles as signatures in bits."""
    bits = np.zeros(64 * longs, np.uint8)
    bits[(mix(s, 41) % np.uint64(64 * longs)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def prefix(shared: np.ndarray, freq: np.ndarray, size: int, salt: int) -> np.ndarray:
    """The first ``size`` of a set's shingles that other documents hold, by frequency ``freq`` and then a hash."""
    return shared[np.lexsort((mix(shared, salt), freq))[:size]] if size < len(shared) else shared


def _frequencies(docs: DataFrame, k: int, bits: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the first order knows of frequencies, of fixed size: a bitmap of 2^bits slots in which every shingle
    of two documents or more is marked, and the most frequent shingles' 40-bit prefixes, sorted, with counts.

    Each task sends its distinct shingles, as 40-bit prefixes sorted and delta-coded, to the task of their range
    (about 2.5 bytes each); a prefix that is met twice is marked. Prefixes that collide only mark too much.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = 1 << min(bits - 3, max(6, (2 * docs.rdd.getNumPartitions()).bit_length()))
    shift = 64 - (ranges.bit_length() - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        wait, waiting, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            u = np.concatenate(wait)
            u.sort()
            edges = np.searchsorted(u, np.arange(ranges, dtype=np.uint64) << np.uint64(shift))
            out = []
            for r, own in enumerate(np.split(u >> np.uint64(24), edges[1:])):
                if len(own):
                    # three of a kind say no more here than two
                    own = own[np.concatenate(([True, True], own[2:] != own[:-2]))[: len(own)]]
                    gaps = np.diff(own, prepend=np.uint64(0))
                    out.append((r, zstd.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())))
            return pa.RecordBatch.from_pydict({"r": pa.array([r for r, _ in out], pa.int32()), "b": pa.array([b for _, b in out], pa.binary())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, k)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest in seen:  # equal sets are one class
                    continue
                if len(seen) < 200_000:
                    seen.add(digest)
                wait.append(s)
                waiting += len(s)
            if waiting > 2_000_000:
                yield flush()
                wait, waiting = [], 0
        if waiting:
            yield flush()
        wait, seen = [], set()
        release()

    def meet(group: pa.Table) -> pa.Table:
        zstd = zstandard.ZstdDecompressor()
        parts = [np.cumsum(np.frombuffer(zstd.decompress(b), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64) for b in group.column("b").to_pylist()]
        code, n = np.unique(np.concatenate(parts), return_counts=True)
        code, n = code[n > 1], n[n > 1]
        r, slots = group.column("r")[0].as_py(), (1 << bits) // ranges
        marks = np.zeros(slots, np.uint8)
        marks[(code >> np.uint64(40 - bits)).astype(np.int64) - r * slots] = 1
        top = np.argsort(-n, kind="stable")[: entries // ranges]
        top = np.sort(top[n[top] > 2])
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.table({"r": pa.array([r], pa.int32()), "marks": pa.array([pack(np.packbits(marks).tobytes())], pa.binary()), "code": pa.array([code[top].tobytes()], pa.binary()), "n": pa.array([n[top].astype(np.uint32).tobytes()], pa.binary())})

    sent = docs.select("_text").mapInArrow(send, "r int, b binary")
    rows = sorted(sent.groupBy("r").applyInArrow(meet, "r int, marks binary, code binary, n binary").collect(), key=lambda x: x["r"])  # of fixed size in all
    bitmap, unpack = np.zeros((1 << bits) // 8, np.uint8), zstandard.ZstdDecompressor().decompress
    step = len(bitmap) // ranges
    for x in rows:
        bitmap[x["r"] * step : (x["r"] + 1) * step] = np.frombuffer(unpack(x["marks"]), np.uint8)
    code, n = (np.concatenate([np.frombuffer(x[c], kind) for x in rows] or [np.empty(0, kind)]) for c, kind in (("code", np.uint64), ("n", np.uint32)))
    return bitmap, code, n


#: Columns of features: the indexed prefix, the prefixes of further orders, a short and a longer signature, and the shingles of two documents or more.
_ARRAYS = {"pre": np.int64, **{f"pre{i}": np.int32 for i in range(len(ORDERS))}, "mini": np.int64, "sig": np.int64, "shared": np.int64}


def features(docs: DataFrame, k: int, percent: int, bits: int, entries: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2`` (size and digest of the set) and ``_ARRAYS``, empty where no other document can be near.

    Prefixes of further orders are 32-bit hashes of shingles, which only test for a common one.
    """
    table = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, k, bits, entries))

    def one(text: str | None) -> tuple:
        bitmap, codes, counts = table.value
        s = shingle_set(text, k)
        n, p = len(s), prefix_size(len(s), percent)
        if not n:
            return 0, 0, 0, *[s] * len(_ARRAYS)
        d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
        slot = s >> np.uint64(64 - bits)
        shared = s[(bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        p -= n - len(shared)  # shingles of one document come first and meet nothing
        if p <= 0:
            return n, int(d1), int(d2), *[shared[:0]] * len(_ARRAYS)
        freq = np.zeros(len(shared), np.int64)
        if len(codes):
            own = shared >> np.uint64(24)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            freq = np.where(codes[at] == own, counts[at], 0)
        further = [(mix(prefix(shared, np.log2(freq + 1).astype(np.int64), p, salt), 7) >> np.uint64(32)).astype(np.uint32) for salt in ORDERS]
        return n, int(d1), int(d2), prefix(shared, freq, p, 5), *further, signature(s, 16), signature(s), shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = [one(x) for x in part.column(1).to_pylist()]
                cols = [part.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))]
                for i, kind in enumerate(_ARRAYS.values(), 3):
                    flat = np.concatenate([r[i].astype(np.uint64 if kind is np.int64 else np.uint32) for r in rows]).view(kind)
                    ends = np.cumsum([0, *(len(r[i]) for r in rows)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "d1", "d2", *_ARRAYS])
        release()

    arrays = ", ".join(f"{c} array<{'long' if kind is np.int64 else 'int'}>" for c, kind in _ARRAYS.items())
    found = materialize(docs.select("doc_id", "_text").mapInArrow(run, f"doc_id long, n_shingles long, d1 long, d2 long, {arrays}"), "features")
    table.destroy()
    return found


def _with_sides(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """``pairs`` (a written frame) with the columns of their classes, ``x`` by ``a`` and ``y`` by ``b``.

    A list of pairs of checked size is broadcast, so only the pairs with one side's columns, and of the other side only what
    occurs in them, are shuffled; else all goes on to two joins.
    """
    pairs = pairs.select("a", "b")
    if pairs.count() > BROADCAST_PAIRS:
        return pairs.join(y, "b").join(x, "a")
    y = y.join(F.broadcast(pairs.select(F.col("b").alias("_i"))), F.col("b") == F.col("_i"), "left_semi")
    return x.join(F.broadcast(pairs), "a").join(y, "b")


def _differ(a: str, b: str, sizes: str, percent: int) -> str:
    """SQL: two signatures differ in few enough bits for sets of these ``sizes`` in all."""
    return f"{100 + percent} * aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {100 - percent} * ({sizes})"


def surviving(pairs: DataFrame, classes: DataFrame, percent: int, orders: int = len(ORDERS), signatures: bool = True) -> DataFrame:
    """The pairs ``a, b`` (a written frame) that sizes, the first ``orders`` further orders and signatures allow, by short arrays alone."""
    cols = ["n", *["sig"] * signatures, *(f"pre{i}" for i in range(orders))]
    x, y = (classes.select(F.col("doc_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in "ab")
    both = _with_sides(pairs, x, y)
    both = both.filter(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    if signatures:
        both = both.filter(_differ("a_sig", "b_sig", "a_n + b_n", percent))
    for i in range(orders):
        both = both.filter(F.arrays_overlap(f"a_pre{i}", f"b_pre{i}"))
    return both.select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` (a written frame) whose sets are linked."""
    x, y = (classes.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("shared").alias(f"{c}_s")) for c in "ab")
    both = _with_sides(pairs, x, y).withColumn("_in", F.size(F.array_intersect("a_s", "b_s")).cast("long"))
    return both.filter(f"100 * _in >= {percent} * (a_n + b_n - _in)").select("a", "b")


def _classes(docs: DataFrame, k: int, percent: int, bits: int, entries: int, rounds: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Features of every row, and ``id, component`` for every class representative that is linked."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    found = features(docs, k, percent, bits, entries)
    classes = found.filter("size(pre) > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), *_ARRAYS)).alias("r"))
    classes = materialize(classes.select("r.*"), "classes")
    rows = materialize(found.select("doc_id", "n_shingles", "d1", "d2"), "rows")
    discard(found)
    every = classes.select(F.explode("pre").alias("token"), F.col("doc_id").alias("rep"), "n")
    often = materialize(every.groupBy("token").agg(F.count("*").alias("_c")).filter("_c > 1").select(F.col("token").alias("_t")), "often")
    posts = materialize(every.join(often, F.col("token") == F.col("_t")).drop("_t"), "postings")
    discard(often)
    size = posts.count()

    done, components = None, spark.createDataFrame([], "id long, component long")

    def extend(pairs: DataFrame) -> bool:
        """Compare new pairs; whether there was a new link."""
        nonlocal done, components
        new = pairs.distinct()
        if done is not None:
            new = new.join(done, ["a", "b"], "left_anti")
        new = materialize(new, "pairs")
        done = new if done is None else done.unionByName(new)
        near = materialize(surviving(new, classes, percent), "survivors")
        found = materialize(verified(near, classes, percent), "links")
        discard(near)
        if found.isEmpty():
            return False
        # components so far are links of a node each, so no pair is read again
        last, edges = components, found.unionByName(components.select(F.col("id").alias("a"), F.col("component").alias("b")))
        components = materialize(connected_components(edges, "a", "b"), "components")
        discard(last, found)
        return True

    def across(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings with their component, of lists that hold more than one (a list that holds one will never hold more), and each list's ``_main`` (its largest component), ``_all`` and ``_few`` (members, and those outside of that)."""
        named = lists.select("token", "rep", "n").join(components, F.col("rep") == F.col("id"), "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        named = materialize(named, "named")
        sizes = named.groupBy("token", "comp").agg(F.count("*").alias("_c"))
        main = sizes.groupBy("token").agg(F.max(F.struct("_c", "comp")).alias("m"), F.sum("_c").alias("_all"))
        main = main.select(F.col("token").alias("_t"), F.col("m.comp").alias("_main"), F.col("_all"), (F.col("_all") - F.col("m._c")).alias("_few"))
        main = materialize(main.filter("_few > 0"), "main")
        out = materialize(named.join(main.select("_t"), F.col("token") == F.col("_t")).drop("_t"), "across")
        discard(named, lists)
        return out, main

    def pair(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    near = f"100 * least(n, _pn) >= {percent} * greatest(n, _pn)"
    named, main, before = posts.withColumn("comp", F.col("rep")), None, float("inf")  # not written, so never discarded here
    for turn in range(rounds):
        # three pivots of each list, chosen by hashes, and every member's pair with each
        pivots = named.groupBy("token").agg(F.array(*[F.min(F.struct(F.xxhash64(F.lit(3 * turn + i), "rep").alias("h"), "rep", "n", "comp")) for i in range(3)]).alias("p"))
        pivots = materialize(pivots.select(F.col("token").alias("_t"), F.explode(F.array_distinct(F.transform("p", lambda x: F.struct(x.rep.alias("_pr"), x.n.alias("_pn"), x.comp.alias("_pc"))))).alias("x")).select("_t", "x.*"), "pivots")
        linked_more = extend(named.join(pivots, (F.col("token") == F.col("_t")) & F.expr(f"comp <> _pc and {near}")).select(*pair("rep", "_pr")))
        discard(pivots)
        if linked_more or not turn:
            discard(main)
            named, main = across(named)
        # more pivots while the pairs that would be left are many beside the postings and grow fewer
        left = main.agg(F.sum(F.col("_all") * F.col("_few"))).first()[0] or 0
        if left <= 2 * size or left > before / 2:
            break
        before = left

    # what is left: pairs across components, one side outside of the list's largest component. A pair is made at
    # the first list that both are in, as far as the first 8 lists of each tell, and only if their short signatures allow it
    marks = classes.select(F.col("doc_id").alias("_id"), F.col("mini").alias("s"), F.slice(F.array_sort("pre"), 1, 8).alias("t"))
    named = materialize(named.join(marks, F.col("rep") == F.col("_id")).drop("_id"), "marked")
    few = named.join(main, F.col("token") == F.col("_t")).filter("comp <> _main")
    few = few.select(F.col("token").alias("_t"), F.col("rep").alias("_pr"), F.col("n").alias("_pn"), F.col("comp").alias("_pc"), "_main", F.col("s").alias("_ps"), F.col("t").alias("_pt"))
    first = "coalesce(array_min(array_intersect(t, _pt)) >= token, true)"
    few = materialize(few, "few")
    rest = named.join(few, (F.col("token") == F.col("_t")) & F.expr(f"comp <> _pc and (comp = _main or rep < _pr) and {near} and {_differ('s', '_ps', 'n + _pn', percent)} and {first}"))
    extend(rest.select(*pair("rep", "_pr")))
    discard(named, few, main, posts, classes, done)
    return rows, components


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 75, bits: int = 28, entries: int = 1 << 21, rounds: int = 6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    rows, components = _classes(docs, k, percent, bits, entries, rounds, text, doc_id)
    reps = rows.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    named = reps.join(components, F.col("rep") == F.col("id"), "left").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.coalesce("component", "rep").alias("_c"))
    named = materialize(named, "class-components")  # a plain join of two shuffles, which AQE can split where a third of all rows are copies
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(named, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose document has a smaller one in its component; one row of each repeated document.

    A document is an identifier with its text, so rows of one identifier and other texts are apart.
    """
    keys = row_keys(doc_id, text)
    own = docs.filter(F.col(doc_id).isNotNull()).select(nested(docs), F.col(doc_id).cast("long").alias("_doc"), *keys, F.col(text).cast("string").alias("_text"))
    found = ngram_components(own.select("_k1", "_text"), text="_text", doc_id="_k1", **options).select(F.col("doc_id").alias("_id"), "component_id")
    at = own.select("_doc", "_k1", "_k2").distinct().join(found.distinct(), F.col("_k1") == F.col("_id"))
    lead = at.groupBy("component_id").agg(F.min(F.struct("_doc", "_k1", "_k2")).alias("_l")).select(F.col("_l._k1").alias("_a"), F.col("_l._k2").alias("_b"))
    whole = own.select(ROW, "_k1", "_k2").join(lead.hint("shuffle_hash"), (F.col("_k1") == F.col("_a")) & (F.col("_k2") == F.col("_b")), "left_semi")
    null = docs.filter(F.col(doc_id).isNull()).select(nested(docs))
    return whole.dropDuplicates(["_k1", "_k2"]).select(ROW).unionByName(null).select(*unnested(docs))
