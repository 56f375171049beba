"""Best-two-fit packing of documents into token sequences.

Documents of one length are interchangeable, so the plan is made on the histogram of lengths: at most
``capacity`` counters, whatever the corpus. A bin is filled greedily with the largest length that fits; then
its smallest document is swapped for two unpacked ones that fill the widened gap more tightly, if there are
such. As long as no counter runs out the next bin is the same, so a pattern is repeated as often as its
counters allow and the plan stays short. Rows then find their place by their rank among rows of their length,
counted in salted groups; the salt comes from a row's place in the written pieces (neighbours share one), so neither
a length nor a document held by a third of all rows is a hot group.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each on its own; null
identifiers are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm.common import ROW, field, nested, release, small_batches, sums_before
from pointspark.llm.tokens import WORDS, crc_of, encoder
from pointspark.shared import materialize

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Runs ``(number of equal bins, lengths in a bin)`` that use up ``counts``."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sizes = np.arange(capacity + 1)

    def at_most() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    runs, below = [], at_most()
    while below[capacity]:
        room, used, bin_ = capacity, {}, []
        while room and (size := int(below[room])):
            while size and left[size] <= used.get(size, 0):
                size = int(below[size - 1])
            if not size:
                break
            n = min(room // size, int(left[size]) - used.get(size, 0))
            used[size] = used.get(size, 0) + n
            bin_ += [size] * n
            room -= n * size
        smallest = bin_[-1]
        if room and smallest < capacity:
            # two unpacked documents in place of the smallest
            free = left.copy()
            for size, n in used.items():
                free[size] -= n
            free[smallest] += 1
            gap = room + smallest
            low = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = sizes[1:gap][free[1:gap] > 0]
            b = low[gap - a]
            twice = (b == a) & (free[a] < 2)
            b = np.where(twice, low[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if len(both) and (best := int(both.max())) > smallest:
                i = int(both.argmax())
                bin_[-1:] = sorted((int(a[i]), int(b[i])), reverse=True)
                used[smallest] -= 1
                for size in bin_[-2:]:
                    used[size] = used.get(size, 0) + 1
        times = min(int(left[s]) // n for s, n in used.items() if n)
        for size, n in used.items():
            left[size] -= times * n
        runs.append((times, bin_))
        below = at_most()
    return runs


def segments(runs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Columns: length, first rank among rows of that length, rows, first sequence, offset; ordered by the first two."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for times, bin_ in runs:
        offset = 0
        for size in bin_:
            out.append((size, rank.get(size, 0), times, sequence, offset))
            rank[size] = rank.get(size, 0) + times
            offset += size
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = True, words: int = WORDS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and on demand ``ids`` for each piece of at most ``capacity`` ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, words)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, enc.dtype)
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(own), crc_of(own), own.tobytes() if with_ids else None))
                if len(rows) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)
        release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE_SCHEMA + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int = 4096, group_rows: int = 2000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have ``doc_id, piece, length`` (1 to ``capacity``).

    Rows alike in length are served in salted groups and there by doc_id, piece and checksum (if there is one).
    """
    spark = pieces.sparkSession
    # a row's number in the written table does not change when a task is run again
    pieces = materialize(pieces.select("length", nested(pieces), F.monotonically_increasing_id().alias("_u")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    if counts and not (min(counts) >= 1 and max(counts) <= capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    placed = segments(plan(counts, capacity))
    table = spark.sparkContext.broadcast(placed)  # bounded by the number of lengths, not by the corpus
    salts = max(1, -(-max(counts.values(), default=0) // group_rows))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(F.shiftright("_u", 6)), F.lit(salts)))
    per = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    first = sums_before(per, ["length"], "_salt", "_n", max(1, math.isqrt(salts)))
    first = first.select(F.col("length").alias("_length"), F.col("_salt").alias("_s"), F.col("_before").alias("_first"))
    order = [F.col(f"{ROW}.{c}") for c in ("doc_id", "piece", "ids_crc32") if c in pieces.schema[ROW].dataType.names]
    within = Window.partitionBy("length", "_salt").orderBy(*order, "_u")
    ranked = salted.withColumn("_rn", F.row_number().over(within) - 1).join(first, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_s")))

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        seg = table.value
        keys = (seg[:, 0] << 44) | seg[:, 1]
        length, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, ranks))
        row = seg[np.searchsorted(keys, (length << 44) | rank, "right") - 1] if len(length) else seg[:0]
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["sequence_id", "offset"])

    at = place.asNondeterministic()(F.col("length"), F.col("_first") + F.col("_rn")).alias("_p")
    names = [c for c in pieces.schema[ROW].dataType.names if c not in ("sequence_id", "offset")]
    return ranked.select(ROW, at).select(*[field(c).alias(c) for c in names], "_p.sequence_id", "_p.offset")


def best_two_fit(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """Pack all documents; with ``with_ids`` each row carries its ids (little-endian, 2 or 4 bytes as the vocabulary needs).

    ``words`` bounds what an encoder remembers.
    """
    return pack(encode_pieces(docs, tokenizer, end_id, capacity, with_ids, words), capacity)
