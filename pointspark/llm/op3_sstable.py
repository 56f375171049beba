"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer.

A shard file is ``data blocks | index | Bloom filter | footer``. Keys sort as bytes: a null flag, the
identifier big-endian with its sign bit flipped, and the place among rows that repeat the identifier. In a
block each key stores only what differs from the key before it; every block starts with a whole key, is
compressed with zstd and carries a CRC-32. The index has each block's last key, place and size, so a look-up
is: Bloom filter, binary search in the index, one block read.

Shards are globally ascending: documents are range-partitioned by identifier (then at random, so that rows of one
identifier may fill several shards) into shards of about ``shard_bytes`` of text and sorted within partitions. The place
among rows of an identifier counts within a shard. A task writes under a name of its own and renames when done, so
a retried or speculative task is harmless.

Defined cases: a null text holds only the end id; null identifiers come first; repeated rows stay, each with
an entry of its own; an empty table gives no shards; further columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm.common import release, small_batches, sums_before
from pointspark.llm.tokens import crc_of, encoder
from pointspark.shared import materialize, shared_path

MAGIC = b"PSSSTBL1"
_FOOTER = struct.Struct("<QIQIQQBxxx8s")
_SIGN = 1 << 63


def key_of(doc_id: int | None, ordinal: int) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id + _SIGN) % (1 << 64)).to_bytes(8, "big")) + ordinal.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - _SIGN


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, m: int, k: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % m for i in range(k)]


class ShardWriter:
    """Appends entries in ascending key order to an output stream."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 16, bits_per_key: int = 10):
        self.out, self.width, self.block_bytes, self.bits = out, width, block_bytes, bits_per_key
        self.block, self.last, self.index, self.hashed = bytearray(), b"", [], []
        self.at = self.entries = self.tokens = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.block and len(self.block) + len(ids) > self.block_bytes:
            self._flush()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.hashed.append(key[:9])
        self.entries += 1
        self.tokens += len(ids) // self.width

    def _flush(self) -> None:
        packed = self.zstd.compress(bytes(self.block))
        packed += struct.pack("<I", zlib.crc32(packed))
        self.out.write(packed)
        self.index.append((self.last, self.at, len(packed)))
        self.at += len(packed)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        m = max(64, self.bits * len(self.hashed))
        m += -m % 8
        bits = np.zeros(m, np.uint8)
        for key in self.hashed:
            bits[_bloom_bits(key, m, 7)] = 1
        bloom = np.packbits(bits).tobytes()
        self.out.write(index + bloom + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.tokens, self.width, MAGIC))


class ShardReader:
    """Look-ups and scans in one shard."""

    def __init__(self, source):
        self.f = source
        size = source.size()
        index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file, or an incomplete one")
        raw, self.index, at = self._read(index_at, index_n), [], 0
        while at < len(raw):
            n, at = _unvarint(raw, at)
            key, at = raw[at : at + n], at + n
            place, at = _unvarint(raw, at)
            n, at = _unvarint(raw, at)
            self.index.append((key, place, n))
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom_at, bloom_n), np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self.index[i]
        packed = self._read(at, n)
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError(f"damaged block {i}")
        raw, at, key = zstandard.ZstdDecompressor().decompress(packed[:-4]), 0, b""
        while at < len(raw):
            shared, at = _unvarint(raw, at)
            own, at = _unvarint(raw, at)
            n, at = _unvarint(raw, at)
            key, at = key[:shared] + raw[at : at + own], at + own
            yield key, raw[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield id_of(key), np.frombuffer(ids, f"<u{self.width}")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this identifier; none if there is no such row."""
        low = key_of(doc_id, 0)
        if not all(self.bloom[b] for b in _bloom_bits(low[:9], len(self.bloom), 7)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < low else (lo, mid)
        found = []
        for i in range(lo, len(self.index)):
            for key, ids in self._block(i):
                if key[:9] == low[:9]:
                    found.append(np.frombuffer(ids, f"<u{self.width}"))
                elif key > low:
                    return found
        return found


def open_shard(uri: str) -> ShardReader:
    where, path = fs.FileSystem.from_uri(uri)
    return ShardReader(where.open_input_file(path))


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, block_bytes: int = 1 << 16, shard_bytes: int = 16 << 20) -> DataFrame:
    """Encode ``doc_id, text`` into shards under the URI ``out``; one manifest row per shard, in key order by ``shard``.

    The action that reads the returned frame writes the files: materialise it once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        where, root = fs.FileSystem.from_uri(out)
        shard = TaskContext.get().partitionId()
        part, stream, writer = f"{root}/_part-{uuid.uuid4().hex}", None, None
        before, ordinal = object(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    where.create_dir(root, recursive=True)
                    stream = where.open_output_stream(part)
                    writer = ShardWriter(stream, enc.dtype.itemsize, block_bytes)
                ordinal = ordinal + 1 if doc_id == before else 0
                before = doc_id
                writer.add(key_of(doc_id, ordinal), enc.encode(text) + end)
        if writer is not None:
            writer.close()
            stream.close()
            name = f"shard-{shard:08d}.sst"
            where.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [f"{out}/{name}"], "n_docs": pa.array([writer.entries], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    weight = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    # the ranges are sampled without reading texts; the second key splits an identifier with very many rows
    ranged = rows.withColumn("_r", F.rand(7)).repartitionByRange(-(-weight // shard_bytes) or 1, "doc_id", "_r")
    ordered = ranged.sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text")
    return ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32, shard``, all taken from the files."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids_crc32", "shard")
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, got = row["start"], []
                for doc_id, ids in open_shard(row["path"]).scan():
                    got.append((doc_id, start, len(ids), crc_of(ids), row["shard"]))
                    start += len(ids)
                    if len(got) == 4096:
                        yield table(got)
                        got = []
                yield table(got)

    shards = manifest.count()
    placed = sums_before(manifest, [], "shard", "n_tokens", max(1, math.isqrt(shards))).withColumn("start", F.col("_before").cast("long"))
    # a stated number of partitions is not coalesced: a task reads a few shards, not all
    return placed.repartition(max(1, shards), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 0) -> DataFrame:
    """Write shards (by default in the shared folder) and read every document back from them."""
    out = out or shared_path(spark, "sstable")
    return read_shards(materialize(write_shards(docs, out, tokenizer, end_id), "manifest"))
