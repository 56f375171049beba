"""Uncompressed LAS 1.2 files, point formats 0 to 3, as a Python data source ``las`` and a writer.

A file is read in ranges of points, one task each, through the file system of its URI. A label is written whole as
an extra dimension of four bytes, described by an extra-bytes record, besides the classification byte.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointspark.shared import discard, materialize

#: Points that a task holds at once, writing or reading.
AT_ONCE = 200_000
SCHEMA = "cloud_id string, pid long, x double, y double, z double, intensity int, classification int, label int"
#: Record sizes of the point formats.
SIZES = {0: 20, 1: 28, 2: 26, 3: 34}
_RECORD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1")]


#: Of an extra-bytes record: sizes of the data types, from 0, and the type of a signed integer of four bytes.
_EXTRA, _INT = (0, 1, 1, 2, 2, 4, 4, 8, 8, 4, 8), 6
_VLR = struct.Struct("<H16sHH32s")


def _record(size: int, label_at: int | None = None) -> np.dtype:
    names, kinds = zip(*_RECORD, strict=True)
    offsets = [0, 4, 8, 12, 14, 15]
    if label_at is not None:
        names, kinds, offsets = (*names, "label"), (*kinds, "<i4"), [*offsets, label_at]
    return np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": size})


def _label_at(vlrs: bytes, n: int, at: int) -> int | None:
    """Place in a point's record of the extra dimension ``label``, if the variable-length records describe one."""
    start = 0
    for _ in range(n):
        _, user, ident, length, _ = _VLR.unpack_from(vlrs, start)
        body, start = vlrs[start + _VLR.size : start + _VLR.size + length], start + _VLR.size + length
        if user.rstrip(b"\0") == b"LASF_Spec" and ident == 4:
            for i in range(0, len(body), 192):
                kind, name = body[i + 2], body[i + 4 : i + 36].rstrip(b"\0")
                if kind == _INT and name == b"label":
                    return at
                at += _EXTRA[kind] if kind < len(_EXTRA) else 0
    return None


def header(raw: bytes) -> dict:
    """What is needed of a public header block."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    head, data_at, n_vlrs = struct.unpack_from("<HII", raw, 94)
    kind, size, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 128 or kind not in SIZES:
        raise ValueError(f"point format {kind} is compressed or unknown")
    return {"data_at": data_at, "size": size, "count": count, "scale": struct.unpack_from("<3d", raw, 131), "offset": struct.unpack_from("<3d", raw, 155), "vlrs": (head, n_vlrs), "extra_at": SIZES[kind]}


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("points_per_task", 1_000_000))

    def _files(self) -> list[str]:
        where, path = fs.FileSystem.from_uri(self.path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        return sorted(f.path for f in where.get_file_info(fs.FileSelector(path)) if f.path.lower().endswith(".las"))

    def partitions(self) -> list[_Range]:
        where, _ = fs.FileSystem.from_uri(self.path)
        out = []
        for path in self._files():
            with where.open_input_file(path) as f:
                n = header(f.read(227))["count"]
            out += [_Range(path, i, min(n, i + self.step)) for i in range(0, n, self.step)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        with where.open_input_file(partition.path) as f:
            h = header(f.read(227))
            f.seek(h["vlrs"][0])
            label_at = _label_at(f.read(h["data_at"] - h["vlrs"][0]), h["vlrs"][1], h["extra_at"])
            f.seek(h["data_at"] + partition.start * h["size"])
            name = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            for at in range(partition.start, partition.stop, AT_ONCE):
                n = min(AT_ONCE, partition.stop - at)
                raw = np.frombuffer(f.read(n * h["size"]), _record(h["size"], label_at))
                xyz = [raw[a] * s + o for a, s, o in zip("XYZ", h["scale"], h["offset"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(at, at + n)), *map(pa.array, xyz), pa.array(raw["intensity"].astype(np.int32)), pa.array(raw["classification"].astype(np.int32)), pa.array(raw["label"]) if label_at is not None else pa.nulls(n, pa.int32())],
                    names=["cloud_id", "pid", "x", "y", "z", "intensity", "classification", "label"],
                )


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """A LAS file or a folder of them; the file's name is the cloud, the place in it the ``pid``."""
    spark.dataSource.register(LasSource)
    return spark.read.format("las").load(_uri(path))


def _points(pdf: pd.DataFrame, low: np.ndarray, scale: float, dimension: str | None) -> bytes:
    """The rows' point records."""
    xyz = pdf[["x", "y", "z"]].to_numpy(float)
    out = np.zeros(len(xyz), _record(24 if dimension is not None else 20, 20 if dimension is not None else None))
    for i, a in enumerate("XYZ"):
        out[a] = np.round((xyz[:, i] - low[i]) / scale)
    if dimension is not None:
        out["label"] = pdf[dimension].to_numpy().astype(np.int32)
        out["classification"] = np.where((out["label"] >= 0) & (out["label"] < 256), out["label"], 0)
    elif "classification" in pdf:
        out["classification"] = pdf["classification"].to_numpy().astype(np.uint8)
    if "intensity" in pdf:
        out["intensity"] = pdf["intensity"].to_numpy().astype(np.uint16)
    return out.tobytes()


def _head(n: int, lo: np.ndarray, hi: np.ndarray, scale: float, dimension: str | None) -> bytes:
    """What stands before the records of ``n`` points between ``lo`` and ``hi``."""
    size, vlr = (24, 192) if dimension is not None else (20, 0)
    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<BB", head, 24, 1, 2)
    struct.pack_into("<HII", head, 94, 227, 227 + (_VLR.size + vlr if vlr else 0), int(vlr > 0))
    struct.pack_into("<BHI", head, 104, 0, size, n)
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, *(np.floor(lo) if n else np.zeros(3)))
    if n:
        struct.pack_into("<6d", head, 179, hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    if vlr:
        head += _VLR.pack(0, b"LASF_Spec", 4, vlr, b"")
        head += struct.pack("<HBB32s", 0, _INT, 0, b"label").ljust(vlr, b"\0")
    return bytes(head)


def las_bytes(pdf: pd.DataFrame, scale: float = 0.001, dimension: str | None = None) -> bytes:
    """One cloud as a LAS 1.2 file of point format 0.

    ``dimension`` goes to an extra dimension of four bytes, and where it fits (0 to 255) to the classification byte, too.
    """
    xyz = pdf[["x", "y", "z"]].to_numpy(float)
    lo, hi = (xyz.min(axis=0), xyz.max(axis=0)) if len(xyz) else (np.zeros(3), np.zeros(3))
    return _head(len(xyz), lo, hi, scale, dimension) + _points(pdf, np.floor(lo), scale, dimension)


def write_las(cloud: DataFrame, path: str, dimension: str | None = None, scale: float = 0.001, points_per_file: int = 5_000_000) -> None:
    """A LAS file per cloud (and per ``points_per_file`` points by ``pid``) under ``path``.

    Tasks write the records of their range of points in pieces; for each file one task then copies its pieces behind
    the header, a few MB at a time, so no task holds a file, however long.
    """
    out = _uri(path)
    extra = list(dict.fromkeys(c for c in (dimension, "intensity", "classification") if c and c in cloud.columns))
    key = ["cloud_id", "_part"]
    bounds = ["lo_x", "lo_y", "lo_z", "hi_x", "hi_y", "hi_z"]
    apart = f"_pieces-{uuid.uuid4().hex}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(out)
        where.create_dir(f"{root}/{apart}", recursive=True)
        held, at, number = [], None, 0

        def piece() -> pa.RecordBatch:
            pdf = pd.concat([x.to_pandas() for x in held], ignore_index=True)
            low = np.array([held[0].column(c)[0].as_py() for c in ("lo_x", "lo_y", "lo_z")], float)
            name = f"{apart}/{uuid.uuid4().hex}"  # another one each time: a task run anew never meets the pieces of the first
            with where.open_output_stream(f"{root}/{name}") as f:
                f.write(_points(pdf, np.floor(low), scale, dimension))
            return pa.RecordBatch.from_pydict({"cloud_id": pa.array([at[0]], pa.string()), "_part": pa.array([at[1]], pa.int64()), "first": pa.array([int(first)], pa.int64()), "number": pa.array([number], pa.int64()), "piece": pa.array([name])})

        for batch in batches:
            for run in _runs(batch, AT_ONCE):
                now = (run.column("cloud_id")[0].as_py(), run.column("_part")[0].as_py())
                if held and (now != at or sum(len(x) for x in held) + len(run) > AT_ONCE):
                    yield piece()
                    held.clear()
                    number += 1
                if not held:
                    at, first = now, run.column("pid")[0].as_py()
                held.append(run.drop_columns(key))
        if held:
            yield piece()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        where, root = fs.FileSystem.from_uri(out)
        one = pdf.iloc[0]
        name = f"{root}/{one['cloud_id']}_{one['_part']}.las"
        with where.open_output_stream(name + ".tmp") as f:
            f.write(_head(int(one["n"]), one[bounds[:3]].to_numpy(float), one[bounds[3:]].to_numpy(float), scale, dimension))
            for piece in pdf.sort_values(["first", "task", "number"])["piece"]:
                with where.open_input_stream(f"{root}/{piece}") as part:
                    while some := part.read(1 << 22):
                        f.write(some)
        where.move(name + ".tmp", name)
        return pd.DataFrame({"n": [one["n"]]})

    rows = cloud.select("cloud_id", "pid", "x", "y", "z", *extra).withColumn("_part", F.floor(F.col("pid") / points_per_file))
    files = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.min(c).alias("lo_" + c) for c in "xyz"], *[F.max(c).alias("hi_" + c) for c in "xyz"])
    files = materialize(files, "las-files")  # a row per file
    ranged = rows.join(F.broadcast(files.select(*key, "lo_x", "lo_y", "lo_z")), key).repartitionByRange(*key, "pid").sortWithinPartitions(*key, "pid")
    pieces = ranged.mapInArrow(encode, "cloud_id string, _part long, first long, number long, piece string").withColumn("task", F.spark_partition_id())
    pieces = materialize(pieces, "las-pieces")
    pieces.join(files, key).groupBy(*key).applyInPandas(join, "n long").agg(F.sum("n")).collect()
    where, root = fs.FileSystem.from_uri(out)
    if where.get_file_info(f"{root}/{apart}").type == fs.FileType.Directory:
        where.delete_dir(f"{root}/{apart}")
    discard(files, pieces)


def _runs(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows of one file each, in slices of at most ``most``."""
    cloud, part = batch.column("cloud_id").dictionary_encode().indices.to_numpy(), batch.column("_part").to_numpy()
    ends = np.append(np.flatnonzero((cloud[1:] != cloud[:-1]) | (part[1:] != part[:-1])) + 1, len(batch)) if len(batch) else []
    start = 0
    for end in ends:
        for at in range(start, int(end), most):
            yield batch.slice(at, min(most, int(end) - at))
        start = int(end)
