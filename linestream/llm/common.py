"""Helpers shared by the operators of this package: tables, written intermediates, word hashes, running totals, curves."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linestream.scale import shared_dir

#: A word, in Java, RE2 and Python syntax.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Only A-Z change; other letters stay as they are."""
    return F.translate(c, _UPPER, _LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once, compressed, to the folder all executors share, and read back.

    Cuts the lineage: a lost executor costs a read of this table, not the work that made it, and what was
    not repeatable (row ids, partition numbers) is fixed from here on.
    """
    path = shared_dir(df.sparkSession, name)
    if _open():
        _open()[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_THREAD = threading.local()


def _open() -> list[list[str]]:
    """Folders written since each ``settled`` of this thread that is not done began, the innermost last."""
    return _THREAD.__dict__.setdefault("open", [])


def settled(make: Callable[[], DataFrame], name: str, codec: str = "zstd") -> DataFrame:
    """``make()`` written as by ``written``; the tables that were written on the way to it are removed then.

    For a ``make`` of which only the result is used on: once that stands, nothing reads the others, and a lost executor costs
    a read of it alone.  One within another is removed with the outer one's tables.
    """
    _open().append([])
    try:
        df = make()
    finally:
        gone = _open().pop()
    out = written(df, name, codec)
    spark = df.sparkSession
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, gone):
        with contextlib.suppress(Exception):  # a folder that cannot be removed is only left over
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()) if len(col) else pa.array([], pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20_240_131).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one more entry than rows)."""
    solid = ~_SPACE[raw]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    opens[edge] |= solid[edge]
    closes[edge - 1] |= solid[edge - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, off)


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased) of a text column, and each row's first word index.

    A polynomial over random byte values: hashes of all words come from one running sum over the bytes,
    taken in chunks so that memory is bounded by the batch, however long a text is.
    """
    raw, off = text_buffers(col)
    starts, ends, first = word_spans(raw, off)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s0 = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, s0 + _CHUNK, side="right")))
        part = _FOLD[raw[s0 : ends[j - 1]]]
        up, down = _powers(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=run[1:])
        at = starts[i:j] - s0
        out[i:j] = (run[ends[i:j] - s0] - run[at]) * down[at]
        i = j
    return mix64(out), first


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in the order of ``order`` (which must be unique).

    Range-sorted, summed within each partition as it streams by, then shifted by the totals of the partitions
    before.  Only one number per partition reaches the driver.  ``df`` should be a written table: its range
    bounds are sampled in a pass of their own.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType()), T.StructField("__part", T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(v)
            cols = [*b.columns, pa.array(total + upto - v), pa.array(np.full(len(v), part, np.int32))]
            total += int(upto[-1]) if len(v) else 0
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, out, "__part"])

    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), "running")
    totals = sorted((r[0], r[1]) for r in local.groupBy("__part").agg(F.sum(value)).collect())
    shift, before = [], 0
    for part, total in totals:
        shift.append((part, before))
        before += total
    shifts = df.sparkSession.createDataFrame(shift, "__part int, __shift long")
    joined = local.join(F.broadcast(shifts), "__part")  # one row per partition
    return joined.withColumn(out, F.col(out) + F.col("__shift")).drop("__part", "__shift")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of each integer point (rows, dims) on a Hilbert curve with ``bits`` bits per dimension.

    Works on all points at once: per bit plane the cube is turned so that the curve enters and leaves each
    sub-cube at neighbouring corners, then the planes are read off in Gray-code order.
    """
    dims = points.shape[1]
    if dims * bits > 63:
        raise ValueError("dims * bits must be at most 63")
    axes = [points[:, d].astype(np.int64) for d in range(dims)]
    for plane in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << plane), np.int64((1 << plane) - 1)
        for d in range(dims):
            inside = (axes[d] & bit) != 0
            swap = np.where(inside, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = axes[0] ^ np.where(inside, low, swap)
            if d:
                axes[d] = axes[d] ^ swap
    for d in range(1, dims):
        axes[d] = axes[d] ^ axes[d - 1]
    parity = np.zeros(len(points), np.int64)
    for plane in range(bits - 1, 0, -1):
        parity ^= np.where((axes[-1] >> plane) & 1, np.int64((1 << plane) - 1), 0)
    key = np.zeros(len(points), np.int64)
    for plane in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | (((axes[d] ^ parity) >> plane) & 1)
    return key
