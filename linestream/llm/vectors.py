"""Vector tables: which rows take part, their numpy form, and rows of one key streamed through a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and embedding of the rows that take part, one per id.

    Left out: null ids, null vectors, vectors with null or non-finite components.  Of several vectors of one id the
    smallest in array order stands for it, so repeated rows count once.
    """
    x = F.col(column).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id is not null").where(good)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def width(df: DataFrame) -> int:
    """Components of the longest vector; shorter ones count as padded with zeros."""
    return df.agg(F.max(F.size("embedding"))).first()[0] or 0


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array<double> column as a float64 matrix of ``dims`` columns."""
    offsets = np.asarray(col.offsets, np.int64)
    flat = np.asarray(col.values, np.float64)[offsets[0] : offsets[-1]] if len(col) else np.zeros(0)
    sizes = np.diff(offsets)
    if (sizes == dims).all():
        return flat.reshape(len(col), dims)
    out = np.zeros((len(col), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def binary_rows(x: np.ndarray) -> pa.Array:
    """A matrix as one binary value per row."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    if not len(x) or not size:
        return pa.array([b""] * len(x), pa.binary())
    offsets = pa.py_buffer(np.arange(0, (len(x) + 1) * size, size, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x)])


def from_binary(col: pa.Array, dims: int, dtype=np.float64) -> np.ndarray:
    """The matrix behind ``binary_rows``; all rows have ``dims`` components."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype).reshape(len(col), dims)


def per_key(
    batches: Iterator[pa.RecordBatch], keys: list[str], start: Callable, feed: Callable, finish: Callable
) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows: ``start(key)`` makes a state, ``feed(state, rows)`` takes each stretch of one key,
    ``finish(state)`` gives the key's result (a batch or None).  Only the state is held, never a key's rows."""
    now, state = None, None
    for b in batches:
        if not len(b):
            continue
        cols = np.stack([b.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(cols[:, i].tolist())
            if key != now:
                if now is not None and (out := finish(state)) is not None:
                    yield out
                now, state = key, start(key)
            feed(state, b.slice(i, j - i))
    if now is not None and (out := finish(state)) is not None:
        yield out


def keep_best(owner: np.ndarray, cost: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` lowest costs of each owner, ties to the smaller id; sorted by owner, then rank."""
    order = np.lexsort((ids, cost, owner))
    own = owner[order]
    first = np.searchsorted(own, own, side="left")
    return order[np.arange(len(own)) - first < k]
