"""Approximate nearest neighbours from windows on several shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linestream.llm.common import hilbert_keys, running_total, written
from linestream.llm.vectors import binary_rows, from_binary, keep_best, matrix, per_key, usable, width
from linestream.scale import lookup_join

#: Curves, projected dimensions and bits of each, and the window to each side as a share of all distinct vectors.
CURVES, DIMS, BITS, WINDOW, LEAST_WINDOW = 16, 8, 7, 0.03, 64
#: Rows of a stretch of curve that one task reads, and queries it holds at most on average.
STRETCH, HELD = 4_096, 2_048


def projections(dims: int, curves: int = CURVES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve orthonormal directions and a shift of the grid per direction."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(curves):
        basis = np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, : min(DIMS, dims)]
        out.append((basis, rng.random(basis.shape[1])))
    return out


def _moments(rows: DataFrame, dims: int, curves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of all rows along each direction: sums per task, one row per task to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = np.concatenate([p[0] for p in projections(dims, curves)], axis=1)
        n, s, ss = 0, np.zeros(basis.shape[1]), np.zeros(basis.shape[1])
        for b in batches:
            y = from_binary(b.column("x"), dims) @ basis
            n, s, ss = n + len(y), s + y.sum(axis=0), ss + (y * y).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.tolist()])], names=["n", "s", "ss"])

    got = rows.mapInArrow(sums, "n long, s array<double>, ss array<double>").collect()
    n = max(1, sum(r["n"] for r in got))
    mean = np.sum([r["s"] for r in got], axis=0) / n
    dev = np.sqrt(np.maximum(np.sum([r["ss"] for r in got], axis=0) / n - mean**2, 1e-30))
    split = lambda a: np.split(a, curves)
    return list(zip(split(mean), split(dev), strict=True))


def _distinct(rows: DataFrame, dims: int, every: int, k: int) -> DataFrame:
    """vec_id (the smallest), x, ids (the ``k`` + 1 smallest, ascending), asked (whether a query has it) of each distinct vector.

    In each task the rows are sorted by vector, and of each vector only the smallest ids and a query's go on.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, had, asks = None, 0, False
        for b in batches:
            if not len(b):
                continue
            x, query = from_binary(b.column("x"), dims), b.column("vec_id").to_numpy() % every == 0
            starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1)))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
            place = np.arange(len(x)) - starts[run]
            same = b.column("x")[0].as_py() == last
            place[run == 0] += had if same else 0
            keep = place <= k
            first = np.flatnonzero(query)
            first = first[np.unique(run[first], return_index=True)[1]]
            keep[first[(run[first] > 0) | (not (same and asks))]] = True
            in_last = query[run == run[-1]].any()
            asks = bool(in_last or (same and asks and run[-1] == 0))
            last, had = b.column("x")[len(b) - 1].as_py(), int(place[-1]) + 1
            yield b.filter(pa.array(keep))

    some = rows.sortWithinPartitions("x", "vec_id").mapInArrow(few, rows.schema)
    query = F.bool_or(F.pmod("vec_id", F.lit(every)) == 0).alias("asked")
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1)
    return some.groupBy("x").agg(ids.alias("ids"), query).select(F.col("ids")[0].alias("vec_id"), "x", "ids", "asked")


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, curves: int = CURVES, window: float = WINDOW
) -> DataFrame:
    """For each query (ids divisible by ``every``) the ``k`` nearest of the vectors near it on some curve.

    Equal vectors are one from here on: it lies on the curves once, under its smallest id, is asked once for all queries that
    have it, and stands for its ``k`` + 1 smallest ids when the answers are ranked.  Each curve is a Hilbert ordering of another random projection, its grid shifted by another amount.  All curves are
    range-sorted together and every vector gets its rank.  A query looks ``window`` of all of them to each side (at least
    ``LEAST_WINDOW`` rows): stretches of the curve meet the queries whose window touches them, by equal keys; a stretch
    with many queries is read by several tasks.  Distances are exact, on the original vectors.

    Rows as in ``usable``, and zero vectors take no part; equal distances go to the smaller id; an empty table
    gives an empty result.  Returns query_id, rank, vec_id, score (Euclidean distance).
    """
    base = usable(vectors).where(F.exists("embedding", lambda v: v != 0))
    dims = width(base)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column("vec_id"), binary_rows(matrix(b.column("embedding"), dims) + 0.0)]  # -0.0 is 0.0
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "x"])

    every_row = written(base.mapInArrow(plain, "vec_id long, x binary"), "vectors")
    rows = written(_distinct(every_row, dims, every, k), "distinct")
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    moments = _moments(rows, dims, curves)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = from_binary(b.column("x"), dims)
            for curve, ((basis, shift), (mean, dev)) in enumerate(zip(projections(dims, curves), moments, strict=True)):
                z = np.clip((x @ basis - mean) / dev, -20, 20)
                even = 1 / (1 + np.exp(-1.7 * z))  # about uniform when z is about normal
                cell = np.minimum(((even + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                key, n = hilbert_keys(cell, BITS), len(x)
                cols = [pa.array(np.full(n, curve, np.int32)), pa.array(key), b.column("vec_id"), b.column("x"), b.column("asked")]
                names = ["curve", "key", "vec_id", "x", "asked", "one"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.ones(n, np.int64))], names=names)

    bare = rows.select("vec_id", "x", "asked")
    keyed = written(bare.mapInArrow(keys, "curve int, key long, vec_id long, x binary, asked boolean, one long"), "keys")
    ranked = running_total(keyed, ["curve", "key", "vec_id"], "one", "at").drop("one", "key")
    ranked = written(ranked.withColumn("at", F.col("at") - F.col("curve").cast("long") * total), "ranked")
    reach = max(LEAST_WINDOW, int(np.ceil(window * total)))
    per_stretch = (STRETCH + 2 * reach) * asked / max(1, total)
    parts = max(1, int(np.ceil(per_stretch / HELD)))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    line = ranked.select("curve", F.floor(F.col("at") / STRETCH).alias("stretch"), every_part.alias("part"), F.lit(1).alias("kind"), "at", "vec_id", "x")
    low = F.floor(F.greatest(F.lit(0).cast("long"), F.col("at") - reach) / STRETCH)
    high = F.floor(F.least(F.lit(total - 1).cast("long"), F.col("at") + reach) / STRETCH)
    queries = ranked.where("asked").select(
        "curve",
        F.explode(F.sequence(low, high)).alias("stretch"),
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"),
        F.lit(0).alias("kind"),
        "at",
        "vec_id",
        "x",
    )

    def feed(state: dict, b: pa.RecordBatch) -> None:
        cut = int(np.searchsorted(b.column("kind").to_numpy(), 1))
        for part, asks in ((b.slice(0, cut), True), (b.slice(cut), False)):
            if len(part):
                got = part.column("at").to_numpy(), part.column("vec_id").to_numpy(), from_binary(part.column("x"), dims)
                state["queries"].append(got) if asks else _measure(state, *got, reach, k + 1)

    def finish(state: dict) -> pa.RecordBatch | None:
        if not state["best"]:
            return None
        owner, dist, ids = state["best"]
        return pa.RecordBatch.from_arrays(
            [pa.array(state["all"][1][owner]), pa.array(ids), pa.array(dist)], names=["query_id", "vec_id", "score"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return per_key(batches, ["curve", "stretch", "part"], lambda key: {"queries": [], "best": None}, feed, finish)

    dealt = line.union(queries).repartition("curve", "stretch", "part")
    dealt = dealt.sortWithinPartitions("curve", "stretch", "part", "kind", "at")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    # The k + 1 nearest ids of a vector, its own among them, are ids of its k + 1 nearest distinct vectors.
    near = written(merged.withColumn("r", F.row_number().over(_best("query_id"))).where(F.col("r") <= k + 1).drop("r"), "near")
    near = lookup_join(near, rows.select("vec_id", "ids"), ["vec_id"], "inner")
    near = near.select("query_id", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("r", F.row_number().over(_best("query_id"))).where(F.col("r") <= k + 1)
    best = F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best")
    answers = near.groupBy(F.col("query_id").alias("like")).agg(best)
    answers = written(rows.select("x", F.col("vec_id").alias("like")).join(answers, "like").drop("like"), "answers")
    queries = every_row.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "x")
    told = lookup_join(queries, answers, ["x"], "inner")
    others = F.filter("best", lambda b: b["vec_id"] != F.col("query_id"))
    told = told.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "b"))
    return told.select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _best(owner: str) -> Window:
    return Window.partitionBy(owner).orderBy("score", "vec_id")


def _measure(state: dict, at: np.ndarray, ids: np.ndarray, x: np.ndarray, reach: int, k: int) -> None:
    """Takes a piece of the curve: the nearest ``k`` so far of each held query, among vectors within its reach, itself included."""
    if not state["queries"]:
        return
    if "all" not in state:
        state["all"] = tuple(np.concatenate(c) for c in zip(*state["queries"], strict=True))
    q_at, _, q = state["all"]
    for i in range(0, len(q), 256):
        part = slice(i, i + 256)
        near = np.abs(at[None, :] - q_at[part, None]) <= reach
        rough = (q[part] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * (q[part] @ x.T)
        rough[~near] = np.inf
        if len(ids) > k:
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
            size = (q[part] ** 2).sum(axis=1) + (x**2).sum(axis=1).max()
            near &= rough <= (edge + size * 1e-9)[:, None]  # room for rounding: the exact distance decides
        r, c = np.nonzero(near)
        owner, dist, found = r + i, np.sqrt(((q[part][r] - x[c]) ** 2).sum(axis=1)), ids[c]
        if state["best"]:
            owner, dist, found = (np.concatenate(p) for p in zip(state["best"], (owner, dist, found), strict=True))
        best = keep_best(owner, dist, found, k)
        state["best"] = owner[best], dist[best], found[best]
