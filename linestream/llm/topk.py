"""Exact top-k inner products by norm buckets with per-bucket pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linestream.llm.common import running_total, written
from linestream.llm.vectors import binary_rows, from_binary, keep_best, matrix, per_key, usable, width

#: Vectors of a group that one task reads, queries of a group, vectors of a bucket within a task.
GROUP, QUERY_GROUP, BUCKET = 16_384, 2_048, 1_024
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATES_FROM, FOCUS = 0.8, 4
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class Scan:
    """The best products so far of the queries of one key, while its vectors stream by in order of length."""

    def __init__(self, k: int, dims: int):
        self.k, self.dims = k, dims
        self.ids: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.floor: list[np.ndarray] = []
        self.q = None

    def add_queries(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray) -> None:
        self.ids.append(ids)
        self.rows.append(x)
        self.floor.append(floor)

    def _ready(self) -> None:
        self.q, self.qid, self.theta = np.concatenate(self.rows), np.concatenate(self.ids), np.concatenate(self.floor)
        self.norm = np.linalg.norm(self.q, axis=1)
        self.unit = self.q / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.owner, self.score, self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add_vectors(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not self.rows:
            return
        if self.q is None:
            self._ready()
        for i in range(0, len(ids), BUCKET):
            self._bucket(ids[i : i + BUCKET], x[i : i + BUCKET])

    def _bucket(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.linalg.norm(x, axis=1)
        most = norm.max()
        # Local threshold: the cosine a vector of this bucket needs at least to reach the query's floor.
        room = self.norm * most
        safe = self.theta - np.abs(self.theta) * 1e-9 - 1e-6
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(room > 0, safe / room, np.where(safe <= 0, -1.0, np.inf))
        alive = np.flatnonzero(cosine <= 1)
        if not len(alive):
            return
        exact = self.norm[alive].max() * most < _EXACT
        by_coordinate = alive[cosine[alive] >= max(COORDINATES_FROM, 1e-6)] if exact else alive[:0]
        by_length = np.setdiff1d(alive, by_coordinate)
        owners, places, scores = [], [], []
        if len(by_length):
            # Length pruning: a vector shorter than floor / |query| cannot reach it.
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.norm[by_length] > 0, safe[by_length] / self.norm[by_length], -np.inf)
            some = np.flatnonzero(norm >= max(need.min(), 0) * (1 - 1e-9))
            s = self._products(by_length, x[some], exact)
            r, c = np.nonzero(s >= self.theta[by_length][:, None])
            owners.append(by_length[r])
            places.append(some[c])
            scores.append(s[r, c])
        if len(by_coordinate):
            unit = x / np.where(norm > 0, norm, 1)[:, None]
        for q in by_coordinate:
            # Coordinate pruning: a unit vector within the angle has each coordinate within this range.
            # (Its floor is positive here, so a zero vector cannot reach it.)
            t, mask = cosine[q], np.ones(len(ids), bool)
            for f in self.focus[q]:
                mid, half = self.unit[q, f] * t, np.sqrt(max(0, (1 - t * t) * (1 - self.unit[q, f] ** 2))) + 1e-9
                low, high = (mid - half if self.unit[q, f] > -t else -1), (mid + half if self.unit[q, f] < t else 1)
                mask &= (unit[:, f] >= low) & (unit[:, f] <= high)
            some = np.flatnonzero(mask)
            s = self._products(np.array([q]), x[some], exact)[0]
            good = np.flatnonzero(s >= self.theta[q])
            owners.append(np.full(len(good), q))
            places.append(some[good])
            scores.append(s[good])
        owner, place = np.concatenate(owners), np.concatenate(places)
        other = self.qid[owner] != ids[place]
        owner, place, score = owner[other], place[other], np.concatenate(scores)[other].astype(np.int64)
        if not len(owner):
            return
        self.owner = np.concatenate([self.owner, owner])
        self.score = np.concatenate([self.score, score])
        self.found = np.concatenate([self.found, ids[place]])
        best = keep_best(self.owner, ~self.score, self.found, self.k)
        self.owner, self.score, self.found = self.owner[best], self.score[best], self.found[best]
        last = np.flatnonzero(np.bincount(self.owner, minlength=len(self.q)) == self.k)
        ends = np.searchsorted(self.owner, last, side="right") - 1
        self.theta[last] = np.maximum(self.theta[last], self.score[ends].astype(np.float64))

    def _products(self, q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
        """Integer products; beyond 2^53 in whole numbers of any size, kept within a long."""
        if exact:
            return self.q[q] @ x.T
        whole = [[int(v) for v in row] for row in x]
        out = np.empty((len(q), len(x)), np.int64)
        for i, j in enumerate(q):
            mine = [int(v) for v in self.q[j]]
            out[i] = [max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(mine, row, strict=True)))) for row in whole]
        return out

    def result(self) -> pa.RecordBatch | None:
        if self.q is None or not len(self.owner):
            return None
        cols = [pa.array(self.qid[self.owner]), pa.array(self.found), pa.array(self.score)]
        return pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])


def _scan(rows: DataFrame, dims: int, k: int) -> DataFrame:
    """``rows``: qg, vg, kind (0 query, 1 vector), ord, vec_id, x, floor.  The best of each query within each key."""

    def feed(state: Scan, b: pa.RecordBatch) -> None:
        kind = b.column("kind").to_numpy()
        cut = int(np.searchsorted(kind, 1))
        for part, queries in ((b.slice(0, cut), True), (b.slice(cut), False)):
            if len(part):
                ids, x = part.column("vec_id").to_numpy(), from_binary(part.column("x"), dims)
                if queries:
                    state.add_queries(ids, x, part.column("floor").to_numpy().copy())
                else:
                    state.add_vectors(ids, x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return per_key(batches, ["qg", "vg"], lambda key: Scan(k, dims), feed, Scan.result)

    dealt = rows.repartition("qg", "vg").sortWithinPartitions("qg", "vg", "kind", "ord")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """The ``k`` highest products of each query (ids divisible by ``every``) with all other vectors of floor(scale * x).

    Vectors are ranked by length and cut into groups.  Each query first meets the longest group, whose k-th product
    is its floor; then only the groups with a vector long enough for that floor, which are the first so many.
    A group of vectors is sent to the query groups that reach it, and to no others.
    In a task, each bucket of similar length derives the cosine a query needs there, skips the query when it is above
    1, prunes by coordinates or by length, and computes the products of the rest.  Nothing is approximate.

    Rows as in ``usable``; zero vectors take part; equal products go to the smaller id; a query with fewer
    other vectors gets them all; products beyond a long stay at its limit; an empty table gives an empty result.
    Returns query_id, rank, vec_id, score.
    """
    base = usable(vectors)
    dims = width(base)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(matrix(b.column("embedding"), dims) * scale)
            cols = [b.column("vec_id"), pa.array(-np.linalg.norm(x, axis=1)), binary_rows(x), pa.array(np.ones(len(x), np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "shortness", "x", "one"])

    rows = written(base.mapInArrow(quantise, "vec_id long, shortness double, x binary, one long"), "vectors")
    ranked = written(running_total(rows, ["shortness", "vec_id"], "one", "ord").drop("one"), "by_length")
    ranked = ranked.withColumn("vg", F.floor(F.col("ord") / GROUP))
    queries = ranked.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("one", F.lit(1).cast("long"))
    queries = running_total(written(queries, "queries"), ["ord"], "one", "place").drop("one")
    queries = written(queries.withColumn("qg", F.floor(F.col("place") / QUERY_GROUP)), "queries")
    groups = queries.agg(F.max("qg")).first()[0]
    if groups is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = ranked.where("vg = 0").withColumn("qg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups).cast("long"))))
    shape = lambda df, kind, floor: df.select(
        "qg", "vg", F.lit(kind).alias("kind"), "ord", "vec_id", "x", floor.cast("double").alias("floor")
    )
    nothing = F.lit(float("-inf"))
    first = shape(longest, 1, nothing).union(shape(queries.withColumn("vg", F.lit(0).cast("long")), 0, nothing))
    seeds = written(_scan(first, dims, k), "seeds")
    # The k-th product of the longest group; with fewer than k there, no floor.
    floors = seeds.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = queries.drop("vg").join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    asked = asked.withColumn("floor", F.coalesce("floor", nothing))
    # How many groups are long enough: by at most 1,024 steps of the groups' greatest lengths, the last step rounded up.
    lengths = ranked.groupBy("vg").agg((-F.min("shortness")).alias("most"))
    count = lengths.count()
    step = -(-count // 1024)
    marks = [(int(r[0]), float(r[1])) for r in lengths.where(F.col("vg") % step == 0).orderBy("vg").collect()]
    need = (F.col("floor") - F.abs("floor") * 1e-9 - 1e-6) / -F.col("shortness")
    enough = F.lit(count)
    for vg, most in reversed(marks[1:]):
        enough = F.when((F.col("shortness") < 0) & (F.lit(most) < need), F.lit(vg)).otherwise(enough)
    asked = written(asked.withColumn("upto", enough.cast("long")).where("upto > 1"), "asked")
    # A group of vectors goes only to the query groups that reach it: one list of group numbers per group of vectors.
    reach = asked.groupBy("qg").agg(F.max("upto").alias("upto"))
    met = reach.select("qg", F.explode(F.sequence(F.lit(1).cast("long"), F.col("upto") - 1)).alias("vg"))
    dealt = ranked.join(met.groupBy("vg").agg(F.collect_list("qg").alias("qgs")), "vg").withColumn("qg", F.explode("qgs"))
    asked = asked.withColumn("vg", F.explode(F.sequence(F.lit(1).cast("long"), F.col("upto") - 1)))
    rest = shape(dealt, 1, nothing).union(shape(asked, 0, F.col("floor")))
    found = seeds.union(_scan(rest, dims, k))
    # At most k rows per query and group met; the window keeps k of them in each task ahead of the shuffle.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
