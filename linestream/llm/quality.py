"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linestream.llm.common import free_name, text_buffers, word_hashes, word_spans

#: Rows the trees are fitted on at most: those with the smallest hash of their id.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 60, 4, 0.15, 1.0, 8

_KINDS = ["lower", "upper", "digit", "space", "line", "stop", "mark", "bracket", "other", "high"]
_KIND = np.full(256, _KINDS.index("other"), np.uint8)
for _kind, _chars in {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:'-", "mark": b"!?#*&%$@~^+=_", "bracket": b"|<>[](){}/\\\"`",
}.items():
    _KIND[list(_chars)] = _KINDS.index(_kind)
_KIND[128:] = _KINDS.index("high")
FEATURES = [*_KINDS, "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "distinct_pairs"]


def features(text: pa.Array) -> np.ndarray:
    """Statistics of each whole text, one row each: shares of byte kinds, lengths, word variety.  Empty texts: zeros."""
    raw, off = text_buffers(text)
    rows, size = len(off) - 1, np.diff(off)
    out = np.zeros((rows, len(FEATURES)), np.float64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    kind = _KIND[raw]
    for k in range(len(_KINDS)):
        out[full, k] = np.add.reduceat(kind == k, off[full], dtype=np.int64) / size[full]
    starts, ends, first = word_spans(raw, off)
    hashes, _ = word_hashes(text)
    words, length = np.diff(first), ends - starts
    out[:, 10], out[:, 11] = np.log1p(size), np.log1p(words)
    has = np.flatnonzero(words)
    if len(has):
        at = first[has]
        out[has, 12] = np.add.reduceat(length, at) / words[has]
        out[has, 13] = np.add.reduceat(length > 20, at, dtype=np.int64) / words[has]
        pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        for r in has:
            a, b = first[r], first[r + 1]
            out[r, 14] = len(np.unique(hashes[a:b])) / (b - a)
            out[r, 15] = len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b - a > 1 else 1.0
    return out


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: node i asks ``x[feature] <= cut`` and goes to ``left`` or ``left + 1``; leaves lead to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        return 1 / (1 + np.exp(-self.margin(x)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row; every tree is walked for all rows at once."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                down = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
                node = np.where(self.left[node] < 0, node, down)
            total += self.value[node]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
    """Boosting on the logistic loss over binned features, rows counted ``weight`` times.

    Without rows or with one label: the smoothed prior.
    """
    weight = np.ones(len(y)) if weight is None else weight
    x, y, weight = x[weight > 0], y[weight > 0], weight[weight > 0]
    n = len(y)
    prior = ((y * weight).sum() + 0.5) / (weight.sum() + 1)
    base = float(np.log(prior / (1 - prior)))
    feature, cut, left, value, roots = [], [], [], [], []
    if 0 < y.sum() < n:
        cuts = [_cuts(x[:, f]) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(x.shape[1]) * BINS
        total = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = (y - p) * weight, p * (1 - p) * weight
            roots.append(len(feature))
            open_nodes = [(np.arange(n), _node(feature, cut, left, value))]
            for depth in range(DEPTH + 1):
                below = []
                for rows, at in open_nodes:
                    value[at] = RATE * grad[rows].sum() / (hess[rows].sum() + RIDGE)
                    split = _best(flat[rows], grad[rows], hess[rows], weight[rows], x.shape[1], cuts) if depth < DEPTH else None
                    if split is None:
                        total[rows] += value[at]
                        continue
                    f, b = split
                    feature[at], cut[at] = f, cuts[f][b]
                    goes = binned[rows, f] > b
                    left[at] = _node(feature, cut, left, value)
                    _node(feature, cut, left, value)
                    below += [(rows[~goes], left[at]), (rows[goes], left[at] + 1)]
                open_nodes = below
    arrays = (np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), np.array(roots, np.int64))
    return Trees(*arrays, base)


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where bins end: between all values if they are few, else at quantiles."""
    distinct = np.unique(values)
    return distinct[:-1] if len(distinct) <= BINS else np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))


def _node(feature: list, cut: list, left: list, value: list) -> int:
    for column, v in zip((feature, cut, left, value), (0, 0.0, -1, 0.0), strict=True):
        column.append(v)
    return len(feature) - 1


def _best(flat: np.ndarray, grad: np.ndarray, hess: np.ndarray, weight: np.ndarray, width: int, cuts: list) -> tuple[int, int] | None:
    """Feature and bin of the split that gains most, from one histogram of gradients, curvatures and rows."""
    if weight.sum() < 2 * LEAST:
        return None
    ids, size = flat.ravel(), width * BINS
    hist = [np.bincount(ids, np.repeat(w, width), size).reshape(width, BINS) for w in (grad, hess, weight)]
    g, h, n = (np.cumsum(a, axis=1) for a in hist)
    tg, th, tn = grad.sum(), hess.sum(), weight.sum()
    gain = g**2 / (h + RIDGE) + (tg - g) ** 2 / (th - h + RIDGE) - tg**2 / (th + RIDGE)
    gain[(n < LEAST) | (tn - n < LEAST)] = -np.inf
    for f, c in enumerate(cuts):
        gain[f, len(c) :] = -np.inf
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(f), int(b)) if gain[f, b] > 1e-9 else None


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents outside the held-out fold.

    Labels with a null id or quality are ignored; of several labels of an id the mean counts, 0.5 and more as 1.
    """
    good = (F.avg("quality") >= 0.5).cast("int").alias("__y")
    known = labels.where("quality is not null").groupBy("doc_id").agg(good).where(fold("doc_id", folds) != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` ids and numbers: bounded, so they may go to every task.
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("__y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "__y", "x"]
            )

    found = some.mapInArrow(measure, "doc_id long, __y int, x array<double>")
    # Repeated rows of one id could exceed the bound; the first of them by value stands for it.
    rows = found.groupBy("doc_id").agg(F.min(F.struct("x", "__y")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r["__y"] for r in rows], np.float64))


def with_scores(docs: DataFrame, trees: Trees, out: str) -> DataFrame:
    """Adds the score of each row's whole text; null texts score as empty ones."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array(trees.score(features(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out])

    return docs.mapInArrow(score, schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Empty and null texts get the score of all-zero statistics; a null id is not held out and never trained on;
    repeated rows are scored alike; without usable labels every score is 0.5; an empty table gives an empty result.
    """
    scored = with_scores(docs.select("doc_id", "text"), train_quality(docs, labels), "score")
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    score = free_name(docs, "__score")
    return with_scores(docs, train_quality(docs, labels), score).where(F.col(score) >= threshold).drop(score)
