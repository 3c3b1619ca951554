"""N-gram Jaccard join of whole documents over prefix trees of globally ordered n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linestream.llm.common import free_name, mix64, settled, word_hashes, written
from linestream.llm.components import components
from linestream.llm.vectors import per_key

WORDS, PERCENT = 3, 90
#: Counters of the global order (a power of two), and rows of one side of a tree in one task.
COUNTERS, BLOCK = 1 << 20, 1_024
#: Tokens just ahead of the shared one that a row brings along, to tell a pair that met at one of them before.
HEAD = 1
#: Counters of text hashes that spare texts without a candidate pair their way over the network.
MASK = 1 << 20
#: Cells of a set's sketch, each the number of its n-grams that fall into it; a full cell says nothing.
CELLS, FULL = 256, 255
#: A token of a counter with more n-grams than this, and than so many times the mean of all counters, is counted ahead of its shuffle.
HOT_ENTRIES, HOT_MEANS = 4_096, 16
_PART = 4_096


def ngram_hashes(col, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text and where each text's begin; a shorter text is one n-gram, none without words."""
    h, first = word_hashes(col)
    factors = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
    roll = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        roll = roll * factors[0] + h[i : i + len(roll)] * factors[1 + i % 2]
    roll = mix64(roll + np.uint64(size))
    out, sizes = [], np.zeros(len(first) - 1, np.int64)
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= size:
            s = np.sort(roll[a : b - size + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = mix64(np.array([one * factors[0] + x * factors[1]]))[0]
            s = np.array([one], np.uint64)
        else:
            continue
        out.append(s)
        sizes[r] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _quiet():
    return np.errstate(over="ignore")


def counted(df: DataFrame, places, counters: int) -> np.ndarray:
    """How many of the indices that ``places`` makes of each batch of ``df`` fall on each of ``counters`` counters.

    Every task adds up one array of counters; the arrays are summed piece by piece while they stream by.
    What reaches the driver is the ``counters`` numbers, whatever the size of the data.
    """
    step = min(_PART, counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for b in batches:
            total += np.bincount(places(b), minlength=counters)
        small = total.max(initial=0) < 1 << 31
        parts = total.astype(np.int32 if small else np.int64).reshape(-1, step)
        used = np.flatnonzero(parts.any(axis=1))
        yield _parts(used, [parts[i].tobytes() for i in used])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                piece = np.frombuffer(raw, np.int64 if len(raw) == 8 * step else np.int32).astype(np.int64)
                total[i] = total[i] + piece if i in total else piece
        yield _parts(list(total), [v.tobytes() for v in total.values()])

    kind = "part long, counts binary"
    total = np.zeros((counters // step, step), np.int64)
    for r in df.mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).collect():
        total[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return total.ravel()


def global_order(docs: DataFrame, size: int, counters: int = COUNTERS) -> tuple[np.ndarray, int]:
    """Rank of each hash counter by the number of documents' n-grams that fall into it, over all documents.

    The order needs to be the same everywhere, not exact: it only decides how selective prefixes are.  With it the
    smallest rank of a counter that may hold a hot token; tokens of lower ranks are bounded in number by their counter.
    """
    shift = np.uint64(64 - counters.bit_length() + 1)

    def places(b: pa.RecordBatch) -> np.ndarray:
        with _quiet():
            hashes, _ = ngram_hashes(b.column("text"), size)
        return (hashes >> shift).astype(np.int64)

    total = counted(docs.select("text"), places, counters)
    rank = np.empty(counters, np.uint32)
    rank[np.argsort(total, kind="stable")] = np.arange(counters, dtype=np.uint32)
    return rank, int((total <= max(HOT_ENTRIES, HOT_MEANS * total.mean())).sum())


def _parts(part, counts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts, pa.binary())], names=["part", "counts"])


def ordered_tokens(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes renamed so that their numeric order is the global order, rare counters first; 63 bits."""
    bits = len(rank).bit_length() - 1
    low = np.uint64((1 << (63 - bits)) - 1)
    return (rank[(hashes >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(63 - bits)) | (hashes & low)


def least_overlap(a, b, percent: int = PERCENT):
    """Fewest shared n-grams with which sets of sizes ``a`` and ``b`` link: ceil(percent (a + b) / (100 + percent))."""
    return -((-percent * (a + b)) // (100 + percent))


def _sets(docs: DataFrame, rank: np.ndarray, percent: int, row: str | None, size: int) -> DataFrame:
    """uid, row, doc_id, th (hash of the text), n, s1, s2 (signature of the set), prefix, sketch of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            with _quiet():
                hashes, first = ngram_hashes(b.column("text"), size)
                tokens = ordered_tokens(hashes, rank)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes + np.uint64(k)))]) for k in (1, 2)]
                s1, s2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
            n = np.diff(first)
            prefix = []
            for a, m in zip(first[:-1].tolist(), n.tolist(), strict=True):
                keep = m + (-percent * m) // 100 + 1 if m else 0
                prefix.append(np.sort(tokens[a : a + m])[:keep].view(np.int64))
            cols = [np.arange(uid, uid + len(b)), b.column("row"), b.column("doc_id"), b.column("th"), n, s1, s2]
            uid += len(b)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *prefix]))
            cols += [pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(sketches(hashes, first), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in cols],
                names=["uid", "row", "doc_id", "th", "n", "s1", "s2", "prefix", "sketch"],
            )

    number = F.lit(0).cast("long") if row is None else F.col(row)
    rows = docs.select(number.alias("row"), "doc_id", F.xxhash64("text").alias("th"), "text")
    kind = "uid long, row long, doc_id long, th long, n long, s1 long, s2 long, prefix array<long>, sketch binary"
    return rows.mapInArrow(measure, kind)


def sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set, how many of its n-grams fall into each of ``CELLS`` cells, a byte each."""
    cell = (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.minimum(np.bincount(cell[a:b], minlength=CELLS), FULL).astype(np.uint8).tobytes())
    return out


def most_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most n-grams that sets of the sketches ``a`` and ``b`` (rows of cells) can share; with a full cell, any number."""
    most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    most[((a == FULL) & (b == FULL)).any(axis=1)] = np.iinfo(np.int64).max
    return most


def _fair(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if not len(r):
                continue
            ka, kb = (np.frombuffer(b"".join(r.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("ka", "kb"))
            fewest = least_overlap(r.column("na").to_numpy(), r.column("nb").to_numpy(), percent)
            good = r.filter(pa.array(most_overlap(ka, kb) >= fewest))
            yield pa.RecordBatch.from_arrays([good.column("a"), good.column("b")], names=["a", "b"])

    a = reps.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = reps.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(check, "a long, b long")


def _shared(entries: DataFrame, hot: int | None) -> DataFrame:
    """The rows of ``entries`` (c, pos, token) whose token another class shows too, with the token's ``lead``.

    The lead is the class that shows it first: the one with the fewest rare n-grams of its own, in the middle of a
    group of near copies.  Place and class in one number; places from 255 on count as one, and only the choice depends on it.

    Tokens below ``hot`` are few in number each: their rows are brought together once.  The others are counted, combined
    ahead of the shuffle, and joined, which adaptive execution splits.
    """
    early = F.shiftleft(F.least(F.col("pos"), F.lit(255)).cast("long"), 55).bitwiseOR(F.col("c"))
    ends = {"lead": F.min(early), "last": F.max(early)}
    by_token = Window.partitionBy("token")
    few = entries if hot is None else entries.where(F.col("token") < hot)
    out = few.withColumns({k: v.over(by_token) for k, v in ends.items()}).where("lead < last").drop("last")
    if hot is not None:
        many = entries.where(F.col("token") >= hot)
        stats = many.groupBy("token").agg(*[v.alias(k) for k, v in ends.items()]).where("lead < last").drop("last")
        out = out.unionByName(many.join(stats, "token"))
    return out.select("token", "pos", "c", F.col("lead").bitwiseAND((1 << 55) - 1).alias("lead"))


def tree_length(n, percent: int = PERCENT):
    """How many of its first tokens a set must show to meet every partner that is not smaller."""
    return n - least_overlap(n, n, percent) + 1


def met_before(head: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs (p, q) have a token of their ``head`` (a row of tokens each, filled up with -1) in common."""
    out = np.zeros(len(p), bool)
    for i in range(head.shape[1]):
        mine = head[p, i]
        out |= (mine >= 0) & (head[q] == mine[:, None]).any(axis=1)
    return out


def tree_pairs(
    key: np.ndarray, side: np.ndarray, rows: list[np.ndarray], n: np.ndarray, pos: np.ndarray, comp: np.ndarray, percent: int,
    head: np.ndarray | None = None,
):
    """Candidate pairs (probe, other) of rows with equal ``key``: a walk of all probes down one forest of prefix trees.

    ``rows`` are the ordered tokens after the shared one, at ``pos`` of a set of ``n``.  All rows are probes; in the tree are
    those whose shared token is early enough to meet partners that are not smaller.  Rows of side 0 and 1 only pair across.
    Sets with a common beginning share their nodes and so their overlap with a probe.
    A subtree is left when the overlap so far and what remains of the shorter side cannot reach the needed overlap, or when
    all its sets are in the probe's own component already.

    A pair with a token of ``head`` in common is not proposed here.  That loses nothing: two sets that link pass every test
    at the first token they share, where no earlier one can be common.
    """
    if head is None:
        head = np.full((len(rows), 0), -1, np.int64)
    inside = np.flatnonzero(pos < tree_length(n, percent))
    length = np.array([len(rows[i]) for i in inside])
    depth = int(length.max(initial=0))
    all_tokens = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]))
    base = len(all_tokens) + 1
    table = np.full((len(inside), depth + 1), -1, np.int64)
    table[:, 0] = key[inside]
    for r, i in enumerate(inside):
        table[r, 1 : 1 + length[r]] = np.searchsorted(all_tokens, rows[i])
    order = np.lexsort(table.T[::-1])
    inside, length, table = inside[order], length[order], table[order]
    # Tokens of the probes: one sorted array of (probe, token).
    counts = np.array([len(r) for r in rows])
    mine = np.repeat(np.arange(len(rows)), counts) * base + np.searchsorted(all_tokens, np.concatenate([np.zeros(0, np.int64), *rows]))
    begins = np.concatenate([[0], np.cumsum(counts)])
    differs = np.zeros(len(inside), bool)
    differs[:1] = True
    differs[1:] = table[1:, 0] != table[:-1, 0]
    starts = np.flatnonzero(differs)
    # Roots: one node per key; every probe begins at the node of its key.
    if not len(inside):
        return np.zeros((2, 0), np.int64)
    probe = np.arange(len(rows))
    place = np.searchsorted(table[starts, 0], key)
    place[place == len(starts)] = 0
    hit = table[starts[place], 0] == key[probe]
    probe, node = probe[hit], place[hit]
    overlap, passed = np.zeros(len(probe), np.int64), np.zeros(len(probe), np.int64)
    pairs = []

    def met(p, o, q, begin, many, d):
        """Takes the ``many`` sets from place ``begin`` on as partners of each ``p``, if what remains can make a link."""
        p, o, q, begin = (np.repeat(v, many) for v in (p, o, q, begin))
        other = inside[begin + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)]
        left = np.minimum(n[p] - pos[p] - 1 - q, n[other] - pos[other] - 1 - d)
        good = (1 + o + left >= least_overlap(n[p], n[other], percent)) & (comp[p] != comp[other])
        good &= (side[p] == 2) | (side[p] != side[other])
        good &= (n[other] < n[p]) | ((n[other] == n[p]) & (other < p))
        p, other = p[good], other[good]
        new = ~met_before(head, p, other)
        pairs.append(np.stack([p[new], other[new]]))

    for d in range(depth + 1):
        ends = np.append(starts[1:], len(inside))
        # Rows that end at this node come first in it.
        done = np.concatenate([[0], np.cumsum(length == d)])
        here = done[ends[node]] - done[starts[node]]
        met(probe, overlap, passed, starts[node], here, d)
        if d == depth:
            break
        # Children: runs of equal tokens below each node, without the rows that ended.
        alive = length > d
        differs = differs | np.append(True, table[1:, d + 1] != table[:-1, d + 1])
        child = np.flatnonzero(differs & alive)
        if not len(child):
            break
        parent = np.searchsorted(starts, child, side="right") - 1
        many = np.bincount(parent, minlength=len(starts))
        low = np.concatenate([[0], np.cumsum(many)])
        grow = many[node]
        p, o = np.repeat(probe, grow), np.repeat(overlap, grow)
        kid = np.repeat(low[node], grow) + np.arange(len(p)) - np.repeat(np.cumsum(grow) - grow, grow)
        token = table[child, d + 1][kid]
        at = np.searchsorted(mine, p * base + token)
        found = (at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == p * base + token) if len(mine) else np.zeros(len(p), bool)
        o = o + found
        q = np.minimum(at + found, begins[p + 1]) - begins[p]
        # Past the last token a probe shows, a mismatch proves nothing: all sets below are candidates, by their sizes.
        blind = (at == begins[p + 1]) & ~found
        until = np.minimum(np.append(child[1:], len(inside)), ends[parent])
        met(p[blind], o[blind], q[blind], child[kid[blind]], (until - child)[kid[blind]], d)
        p, o, q, kid = p[~blind], o[~blind], q[~blind], kid[~blind]
        # What the subtree of each child can reach at most.
        room = np.maximum.reduceat(n[inside] - pos[inside], child)[kid] - 1 - (d + 1)
        fewest = np.minimum.reduceat(n[inside], child)[kid]
        one = np.minimum.reduceat(comp[inside], child)[kid] == np.maximum.reduceat(comp[inside], child)[kid]
        same = one & (comp[inside][child][kid] == comp[p])
        keep = (1 + o + np.minimum(n[p] - pos[p] - 1 - q, room) >= least_overlap(n[p], fewest, percent)) & ~same
        probe, node, overlap, passed = p[keep], kid[keep], o[keep], q[keep]
        starts = child
        if not len(probe):
            break
    return np.concatenate(pairs, axis=1)


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from rows token, x, y, side, c, n, pos, comp, tail, head: trees of one key (token, x, y) after another."""
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pairs = rows = longest = 0

        def flush() -> pa.RecordBatch:
            key = np.concatenate([np.full(len(g[0]), i) for i, g in enumerate(held)])
            side, c, n, pos, comp = (np.concatenate([g[i] for g in held]) for i in range(5))
            tails, heads = ([r for g in held for r in g[i]] for i in (5, 6))
            head = np.full((len(heads), HEAD), -1, np.int64)
            for i, r in enumerate(heads):
                head[i, : len(r)] = r
            found = tree_pairs(key, side, tails, n, pos, comp, percent, head)
            return pa.RecordBatch.from_arrays([pa.array(c[found[0]]), pa.array(c[found[1]])], names=names)

        def feed(state: list, b: pa.RecordBatch) -> None:
            rows = []
            for lists in (b.column("tail"), b.column("head")):
                offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
                rows.append([flat[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
            state.append([*(b.column(x).to_numpy() for x in ("side", "c", "n", "pos", "comp")), *rows])

        def finish(state: list) -> tuple:
            cols = [np.concatenate([s[i] for s in state]) for i in range(5)]
            return (*cols, *([r for s in state for r in s[i]] for i in (5, 6)))

        for group in per_key(batches, ["token", "x", "y"], lambda key: [], feed, finish):
            held.append(group)
            pairs, rows = pairs + len(group[0]) ** 2, rows + len(group[0])
            longest = max(longest, *map(len, group[5]))
            if pairs > 1 << 18 or rows * longest > 1 << 20:  # what one forest may hold
                yield flush()
                held, pairs, rows, longest = [], 0, 0, 0
        if held:
            yield flush()

    dealt = entries.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _texts(docs: DataFrame, reps: DataFrame, need: DataFrame) -> DataFrame:
    """(c, text) of the classes in ``need`` (c), one text each.

    Before anything is shuffled, rows whose text hash falls on no counter of a needed one are left out.
    """
    used = written(reps.join(need.distinct(), "c", "left_semi").select("c", "th"), "used")
    mask = counted(used.select("th"), lambda b: b.column("th").to_numpy() & (MASK - 1), MASK) > 0

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(mask[b.column("th").to_numpy() & (MASK - 1)]))

    rows = docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(maybe, "th long, text string")
    once = rows.groupBy("th").agg(F.min("text").alias("text"))
    return written(once.join(used, "th").select("c", "text"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 256):
                b = whole.slice(i, 256)
                with _quiet():
                    (ha, fa), (hb, fb) = (ngram_hashes(b.column(c), size) for c in ("ta", "tb"))
                keep = []
                for r in range(len(b)):
                    x, y = ha[fa[r] : fa[r + 1]], hb[fb[r] : fb[r + 1]]
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    keep.append(int((x[at] == y).sum()) >= least_overlap(len(x), len(y), percent))
                good = b.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([good.column("a"), good.column("b")], names=["a", "b"])

    a = texts.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(check, "a long, b long")


def _linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The ``pairs`` whose whole texts link, written; the texts that were gathered for them go."""

    def make() -> DataFrame:
        fair = written(_fair(pairs, reps, percent), "fair_pairs")
        need = fair.select(F.explode(F.array("a", "b")).alias("c"))
        return _verified(fair, _texts(docs, reps, need), percent, size)

    return settled(make, "links")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, row: str | None = None, size: int = WORDS) -> DataFrame:
    """doc_id, n, component per row of ``docs`` (doc_id, text), and its number ``row`` if asked for; component null without words."""
    rank, most = global_order(docs, size)
    sets = written(_sets(docs, rank, percent, row, size), "sets")
    # Rows with one set are one class; every class is joined once, by its first row.
    classes = written(
        sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("uid").alias("c"), F.count("*").alias("rows")), "classes"
    )
    own = classes.select(F.col("c").alias("uid"))
    reps = sets.join(own, "uid").select(F.col("uid").alias("c"), "th", "n", "prefix", "sketch")
    reps = written(reps, "representatives")
    entries = reps.select("c", F.posexplode("prefix").alias("pos", "token"))
    hot = most << (64 - len(rank).bit_length()) if most < len(rank) else None
    shared = written(_shared(entries, hot), "shared")
    # First each class against the first class it shares most tokens with: groups of near copies come together by stars.
    ties = shared.where("c <> lead").groupBy("c", "lead").agg(F.count("*").alias("k"))
    stars = ties.groupBy("c").agg(F.max(F.struct("k", (-F.col("lead")).alias("l"))).alias("m"))
    # Only with a fair part of the prefix in common; what this leaves out is for the trees below.
    stars = stars.join(reps.select("c", F.size("prefix").alias("size")), "c").where(F.col("m.k") * 4 >= F.col("size"))
    stars = stars.select(F.col("c").alias("a"), (-F.col("m.l")).alias("b"))
    stars = written(stars, "star_pairs")
    linked = _linked(docs, reps, stars, percent, size)
    comp = settled(lambda: components(linked), "components")
    # Then every pair of different components that some prefix tree cannot rule out.
    half = 2 * percent  # a set meets those not smaller by fewer tokens: see tree_length
    shortest = lambda a, b: F.ceil((a + b) * percent / (100 + percent))
    owned = shared.join(reps.select("c", "n"), "c").join(comp, F.col("c") == comp["node"], "left").select(
        "token", "pos", "c", "n", F.coalesce("component", "c").alias("comp"),
        (F.col("pos") < F.col("n") - F.ceil(F.col("n") * half / (100 + percent)) + 1).alias("tree"),
    )
    low = F.min(F.when(F.col("tree"), F.col("n"))).alias("low")
    open_tokens = owned.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), low, F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")
    open_tokens = open_tokens.where("lo < hi and low is not null").select("token", "low", blocks)
    # A row outside of the tree needs a smaller set in it; with the smallest there may be, its rest must suffice.
    least = F.greatest("low", F.ceil(F.col("n") * percent / 100))
    rows = owned.join(open_tokens, "token").where(F.col("tree") | (F.col("n") - F.col("pos") >= shortest(least, F.col("n"))))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("oth", other).withColumns({"x": F.least("blk", "oth"), "y": F.greatest("blk", "oth")})
    side = F.when(F.col("blk") == F.col("oth"), 2).when(F.col("blk") == F.col("x"), 0).otherwise(1)
    rows = rows.withColumn("side", side).join(reps.select("c", "prefix"), "c")
    # What can be told apart is told by the tokens up to the tree's length; the last rows show a few more.
    show = F.greatest(F.lit(8), F.col("n") - F.ceil(F.col("n") * half / (100 + percent)) - F.col("pos"))
    tail = F.slice("prefix", F.col("pos") + 2, F.least(show, F.size("prefix") - F.col("pos") - 1).cast("int"))
    begin = F.greatest(F.col("pos") - HEAD, F.lit(0))
    head = F.slice("prefix", begin + 1, F.col("pos") - begin).alias("head")
    # The tail goes by the high halves of its tokens, in the same order: tokens that look equal only make a candidate more.
    tail = F.transform(tail, lambda t: F.shiftright(t, 32).cast("int"))
    rows = rows.select("token", "x", "y", "side", "c", "n", F.col("pos").cast("long").alias("pos"), "comp", tail.alias("tail"), head)
    pairs = written(_candidates(rows, percent), "candidates")
    more = _linked(docs, reps, pairs, percent, size)
    final = components(linked.union(more))
    named = classes.join(final, classes["c"] == final["node"], "left").select(
        "s1", "s2", F.col("n").alias("size"), F.coalesce("component", "c").alias("component")
    )
    same = (sets["s1"] == named["s1"]) & (sets["s2"] == named["s2"]) & (sets["n"] == named["size"])
    return sets.join(named, same, "left").select("row", "doc_id", "n", "component")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable over links.

    Two texts link when 100 * shared >= ``percent`` * all of their distinct 3-word n-grams (A-Z lower-cased).
    N-grams are 64-bit hashes.  All links between different sets are found or implied: a pair is only left out when its
    two sets are connected already.  Rows with equal sets are one class from the start, and a group of any size is split
    into blocks, so no key gathers in one task and no group is expanded into all its pairs.

    Null and word-free texts are empty: 0 n-grams, linked with nothing, their own component; texts of one or two
    words are one n-gram; repeated rows share their component; a null id never names a component unless
    nothing else is in it; an empty table gives an empty result; other columns are ignored.
    """
    rows = settled(lambda: jaccard_classes(docs, percent).drop("row"), "rows")
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "component", "left")
    name = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, size: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (null ids last), of equal ids the first row read.

    Texts link by ``size``-word n-grams, as in ``jaccard_components``.
    Rows without words are linked with nothing and all stay.  The columns of ``docs`` are kept as they are.
    """
    uid = free_name(docs, "__uid")
    base = written(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    rows = base.select("doc_id", "text", F.col(uid).alias("row"))
    classes = settled(lambda: jaccard_classes(rows, percent, "row", size).select("doc_id", "row", "component"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("k"))
    stay = classes.where("component is not null").groupBy("component").agg(first.alias("k")).select(F.col("k.row").alias(uid))
    empty = classes.where("component is null").select(F.col("row").alias(uid))
    return base.join(stay.union(empty), uid, "left_semi").drop(uid)
