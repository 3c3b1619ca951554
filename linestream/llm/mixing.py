"""Mixing sources to target weights by blocks drawn per shard and looked up by index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linestream.llm.common import free_name, mix64, running_total, settled, text_buffers, word_spans, written

BLOCK_WORDS = 128
#: A source is cut into at least so many blocks (of a word at least), so that whole blocks come near its target.
LEAST_BLOCKS = 64
SHARD_BLOCKS = 1024
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes, and the most a target may be of its source.
SHARE, LIMIT = 1.5, 2.0


@dataclass(frozen=True)
class Mix:
    """``rows``: one row per input row (uid, size, source_size, target, taken); ``pieces``: uid, begin, length, times;
    ``uses``: the mix itself, uid, begin, length, shard, place: the words that stand at a place of an output shard;
    ``shards``: blocks of each source in each output shard (shard, source, blocks)."""

    rows: DataFrame
    pieces: DataFrame
    uses: DataFrame
    shards: DataFrame


def word_counts(df: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    """Adds the number of words of ``text`` (null: 0) and drops the text."""
    keep = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = word_spans(*text_buffers(b.column(text)))[2]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in keep), pa.array(np.diff(first))], names=schema.names
            )

    return df.mapInArrow(count, schema)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares of ``share`` times all words by weight, none above ``limit`` times its source.

    Sources in code-point order, null last, take the weights in turn.  What a full source cannot take is shared
    again by weight until no target is above its limit.  Every round is one aggregate; a round fills at least one
    more source, and sources that are filled at the same level fill together.  Sources without words get 0.
    """
    ordered = sizes.withColumn("__none", F.col("source").isNull().cast("int")).withColumn("__one", F.lit(1))
    ranked = running_total(ordered, ["__none", "source"], "__one", "__rank")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("__rank", F.lit(len(weights))) + 1).cast("int"))
    s = ranked.withColumn("__w", weigh).withColumn("__most", F.col("source_size") * F.lit(float(limit)))
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        capped = F.col("__most") <= F.col("__w") * F.lit(level)
        n, taken, open_w = s.agg(
            F.count(F.when(capped, 1)),
            F.coalesce(F.sum(F.when(capped, F.col("__most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("__w"))), F.lit(0.0)),
        ).first()
        if n == full or not open_w:
            break
        full, level = n, max(level, (total - taken) / open_w)
    return s.withColumn("target", F.least("__most", F.col("__w") * F.lit(level))).select("source", "source_size", "target")


def shuffled(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of ``i`` under a pseudorandom permutation of range(n) chosen by ``key`` (all arrays).

    A four-round Feistel network on the next even number of bits; places beyond ``n`` walk on until they fall inside.
    """
    x, n = i.astype(np.uint64), n.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    key = key.astype(np.uint64)
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for turn in range(4):
            salt = key[todo] + np.uint64(turn * 0x9E3779B9)
            left, right = right, left ^ (mix64(right * np.uint64(0x9E3779B97F4A7C15) ^ mix64(salt)) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _slots(s: DataFrame, total: int, shard_blocks: int, seed: int) -> DataFrame:
    """One row per slot of the mix: sid, block, shard, place.

    Slot j of a source is block (permutation of the source)(j), a new permutation for each pass over the source.
    Its place in the output is a pseudorandom permutation of all slots: so each shard's counts per source are a
    multinomial draw by the quotas, conditioned on their exact totals, and no draw depends on another shard.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, n, before, begin, stop = (b.column(c).to_numpy() for c in ("sid", "blocks", "before", "begin", "stop"))
            for k in range(len(sid)):
                j = np.arange(begin[k], stop[k], dtype=np.int64)
                turn = j // n[k]
                keys = mix64((turn * 1_000_003 + int(sid[k]) * 7919 + seed).astype(np.uint64))
                block = shuffled(j % n[k], np.full(len(j), n[k]), keys)
                at = shuffled(before[k] + j, np.full(len(j), total), np.full(len(j), seed + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), sid[k])), pa.array(block), pa.array(at // shard_blocks), pa.array(at % shard_blocks)],
                    names=["sid", "block", "shard", "place"],
                )

    step = 1 << 14
    runs = s.where("slots > 0").withColumn("begin", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, F.lit(step))))
    runs = runs.select("sid", "blocks", "before", "begin", F.least(F.col("begin") + step, "slots").alias("stop"))
    return runs.repartition(F.xxhash64("sid", "begin")).mapInArrow(place, "sid long, block long, shard long, place long")


def mix(
    docs: DataFrame,
    *,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    weights=WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: int = 17,
    order: tuple[str, ...] = (),
) -> Mix:
    """Mixes ``docs`` (uid unique, source, size; a written table) to the targets of their sources.

    The words of a source, by ``order`` and then uid, are cut into blocks of ``block_words``, or of fewer words where that
    would make fewer than ``LEAST_BLOCKS``.  With an order by what the rows hold, neither the files nor the partitions they came
    in matter: only equal rows can change places.  A source gets as many slots as its target holds of its blocks, at most ``limit`` (2) times all of them, so a document is used at most that often.
    Slots find their block by index, in a join on (source, block), whose keys are even however large a source is.
    Documents without words take no part and are taken 0 times.  The same input and seed give the same mix.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = targets(sizes, weights, share, limit)
    words = F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    src = src.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / F.col("words")).cast("long"))
    want = F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long")
    src = src.withColumn("slots", F.when(F.col("source_size") > 0, F.least(want, (F.col("blocks") * limit).cast("long"))).otherwise(0))
    src = src.withColumn("__none", F.col("source").isNull().cast("int")).withColumn("__one", F.lit(1))
    src = running_total(running_total(src, ["__none", "source"], "slots", "before"), ["__none", "source"], "__one", "sid")
    src = written(src.drop("__none", "__one"), "sources")
    total = src.agg(F.sum("slots")).first()[0] or 0
    slots = _slots(src, max(total, 1), shard_blocks, seed)
    slots = written(slots, "slots")
    # Where each document starts within its source.
    rows = docs.withColumn("__none", F.col("source").isNull().cast("int"))
    rows = running_total(rows, ["__none", "source", *order, "uid"], "size", "__at").drop("__none")
    starts = src.withColumn("__none", F.col("source").isNull().cast("int"))
    starts = running_total(starts, ["__none", "source"], "source_size", "__from").drop("__none", "before")
    on = rows["source"].eqNullSafe(starts["source"])
    rows = rows.join(starts, on).drop(starts["source"])  # sources are few rows: adaptive execution broadcasts or splits
    rows = written(rows.withColumn("__at", F.col("__at") - F.col("__from")), "placed")
    first, last = F.floor(F.col("__at") / F.col("words")), F.floor((F.col("__at") + F.col("size") - 1) / F.col("words"))
    pieces = rows.where("size > 0").select("uid", "sid", "__at", "size", "words", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * F.col("words") - F.col("__at"))
    end = F.least("size", (F.col("block") + 1) * F.col("words") - F.col("__at"))
    pieces = pieces.select("uid", "sid", "block", begin.alias("begin"), (end - begin).alias("length"))
    used = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    drawn = pieces.join(used, ["sid", "block"]).select("uid", "begin", "length", "times")
    taken = drawn.groupBy("uid").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    out = rows.join(taken, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    # Each slot's words, looked up by (source, block) like the counts above.
    uses = pieces.join(slots, ["sid", "block"]).select("uid", "begin", "length", "shard", "place")
    shards = slots.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("blocks"))
    shards = shards.join(src.select("sid", "source"), "sid").select("shard", "source", "blocks")
    return Mix(out.drop("__at", "__from", "sid", "words", "blocks", "slots"), drawn, uses, shards)


def mix_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    Null texts have size 0; a null source is a source of its own, last in order; repeated rows are rows of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    sized = word_counts(docs.select("doc_id", "source", F.xxhash64("text").alias("__text"), "text"))
    base = written(sized.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    out = mix(base, order=("doc_id", "__text")).rows
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of ``text`` in ``ranges`` (begin, length; sorted), with the white space between words of one run."""
    runs: list[list[int]] = []
    for b, n in ranges:
        if runs and runs[-1][1] == b:
            runs[-1][1] = b + n
        else:
            runs.append([b, b + n])
    raw = text.encode()
    starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    if runs == [[0, len(starts)]]:
        return text
    return "\n".join(raw[starts[b] : ends[e - 1]].decode() for b, e in runs)


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each use of a document a row with its columns and the words of it that this use takes.

    A use that takes all words keeps the text as it is.  ``n_chars``, where there is one, follows the text.
    """
    uid, ranges = free_name(docs, "__uid"), free_name(docs, "__ranges")
    base = written(docs.withColumn(uid, F.monotonically_increasing_id()), "texts")
    row = F.xxhash64(*[F.col(c) for c in docs.columns if c != "text"])
    sized = word_counts(
        base.select(F.col(uid).alias("uid"), "doc_id", "source", F.xxhash64("text").alias("__text"), row.alias("__row"), "text")
    )

    def drawn() -> DataFrame:
        pieces = mix(written(sized, "sizes"), order=("doc_id", "__text", "__row")).pieces
        uses = pieces.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        return uses.groupBy(F.col("uid").alias(uid), "use").agg(
            F.sort_array(F.collect_list(F.struct("begin", "length"))).alias(ranges)
        )

    uses = settled(drawn, "uses")
    cols = docs.columns
    joined = base.join(uses.drop("use"), uid).drop(uid)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").to_pylist()
            spans = b.column(ranges).to_pylist()
            new = [_cut(t, [(r["begin"], r["length"]) for r in rs]) for t, rs in zip(text, spans, strict=True)]
            put = {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                put["n_chars"] = pa.array([len(t) for t in new], b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([put.get(c, b.column(c)) for c in cols], names=cols)

    return joined.mapInArrow(cut, docs.schema)


def mixed_shards(docs: DataFrame) -> DataFrame:
    """The mix as output shards: shard, place, source, doc_id, words, text, a row for each document's words at a place of a shard.

    A shard holds ``SHARD_BLOCKS`` places; each holds a block of one source, drawn by index, whose words may come from several
    documents.  How many places a source has in a shard is the draw (see ``_slots``).  Odd rows as in ``mix_documents``.
    """
    base = written(docs.select("doc_id", "source", "text").withColumn("uid", F.monotonically_increasing_id()), "texts")
    sized = word_counts(base.select("uid", "doc_id", "source", F.xxhash64("text").alias("__text"), "text"))
    uses = mix(written(sized, "sizes"), order=("doc_id", "__text")).uses
    # A document's uses are brought to it as they are, so that its text moves once.
    told = uses.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("shard", "place", "begin", "length"))).alias("uses"))
    joined = base.join(told, "uid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources, texts, spans = (b.column(c).to_pylist() for c in ("doc_id", "source", "text", "uses"))
            for i, s, t, us in zip(ids, sources, texts, spans, strict=True):
                raw = t.encode()
                starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                text = [raw[starts[u["begin"]] : ends[u["begin"] + u["length"] - 1]].decode() for u in us]
                n = len(us)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([u["shard"] for u in us], pa.int64()), pa.array([u["place"] for u in us], pa.int64()),
                        pa.array([s] * n, pa.string()), pa.array([i] * n, pa.int64()), pa.array([u["length"] for u in us], pa.int64()), pa.array(text, pa.string()),
                    ],
                    names=["shard", "place", "source", "doc_id", "words", "text"],
                )

    return joined.mapInArrow(cut, "shard long, place long, source string, doc_id long, words long, text string")
