"""Language-model scores of documents by an n-gram trie, built and asked shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestream.llm.common import mix64, word_hashes, written
from linestream.llm.quality import fold
from linestream.llm.trie import WORD_BITS, NgramTrie
from linestream.llm.vectors import per_key

#: Tokens and documents of a block, tokens a shard answers for on average.
BLOCK_TOKENS, BLOCK_DOCS, SHARD_TOKENS = 1 << 20, 60_000, 1 << 20
#: Bytes of messages that leave a task at once.
BATCH_BYTES = 1 << 20
#: Weight of the single-word model behind a context; added to each word's count.
PRIOR, ADD = 4.0, 0.1
#: Bits of a word hash; the hashes of a text's end and start.
HASH_BITS = 56
END, START = np.uint64(0x4D3C2B1A09F8E7), np.uint64(0x2C3D4E5F60718A)
_MASK = np.uint64((1 << WORD_BITS) - 1)
#: Bits of a context's hash within its shard.
CONTEXT_BITS = 48
_CONTEXT = np.uint64((1 << CONTEXT_BITS) - 1)
_CODE = 64.0


def _raw(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _zip(a: np.ndarray) -> bytes:
    """An array byte plane by byte plane, compressed: small numbers leave their upper planes empty."""
    raw = _raw(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T) if len(a) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unzip(b: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(b[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _narrow(a: np.ndarray, bits: int) -> bytes:
    """64-bit numbers by their lowest ``bits`` bits."""
    return _raw(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, : bits // 8])


def _widen(b: bytes, bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits as 64-bit ones."""
    few = np.frombuffer(b, np.uint8).reshape(-1, bits // 8)
    wide = np.zeros((len(few), 8), np.uint8)
    wide[:, : bits // 8] = few
    return wide.view(np.uint64).ravel()


def _row(**cols) -> pa.RecordBatch:
    """One row; bytes are binary, ints long, lists of ints long arrays."""
    return pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in cols.items()})


def _sent(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows of bytes and ints as batches of up to ``BATCH_BYTES``: a batch costs far more than a small row."""
    kept: dict[str, list] = {}
    size = 0
    for r in rows:
        for k, v in r.items():
            kept.setdefault(k, []).append(v)
            size += len(v) if isinstance(v, bytes) else 8
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in kept.items()})
            kept, size = {}, 0
    if kept:
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in kept.items()})


def _blocks(docs: DataFrame, folds: int) -> DataFrame:
    """Runs of documents as numbers: doc_ids, held, sizes (with the end), words (distinct hashes), tokens (places in words)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []
        tokens = docs_ = 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([k[2] for k in kept])
            places, words = pd.factorize(flat)
            by = np.argsort(-np.bincount(places), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by))
            words, places = words[by], rank[places]
            ids = [i for k in kept for i in k[0]]
            return _row(
                block=block, ids=_raw(np.array([i or 0 for i in ids], np.int64)), none=_raw(np.array([i is None for i in ids])),
                held=_raw(np.concatenate([k[1] for k in kept])), sizes=_raw(np.concatenate([k[3] for k in kept])),
                words=_narrow(words, HASH_BITS), tokens=_zip(places),
            )

        for whole in batches:
            for i in range(0, len(whole), 256):
                b = whole.slice(i, 256)
                h, first = word_hashes(b.column("text"))
                sizes = np.diff(first) + 1
                flat = np.insert(h & np.uint64((1 << HASH_BITS) - 1), first[1:], END)
                kept.append((b.column("doc_id").to_pylist(), np.array(b.column("held").to_pylist(), bool), flat, sizes))
                tokens, docs_ = tokens + len(flat), docs_ + len(b)
                if tokens >= BLOCK_TOKENS or docs_ >= BLOCK_DOCS:
                    yield flush()
                    block, kept, tokens, docs_ = block + 1, [], 0, 0
        if kept:
            yield flush()

    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held"))
    kind = "block long, ids binary, none binary, held binary, sizes binary, words binary, tokens binary"
    return rows.mapInArrow(pack, kind)


def _open(b: dict) -> dict:
    kinds = {"ids": np.int64, "none": bool, "held": bool, "sizes": np.int64}
    known = {k: np.frombuffer(b[k], t) for k, t in kinds.items()}
    return known | {"block": b["block"], "words": _widen(b["words"], HASH_BITS), "tokens": _unzip(b["tokens"], np.int32)}


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings the rows of a shard together, otherwise as they were, and where each shard begins in it."""
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards))])


def _shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(words ^ np.uint64(77)) % np.uint64(shards)).astype(np.int64)


def _word_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """block, shard, counts (training count of each of the block's words in this shard, in order), known (once a shard)."""

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for raw in batch.to_pylist():
                b = _open(raw)
                train = np.repeat(~b["held"], b["sizes"])
                n = np.bincount(b["tokens"][train], minlength=len(b["words"]))
                order, cuts = _by_shard(_shard_of(b["words"], shards), shards)
                words, n = b["words"][order], n[order].astype(np.int64)
                for s in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[s], cuts[s + 1])
                    yield {"shard": int(s), "block": b["block"], "words": _narrow(words[part], HASH_BITS), "n": _zip(n[part])}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(messages(batches))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(state: list) -> pa.RecordBatch:
            words = [_widen(r["words"], HASH_BITS) for r in state]
            distinct, place = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(place, np.concatenate([_unzip(r["n"], np.int64) for r in state]), len(distinct)).astype(np.int64)
            ends = np.cumsum([len(w) for w in words])
            counts = [_zip(total[p]) for p in np.split(place, ends[:-1])]
            known = [int((total > 0).sum())] + [0] * (len(state) - 1)
            cols = [[r["block"] for r in state], [r["shard"] for r in state], counts, known]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "shard", "counts", "known"])

        yield from per_key(batches, ["shard"], lambda key: [], lambda s, b: s.extend(b.to_pylist()), finish)

    asked = blocks.mapInArrow(ask, "shard long, block long, words binary, n binary")
    dealt = asked.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(answer, "block long, shard long, counts binary, known long")


def _counted(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``blocks`` with ``c``: the counts of their words, shard by shard."""
    by_block = counts.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("c"))
    return blocks.join(by_block, "block")


def _opened(raw: dict, shards: int) -> dict:
    """A row of ``_counted`` opened, ``c`` being the training count of each word."""
    b = _open(raw)
    order, _ = _by_shard(_shard_of(b["words"], shards), shards)
    c = np.zeros(len(order), np.int64)
    c[order] = np.concatenate([_unzip(part["counts"], np.int64) for part in raw["c"]])  # every word has a shard that counts it
    return b | {"c": c}


def _ngrams(b: dict, total: int, shards: int) -> dict:
    """Distinct n-grams of a block in the order in which its shards are asked and answer; where they begin among its tokens.

    By shard, then by context: ``v``, ``w`` are context and word, ``uses`` of them are in the documents ``where``.
    """
    words, sizes, tok = b["words"], b["sizes"], b["tokens"]
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    before = np.concatenate([[0], tok[:-1]]).astype(np.int64)
    before[np.cumsum(sizes) - sizes] = len(words)
    pair = before * (len(words) + 1) + tok
    order = np.argsort(pair, kind="stable")
    p = pair[order]
    begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    v, w = p[begin] // (len(words) + 1), p[begin] % (len(words) + 1)
    uses = np.diff(np.append(begin, len(p)))
    cv, hw = np.append(words, START)[v] & _CONTEXT, words[w] & _MASK
    # The start of a text is as frequent as its end.
    of = np.append(b["c"], b["c"][np.flatnonzero(words == END)[0]])
    slices = 1 + of[v] * 4 * shards // max(total, 1)
    by, cuts = _by_shard((mix64(cv ^ np.uint64(991)) + hw % slices.astype(np.uint64)) % np.uint64(shards), shards)
    uses = uses[by]
    spots = np.repeat(begin[by] - (np.cumsum(uses) - uses), uses) + np.arange(len(p))
    return {"v": v[by], "w": w[by], "context": cv[by], "word": hw[by], "uses": uses, "where": doc[order][spots], "cuts": cuts, "before": before, "of": of}


def _asked(counted: DataFrame, total: int, shards: int) -> DataFrame:
    """Per block and shard the block's n-grams that the shard knows of.

    N-grams go by their context; a context with many tokens is dealt to several shards by its successors.
    """

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for raw in batch.to_pylist():
                b = _opened(raw, shards)
                g = _ngrams(b, total, shards)
                cv, cuts = g["context"], g["cuts"]
                first = np.cumsum(g["uses"]) - g["uses"]
                n = np.add.reduceat((~b["held"])[g["where"]].astype(np.int64), first).astype(np.uint32)
                prior = np.rint(np.log2(b["c"][g["w"]] + ADD) * _CODE + 4 * _CODE).astype(np.uint16)
                new = np.append(True, cv[1:] != cv[:-1])
                new[cuts[:-1][np.diff(cuts) > 0]] = True
                start = np.flatnonzero(new)
                many, at = np.diff(np.append(start, len(cv))).astype(np.uint32), np.searchsorted(start, cuts)
                context, word = _narrow(cv[start], CONTEXT_BITS), _narrow(g["word"], WORD_BITS)
                cb, wb = CONTEXT_BITS // 8, WORD_BITS // 8
                for k in np.flatnonzero(np.diff(cuts)):
                    i, j, x, y = cuts[k], cuts[k + 1], at[k], at[k + 1]
                    yield {
                        "shard": int(k), "block": b["block"], "context": context[x * cb : y * cb], "many": _zip(many[x:y]),
                        "word": word[i * wb : j * wb], "prior": _zip(prior[i:j]), "n": _zip(n[i:j]),
                    }

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sent(messages(batches))

    return counted.mapInArrow(ask, "shard long, block long, context binary, many binary, word binary, prior binary, n binary")


def _answered(asked: DataFrame, scale: float) -> DataFrame:
    """block, shard, low, step, codes: what the trie of each shard has for the n-grams of each block, in their order there.

    A code of 0 stands for none; from 1 on they are the trie's own.
    """

    def finish(state: list) -> pa.RecordBatch:
        blocks, shards = ([r[k] for r in state] for k in ("block", "shard"))
        many = np.concatenate([_unzip(r["many"], np.uint32) for r in state])
        context = np.repeat(_widen(b"".join(r["context"] for r in state), CONTEXT_BITS), many)
        word = _widen(b"".join(r["word"] for r in state), WORD_BITS)
        prior, n = (np.concatenate([_unzip(r[k], t) for r in state]) for k, t in (("prior", np.uint16), ("n", np.uint32)))
        ends = np.cumsum([len(r["word"]) // (WORD_BITS // 8) for r in state])
        state.clear()
        # Each distinct n-gram is learned and asked for once, for all blocks that have it.
        order = np.lexsort((word, context))
        cv, hw = context[order], word[order]
        new = np.append(True, (cv[1:] != cv[:-1]) | (hw[1:] != hw[:-1]))
        begin = np.flatnonzero(new)
        cv, hw, count = cv[begin], hw[begin], np.add.reduceat(n[order].astype(np.int64), begin)
        learn = count > 0
        one = np.exp2((prior[order[begin]][learn].astype(np.float64) - 4 * _CODE) / _CODE) / scale
        trie = NgramTrie.build(cv[learn], hw[learn], np.log10(1 + count[learn] / (PRIOR * one)))
        place = trie.places(cv, hw)
        known = np.zeros(len(place), np.uint16)
        known[place >= 0] = trie.codes[place[place >= 0]].astype(np.uint16) + np.uint16(1)
        found = np.empty(len(order), np.uint16)
        found[order] = known[np.cumsum(new) - 1]
        codes = [_zip(x) for x in np.split(found, ends[:-1])]
        cols = [blocks, shards, [trie.low] * len(blocks), [trie.step] * len(blocks), codes]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "shard", "low", "step", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return per_key(batches, ["shard"], lambda key: [], lambda s, b: s.extend(b.to_pylist()), finish)

    dealt = asked.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "block long, shard long, low double, step double, codes binary")


def score_documents(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is a word-pair model over all documents outside of the held-out fold: the count of a pair plus ``PRIOR`` times the
    single-word probability, over the count of its context plus ``PRIOR``; the start of a text is a context too.  The logarithm
    of what a seen pair adds to its single-word part is stored, quantised, in Elias-Fano tries.

    Documents become blocks of numbers, written once.  Words, then pairs, are dealt to shards by hash, distinct within a
    block; a shard sums the training counts of all blocks, and answers all blocks with a code per pair.  Which documents use
    a pair is worked out where the block is, once to ask and once to put the answers in.  A frequent context is dealt
    to as many shards as its count asks for.  The number of shards follows the tokens, so a shard's memory does not grow.
    Word counts are exact up to 56-bit hashes of words.

    Null and empty texts are one end token; null ids are learned from and not held out; repeated rows are scored alike; without
    training documents nothing is known; an empty table gives an empty result; other columns are ignored.
    """
    blocks = written(_blocks(docs, folds), "blocks")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = train = 0
        for batch in batches:
            for raw in batch.to_pylist():
                sizes, held = np.frombuffer(raw["sizes"], np.int64), np.frombuffer(raw["held"], bool)
                every, train = every + int(sizes.sum()), train + int(sizes[~held].sum())
        yield pa.RecordBatch.from_arrays([pa.array([every]), pa.array([train])], names=["every", "train"])

    got = blocks.select("sizes", "held").mapInArrow(sums, "every long, train long").agg(F.sum("every"), F.sum("train")).first()
    every, total = got[0] or 0, got[1] or 0
    shards = max(8, -(-every // SHARD_TOKENS))
    counts = written(_word_counts(blocks.select("block", "ids", "none", "held", "sizes", "words", "tokens"), shards), "word_counts")
    known = counts.agg(F.sum("known")).first()[0] or 0
    scale = total + ADD * (known + 1)
    counted = _counted(blocks, counts)
    answered = _answered(_asked(counted, total, shards), scale)
    said = answered.groupBy("block").agg(F.collect_list(F.struct("shard", "low", "step", "codes")).alias("said"))

    def score(raw: dict) -> pa.RecordBatch:
        b = _opened(raw, shards)
        g, c, tok, docs = _ngrams(b, total, shards), b["c"], b["tokens"], len(b["sizes"])
        doc = np.repeat(np.arange(docs), b["sizes"])
        base = np.bincount(doc, np.log10((c + ADD) / scale)[tok], docs)
        rest = base + np.bincount(doc, np.log10(PRIOR / (g["of"] + PRIOR))[g["before"]], docs)
        value = np.zeros(len(g["uses"]))
        for r in raw["said"]:
            codes, at = _unzip(r["codes"], np.uint16), slice(g["cuts"][r["shard"]], g["cuts"][r["shard"] + 1])
            value[at] = np.where(codes > 0, r["low"] + (codes.astype(np.float64) - 1) * r["step"], 0.0)
        gain = np.bincount(g["where"], np.repeat(value, g["uses"]), docs)
        ids = pa.array(b["ids"], mask=b["none"])
        seen = np.bincount(doc, c[tok] > 0, docs).astype(np.int64)
        cols = [ids, b["held"], b["sizes"], seen, np.full(docs, total), base, rest + gain]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield score(batch.slice(i, 1).to_pylist()[0])

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted.join(said, "block").mapInArrow(join, kind)
