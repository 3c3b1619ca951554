"""Alignment of two tokenizers over the same texts, and how widely each pair of their ids is linked."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestream.llm.common import written

BYTES_FILE, RANKS_FILE, PIECES_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Characters of a slice of documents that is aligned at once; a longer document is a slice of its own.
SLICE_CHARS = 2_000_000
#: Distinct id pairs after which a task closes its block: the size of the largest answer a task must hold.
BLOCK_PAIRS = 1 << 21
#: Texts outside these characters are encoded by the slower library (tests compare both).
_OTHER = re.compile("[^\x00-\x7eÀ-ɏ]")


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Side:
    """A tokenizer: ``encode`` gives an array of ids per text, ``pieces[id]`` the bytes of a token."""

    encode: object
    pieces: list[bytes]
    sizes: np.ndarray


def _byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable Latin-1 stands for itself, the rest is numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.cache
def byte_side(json_path: str | None = None, ranks_path: str | None = None) -> Side:
    """Space and text by a byte-level vocabulary; strings of special tokens are plain text.

    ``ranks_path`` is the same vocabulary as ranks: plain Latin texts go to the faster library then.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    if json_path is None:
        json_path, ranks_path = _file(BYTES_FILE), _file(RANKS_FILE)
    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = True
    letters = _byte_letters()
    with open(json_path, encoding="utf-8") as f:
        told = json.load(f)
    vocab = told["model"]["vocab"]
    pieces = [b""] * (max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]) + 1)
    for t in told["added_tokens"]:
        pieces[t["id"]] = t["content"].encode()
    for piece, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in piece)
    fast = None
    if ranks_path is not None:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if fast is None or _OTHER.search(text):
                ids = slow.encode(" " + text, add_special_tokens=False).ids
            else:
                ids = fast.encode_to_numpy(" " + text, disallowed_special=())
            out.append(np.asarray(ids, np.int64))
        return out

    return Side(encode, pieces, np.array([len(p) for p in pieces], np.int64))


@functools.cache
def piece_side(model_path: str | None = None) -> Side:
    """Text by a sentence-piece vocabulary with byte fallback, which puts the space before it itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path or _file(PIECES_FILE))
    pieces = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in sp.encode(texts, num_threads=1)]

    return Side(encode, pieces, np.array([len(p) for p in pieces], np.int64))


@dataclass
class Aligned:
    """The tokens of some documents, one after another, and how they meet.

    ``a`` / ``b``: ids; ``a_doc`` / ``b_doc``: index of their document; ``a_cut`` / ``b_cut``: the token ends where one of
    the other side ends; ``link_a`` / ``link_b``: positions of every pair of tokens whose bytes overlap.
    """

    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _tokens(side: Side, ids: list[np.ndarray], texts: list[str]) -> list[np.ndarray]:
    """``ids``, but none where the tokens are not exactly the bytes of space and text."""
    same = (b"".join(map(side.pieces.__getitem__, i.tolist())) == b" " + t.encode() for i, t in zip(ids, texts, strict=True))
    return [i if ok else i[:0] for i, ok in zip(ids, same, strict=True)]


def align(texts: list[str | None], left: Side, right: Side) -> Aligned:
    """Tokens of both sides and their overlaps.

    Two as-of joins, keyed by document: the start of each token finds the token of the other side that covers it.
    Two tokens overlap exactly if one of their starts lies in the other, so both directions together
    are all overlaps; pairs that start together are found twice and kept once.
    """
    texts = [t or "" for t in texts]
    told = [t for t in texts if t]
    sides = []
    for side in (left, right):
        given = iter(_tokens(side, side.encode(told), told))
        sides.append([next(given) if t else np.zeros(0, np.int64) for t in texts])
    for k in range(len(texts)):  # a document counts only if both sides tell its bytes
        if not len(sides[0][k]) or not len(sides[1][k]):
            sides[0][k] = sides[1][k] = np.zeros(0, np.int64)
    table, ends = [], []
    for side, ids in zip((left, right), sides, strict=True):
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        size = side.sizes[flat]
        end = np.cumsum(size)
        doc = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        table.append(pd.DataFrame({"start": end - size, "doc": doc, "at": np.arange(len(flat)), "id": flat}))
        ends.append(end)
    a, b = table
    covers = []
    for one, other in ((a, b), (b, a)):
        met = pd.merge_asof(one[["start", "doc"]], other[["start", "doc", "at"]], on="start", by="doc")
        covers.append(met["at"].to_numpy(np.int64) if len(one) else np.zeros(0, np.int64))
    a_start, b_start = a["start"].to_numpy(), b["start"].to_numpy()
    late = a_start[covers[1]] != b_start  # those that start together are in the other direction already
    cut = []
    for one, other in ((ends[0], ends[1]), (ends[1], ends[0])):
        place = np.searchsorted(other, one)
        cut.append(other[np.minimum(place, len(other) - 1)] == one if len(other) else np.zeros(0, bool))
    return Aligned(
        a["id"].to_numpy(), b["id"].to_numpy(), a["doc"].to_numpy(), b["doc"].to_numpy(), cut[0], cut[1],
        np.concatenate([np.arange(len(a)), covers[1][late]]),
        np.concatenate([covers[0], np.flatnonzero(late)]),
    )


@functools.cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n-1, left-aligned with room for one more character, and their number."""
    width = len(str(max(n - 1, 0)))
    out = np.zeros((n, width + 1), np.uint8)
    size = np.ones(n, np.int64)
    for d in range(1, width):
        size[10**d :] += 1
    left = np.arange(n)
    for place in range(width):
        rows = size > place
        out[rows, (size - 1 - place)[rows]] = ord("0") + left[rows] % 10
        left //= 10
    return out, size


def told_groups(x: Aligned, docs: int, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all documents as text, ``a1,a2|b1;a3|b2,b3;``, and where each document begins in it."""
    group_a, group_b = np.cumsum(x.a_cut) - x.a_cut, np.cumsum(x.b_cut) - x.b_cut
    first_b = np.concatenate([[0], np.flatnonzero(x.b_cut) + 1])
    next_a = np.flatnonzero(x.a_cut) + 1
    order = np.empty(len(x.a) + len(x.b), np.int64)
    mark = np.empty(len(order), np.uint8)
    at_a = np.arange(len(x.a)) + first_b[group_a]
    at_b = np.arange(len(x.b)) + (next_a[group_b] if len(next_a) else 0)
    order[at_a], order[at_b] = x.a, x.b
    mark[at_a], mark[at_b] = np.where(x.a_cut, ord("|"), ord(",")), np.where(x.b_cut, ord(";"), ord(","))
    digits, size = _digits(ids)
    text, length = digits[order], size[order]
    text[np.arange(len(order)), length] = mark
    flat = text[np.arange(digits.shape[1])[None, :] <= length[:, None]]
    upto = np.concatenate([[0], np.cumsum(length + 1)])
    tokens = np.bincount(x.a_doc, minlength=docs) + np.bincount(x.b_doc, minlength=docs)
    return flat, upto[np.concatenate([[0], np.cumsum(tokens)])]


def _slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if len(texts) > begin:
        yield begin, len(texts)


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of ``values`` as binary values; ``cuts`` has one more entry than there are stretches."""
    offsets = pa.py_buffer((cuts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


_BASE = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " codes binary, times binary, pairs binary, docs binary"
)


def _pair_lists(docs: DataFrame, json_path: str | None, ranks_path: str | None, model_path: str | None) -> DataFrame:
    """A row per document with its distinct id pairs (``codes``, ``times``), and rows with the pairs of a whole block.

    A block is what one task reads until it has met ``BLOCK_PAIRS`` distinct pairs; its rows ``pairs``, ``docs`` say how
    many of its documents hold each pair.
    """
    schema = pa.schema([(n, pa.string() if t == "string" else pa.binary() if t == "binary" else pa.int64())
                        for n, t in (c.split() for c in _BASE.split(","))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_side(json_path, ranks_path), piece_side(model_path)
        wide, ids = len(right.pieces), max(len(left.pieces), len(right.pieces))
        block = TaskContext.get().partitionId() << 24
        met, often = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def close() -> pa.RecordBatch:
            one = [pa.nulls(1, f.type) for f in schema]
            one[0] = pa.array([block])
            one[9], one[10] = pa.array([met.tobytes()], pa.binary()), pa.array([often.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(one, schema=schema)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _slices(texts, SLICE_CHARS):
                x, n = align(texts[i:j], left, right), j - i
                link_doc = x.a_doc[x.link_a]
                code = link_doc << 32 | (x.a[x.link_a] * wide + x.b[x.link_b])
                code.sort()
                new = np.concatenate([np.flatnonzero(np.diff(code, prepend=-1)), [len(code)]])
                times, code = np.diff(new).astype(np.uint32), code[new[:-1]]
                cuts = np.searchsorted(code, np.arange(n + 1, dtype=np.int64) << 32)
                pair = (code & 0xFFFFFFFF).astype(np.uint32)
                text, at = told_groups(x, n, ids)
                sha = [hashlib.sha256(text[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                count = [np.bincount(d, minlength=n) for d in (x.a_doc, x.b_doc, x.a_doc[x.a_cut], link_doc)]
                none = pa.nulls(n, pa.binary())
                cols = [pa.array(np.full(n, block)), batch.column("doc_id").slice(i, n), *map(pa.array, count), pa.array(sha)]
                yield pa.RecordBatch.from_arrays([*cols, _blobs(pair, cuts), _blobs(times, cuts), none, none], schema=schema)
                here, held = np.unique(pair, return_counts=True)
                every = np.concatenate([met, here])
                met, back = np.unique(every, return_inverse=True)
                often = np.bincount(back, np.concatenate([often, held]), len(met)).astype(np.int64)
                if len(met) >= BLOCK_PAIRS:
                    yield close()
                    block, met, often = block + 1, met[:0], often[:0]
        if len(met):
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _BASE)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, pairs, docs in zip(*(b.column(c).to_pylist() for c in ("block", "pairs", "docs")), strict=True):
            code, n = np.frombuffer(pairs, np.uint32).astype(np.int64), np.frombuffer(docs, np.int64)
            for i in range(0, len(code), 1 << 16):
                part = [pa.array(np.full(len(code[i : i + (1 << 16)]), block)), pa.array(code[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(part, names=["block", "code", "n"])


def alignment_digest(
    docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, model_path: str | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): how its tokens of both sides meet, and how common its id pairs are.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many documents as any pair of the same left
    id), count_sum (documents that hold the pair, over the links), groups_sha256.

    How many documents hold a pair is counted over all rows.  No text and no document's links are joined for it: a task
    sums its own documents' pairs into a block, blocks ask for their distinct pairs once, and the answer is
    looked up by the block's documents, which come past it in a stream.  The highest count of each left id is one
    row per entry of the vocabulary, so it is broadcast whatever the number of documents.

    Null and empty texts, and texts whose tokens do not give back space and text byte by byte, count 0 and ''.
    Repeated rows and null ids are documents of their own; an empty table gives an empty result; other columns are ignored.
    A document must fit into a task's memory with its tokens, about 150 bytes for each of its bytes.
    """
    base = written(_pair_lists(docs, json_path, ranks_path, model_path), "pairs")
    wide = len(piece_side(model_path).pieces)
    asked = base.where("pairs is not null").select("block", "pairs", "docs").mapInArrow(_unpack, "block long, code long, n long")
    held = written(asked.groupBy("code").agg(F.sum("n").alias("n")), "held").withColumn("a", F.floor(F.col("code") / wide))
    most = held.groupBy("a").agg(F.max("n").alias("most"))  # at most one row per entry of the left vocabulary
    known = held.join(F.broadcast(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select("block", "code").join(known, "code")
    digest = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    both = answers.unionByName(base.where("pairs is null").select("block", *digest, "codes", "times"), allowMissingColumns=True)
    # The answers of a block come first, by code, then its documents.
    order = [F.col("code").isNull(), F.col("code")]
    rows = both.repartition("block").sortWithinPartitions("block", *order)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, code, n, best = None, [], None, None, None
        for b in batches:
            blocks = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(b)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if blocks[i] != now:
                    now, parts, code = blocks[i], [], None
                piece = b.slice(i, j - i)
                said = piece.column("code").is_valid().to_numpy(zero_copy_only=False)
                if said.any():
                    part = piece.slice(0, int(said.sum()))
                    parts.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n", "best")])
                piece = piece.slice(int(said.sum()))
                if not len(piece):
                    continue
                if code is None:
                    empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool)]
                    code, n, best = (np.concatenate(c) for c in zip(empty, *parts, strict=True))
                    parts = []
                sums = np.zeros((2, len(piece)), np.int64)
                for k, (codes, times) in enumerate(zip(piece.column("codes").to_pylist(), piece.column("times").to_pylist(), strict=True)):
                    if codes:
                        at = np.searchsorted(code, np.frombuffer(codes, np.uint32).astype(np.int64))
                        times = np.frombuffer(times, np.uint32).astype(np.int64)
                        sums[:, k] = times[best[at]].sum(), times @ n[at]
                cols = [piece.column(c) for c in digest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sums[0]), pa.array(sums[1])], names=[*digest, "n_best", "count_sum"])

    out = rows.mapInArrow(
        settle,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long",
    )
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_groups(
    docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, model_path: str | None = None
) -> DataFrame:
    """The alignment itself, per row of ``docs``: doc_id, ``groups`` (ids of both sides between common ends) and
    ``links`` (positions of the overlapping tokens of both sides, from 0).  Odd rows as in ``alignment_digest``: empty lists.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_side(json_path, ranks_path), piece_side(model_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in _slices(texts, SLICE_CHARS):
                x = align(texts[i:j], left, right)
                first = [np.searchsorted(d, np.arange(j - i + 1)) for d in (x.a_doc, x.b_doc)]
                by_doc = np.argsort(x.a_doc[x.link_a], kind="stable")
                ends = np.searchsorted(x.a_doc[x.link_a][by_doc], np.arange(j - i + 1))
                groups, links = [], []
                for k in range(j - i):
                    (a0, a1), (b0, b1) = ((f[k], f[k + 1]) for f in first)
                    cut_a, cut_b = np.flatnonzero(x.a_cut[a0:a1]) + 1, np.flatnonzero(x.b_cut[b0:b1]) + 1
                    pa_, pb_ = np.split(x.a[a0:a1], cut_a[:-1]), np.split(x.b[b0:b1], cut_b[:-1])
                    groups.append([{"a": u.tolist(), "b": v.tolist()} for u, v in zip(pa_, pb_, strict=True)] if a1 > a0 else [])
                    own = by_doc[ends[k] : ends[k + 1]]
                    links.append([{"a": u, "b": v} for u, v in sorted(zip((x.link_a[own] - a0).tolist(), (x.link_b[own] - b0).tolist(), strict=True))])
                pair = lambda t: pa.list_(pa.struct([("a", t), ("b", t)]))
                cols = [batch.column("doc_id").slice(i, j - i), pa.array(groups, pair(pa.list_(pa.int32()))), pa.array(links, pair(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "groups", "links"])

    schema = "doc_id long, groups array<struct<a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
