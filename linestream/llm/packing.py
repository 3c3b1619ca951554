"""Packing documents into fixed-length sequences along a space-filling curve."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from linestream.llm.common import hilbert_keys, running_total, written

SEQUENCE = 1024
END_ID = 0
DIMS, BITS = 4, 15
VOCABULARY = "byte_bpe_50k"
#: Characters of which both tokenizer libraries are known to take the same view; other texts go the plain way.
_PLAIN = re.compile("[^\x00-\x7eÀ-ɏ]|<\\|")


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(json_path: str | None = None, ranks_path: str | None = None):
    """A function text -> ids, by the tokenizer file at ``json_path``.

    Where ``ranks_path`` names the same vocabulary as ranks, texts of plain Latin characters without special tokens
    are encoded by the faster library, which gives the same ids (tests compare them); all others by ``tokenizers``.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    if json_path is None:
        json_path, ranks_path = _file(f"{VOCABULARY}.json"), _file(f"{VOCABULARY}.tiktoken")
    slow = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _PLAIN.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


@functools.cache
def _projection(dims: int) -> np.ndarray:
    """A row of signs for each hashed token id."""
    return np.random.default_rng(5).choice(np.array([-1.0, 1.0], np.float32), (1 << 16, dims))


def curve_key(ids: np.ndarray, dims: int = DIMS, bits: int = BITS) -> int:
    """Hilbert position of a document: its hashed token counts, projected to ``dims`` signed means."""
    point = _projection(dims)[ids & 0xFFFF].mean(axis=0, dtype=np.float64)
    cell = np.minimum(((point + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    return int(hilbert_keys(cell[None, :], bits)[0])


def tokenised(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """uid, doc_id, key, n, ids (little-endian 16 or 32 bits, as ``wide`` says) of each row; null texts are empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(json_path, ranks_path), TaskContext.get().partitionId() << 33
        for whole in batches:
            for begin in range(0, len(whole), 512):
                b = whole.slice(begin, 512)
                n, ids, wide, points = [], [], [], []
                for text in b.column("text").to_pylist():
                    a = np.array([*enc(text or ""), END_ID], np.uint32)
                    n.append(len(a))
                    wide.append(bool(a.max() > 0xFFFF))
                    ids.append((a if wide[-1] else a.astype(np.uint16)).tobytes())
                    points.append(_projection(DIMS)[a & 0xFFFF].mean(axis=0, dtype=np.float64))
                cell = np.minimum(((np.array(points) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                key = hilbert_keys(cell, BITS)
                cols = [np.arange(uid, uid + len(n)), b.column("doc_id"), key, np.array(n, np.int64), ids, wide]
                uid += len(n)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in cols],
                    names=["uid", "doc_id", "key", "n", "ids", "wide"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        encode, "uid long, doc_id long, key long, n long, ids binary, wide boolean"
    )


def pack(
    docs: DataFrame,
    sequence: int = SEQUENCE,
    json_path: str | None = None,
    ranks_path: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into sequences of ``sequence`` tokens; one row per piece.

    Documents lie along a Hilbert curve through their projected token vectors, ties by row id, and are cut where a
    sequence is full.  So only the last sequence is short: padding is under one sequence for the whole corpus.
    The curve order and the running total of lengths handle only (key, row id, length); the ids are written once and
    meet their start in one join on the row id.  A document of any length and any number of equal documents
    are spread like others.  Null and empty texts hold the end id alone; repeated rows and null ids are rows of
    their own; an empty table gives an empty result; other columns are ignored.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, ids (array of int).
    """
    base = written(tokenised(docs, json_path, ranks_path), "tokens")
    placed = running_total(base.select("uid", "key", "n"), ["key", "uid"], "n", "at").select("uid", "at")
    rows = base.drop("key").join(placed, "uid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, raw, wide, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "wide", "at")), strict=True):
                ids = np.frombuffer(raw, np.uint32 if wide else np.uint16).astype("<u4")
                start = 0
                while start < len(ids):
                    seq, offset = divmod(at + start, sequence)
                    part = ids[start : start + sequence - offset]
                    row = (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), seq, offset, part)
                    for put, v in zip(out, row, strict=False):
                        put.append(v)
                    start += len(part)
                if len(out[0]) >= 4096:
                    yield _batch(out, names)
                    out = [[] for _ in names]
            if out[0]:
                yield _batch(out, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def _batch(out: list[list], names: list[str]) -> pa.RecordBatch:
    cols = [pa.array(v, pa.int64()) for v in out[:7]]
    if len(names) > 7:
        lengths = np.concatenate([[0], np.cumsum([len(x) for x in out[7]])]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(out[7]).astype(np.int32))))
    return pa.RecordBatch.from_arrays(cols, names=names)


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return pack(docs, with_ids=False)
