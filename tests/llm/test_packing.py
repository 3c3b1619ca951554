import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from linestream.llm.common import table
from linestream.llm.packing import encoder, pack, pack_documents

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, 0]


def check(docs, out):
    want = Counter((r["doc_id"], tuple(ids_of(r["text"]))) for r in docs)
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    full = sum(sum(r["length"] for r in p) == 1024 for p in by_seq.values())
    assert full >= len(by_seq) - 1
    # Copies share their id and length; their pieces put together start by start give each text as often as it is there.
    total = sum(len(k[1]) * n for k, n in want.items())
    assert sum(r["length"] for r in out) == total
    for (doc, n), pieces in by_doc.items():
        texts = [(k[1], m) for k, m in want.items() if k[0] == doc and len(k[1]) == n]
        for r in pieces:
            assert any(list(t[r["start"] : r["start"] + r["length"]]) == r["ids"] for t, _ in texts)
        cover = Counter(i for r in pieces for i in range(r["start"], r["start"] + r["length"]))
        assert set(cover.values()) == {sum(m for _, m in texts)}


def test_round_trip_on_odd_rows(odd_docs, no_docs):
    check(odd_docs.collect(), pack(odd_docs).collect())
    assert pack(no_docs).count() == 0


def test_round_trip_on_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(docs.collect(), pack(docs).collect())
    assert pack_documents(docs).columns == pack(docs).columns[:-1]


def test_both_libraries_give_the_same_ids():
    enc = encoder()
    chars = [chr(i) for i in [*range(1, 0x250), 0x2028, 0x3000, 0x4F60, 0x1F600]]
    texts = ["".join(f"a{c}b {c} {c}{c}  {c}\n{c}9{c}'s" for c in [x, y]) for x, y in zip(chars, chars[7:] + chars[:7], strict=True)]
    texts += ["  lead", "tail  ", "a\r\n\r\n b", "<|endoftext|>", "x<|endoftext|>y", "it's we'll I'M 12345 \t\t x"]
    for t in texts:
        assert list(enc(t)) == TOK.encode(t, add_special_tokens=False).ids, repr(t)
