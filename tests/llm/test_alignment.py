"""Cross-tokenizer alignment against a plain version: overlaps by comparing all byte ranges, counts by sets."""

import hashlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from linestream.llm import alignment as al
from linestream.llm.common import table

SF = "/root/testdata/sf0.001"
WIRE = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
WIRE |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in WIRE.values())}


@pytest.fixture(scope="module")
def sides():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def a(text):
        ids = tok.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(WIRE[c] for c in tok.id_to_token(i))) for i in ids]

    def b(text):
        out = []
        for i in sp.encode(text):
            p = sp.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        return out

    return a, b


def plain(text, sides):
    """Groups and links of one text."""
    if not text:
        return [], []
    spans, ids = [], []
    for side in sides:
        toks, at = side(text), 0
        if b"".join(t for _, t in toks) != b" " + text.encode():
            return [], []
        rng = []
        for _, t in toks:
            rng.append((at, at + len(t)))
            at += len(t)
        spans.append(rng)
        ids.append([i for i, _ in toks])
    links, lo = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][lo][1] <= s:
            lo += 1
        k = lo
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, k))
            k += 1
    common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
    groups, part = [], []
    for rng, own in zip(spans, ids, strict=True):
        part.append([[]])
        for (_, e), i in zip(rng, own, strict=True):
            part[-1][-1].append(i)
            if e in common:
                part[-1].append([])
    groups = list(zip(part[0][:-1], part[1][:-1], strict=True))
    return groups, [(i, k, ids[0][i], ids[1][k]) for i, k in links]


def expected(rows, sides):
    seen = [(d, *plain(t, sides)) for d, t in rows]
    n = Counter(p for _, _, links in seen for p in {x[2:] for x in links})
    most = defaultdict(int)
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    out = Counter()
    for d, groups, links in seen:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        pairs = [x[2:] for x in links]
        out[
            d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(n[p] == most[p[0]] for p in pairs), sum(n[p] for p in pairs),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ] += 1
    return out


ODD = [
    "a<|endoftext|>b <s></s><unk> <0x41>", "  two  spaces ", "tab\tnew\nline\r\n", "你好，世界 \U0001f600\U0001f468‍\U0001f469", "é é ﬁ Ａ   x",
    "▁already ▁", "\x00\x01\x7f", "x" * 3000, "0123456789" * 50, " ", "\n", "ß ſ İ", "﻿bom", "a b\u0085c",
]


def test_digest(spark, odd_docs, sides):
    rows = [(r[0], r[1]) for r in odd_docs.select("doc_id", "text").collect()]
    more = [(200 + i, t) for i, t in enumerate(ODD)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = al.alignment_digest(docs)
    assert Counter(tuple(r) for r in got.collect()) == expected(rows + more, sides)


@pytest.mark.parametrize("pairs", [1, 300, 1 << 21])
def test_digest_of_the_given_table(spark, sides, monkeypatch, pairs):
    """Also with so few pairs to a block that blocks end within a document's slice."""
    monkeypatch.setattr(al, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(al, "SLICE_CHARS", 20_000)
    docs = table(spark, SF, "documents").repartition(3)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in al.alignment_digest(docs).collect()) == expected(rows, sides)


def test_groups_and_links(spark, sides):
    docs = spark.createDataFrame([*enumerate(ODD), (90, None), (91, "")], "doc_id long, text string")
    for d, groups, links in al.token_groups(docs).collect():
        want, linked = plain(dict(enumerate(ODD)).get(d), sides)
        assert [(g["a"], g["b"]) for g in groups] == [tuple(map(list, g)) for g in want]
        assert [(x["a"], x["b"]) for x in links] == [x[:2] for x in linked]


def test_both_libraries_agree():
    fast, slow = al.byte_side(), al.byte_side(P.path("byte_bpe_50k.json"), None)
    for x, y in zip(fast.encode(ODD), slow.encode(ODD), strict=True):
        assert x.tolist() == y.tolist()


def test_no_rows(spark, no_docs):
    assert al.alignment_digest(no_docs).count() == 0 and al.token_groups(no_docs).count() == 0
