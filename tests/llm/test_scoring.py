import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linestream.llm import scoring as sc
from linestream.llm.common import WORD, table
from linestream.llm.trie import EliasFano, NgramTrie

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    tokens = [[*re.findall(WORD, (t or "").translate(FOLD)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two = Counter(), defaultdict(Counter)
    for ts, h in zip(tokens, held, strict=True):
        if not h:
            one.update(ts)
            for a, b in zip(["<s>", *ts[:-1]], ts, strict=True):
                two[a][b] += 1
    n, scale = one.total(), one.total() + 0.1 * (len(one) + 1)
    p = lambda w: (one[w] + 0.1) / scale
    for (i, _), ts, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10(p(w)) for w in ts)
        score = sum(
            math.log10((two[a][b] + sc.PRIOR * p(b)) / (two[a].total() + sc.PRIOR)) for a, b in zip(["<s>", *ts[:-1]], ts, strict=True)
        )
        yield i, h, len(ts), sum(one[w] > 0 for w in ts), n, base, score


def check(df):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 6))
    got = sorted(map(tuple, sc.score_documents(df).collect()), key=key)
    want = sorted(brute([(r["doc_id"], r["text"]) for r in df.collect()]), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    off = np.array([abs(g[6] - w[6]) / w[2] for g, w in zip(got, want, strict=True)])
    assert off.max(initial=0) < 0.02  # one quantising step of the values a token at most


@pytest.mark.parametrize("size", [1 << 20, 2000])
def test_scores(spark, odd_docs, no_docs, monkeypatch, size):
    monkeypatch.setattr(sc, "BLOCK_TOKENS", size)
    monkeypatch.setattr(sc, "SHARD_TOKENS", size)
    check(odd_docs)
    check(odd_docs.where("doc_id is null or doc_id % 7 = 0"))
    check(table(spark, "/root/testdata/sf0.001", "documents"))
    assert sc.score_documents(no_docs).count() == 0


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (5, 5), (1000, 3), (1000, 1 << 62), (5000, 1 << 20)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    e = EliasFano(EliasFano.encode(v))
    assert (e.at(np.arange(n)) == v).all()
    ask = np.concatenate([v, rng.integers(0, top * 2, 500, dtype=np.uint64)])
    at = e.find(ask)
    assert ((at >= 0) == np.isin(ask, v)).all() and (v[at[at >= 0]] == ask[at >= 0]).all()
    assert n < 1000 or top < 1000 or len(EliasFano.encode(v)) * 8 < n * (3 + max(0, np.log2(top / n))) + 400


def test_trie():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    c, w = pairs[:, 0].astype(np.uint64) * np.uint64(1 << 50), pairs[:, 1].astype(np.uint64)
    value = rng.random(len(c)) * 5
    t = NgramTrie.build(c, w, value)
    assert np.abs(t.values(c, w) - value).max() <= 5 / 255
    assert np.isnan(t.values(c, w + np.uint64(1000))).all() and np.isnan(t.values(c + np.uint64(1), w)).all()


class Taken:
    """Stands for a table whose rows are given: runs what it is mapped by here."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, f, kind):
        return list(f(iter(self.batches)))


def test_messages_of_a_block_leave_together(spark):
    """At 6 GB a block asks 1,500 shards: a batch and a walk over the block for each of them took nearly all of the time."""
    shards = 1500
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * 7) % 4000}" for j in range(400))) for i in range(400)], "doc_id long, text string").coalesce(1)
    blocks = sc._blocks(docs, 10)
    counts = sc._word_counts(blocks, shards)
    assert counts.count() > 1000
    rows = sc._counted(blocks, counts).toArrow().to_batches()
    asked = sc._asked(Taken(rows), 160_400, shards)
    assert sum(len(b) for b in asked) > 1000 and len(asked) < 20
    assert set(asked[0].schema.names).isdisjoint({"uses", "where_"})  # which documents use an n-gram stays with the block
    sent = [(r["shard"], r["block"]) for b in asked for r in b.to_pylist()]
    assert len(set(sent)) == len(sent)
    check(docs)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(sc, "SHARD_TOKENS", 40)
    check(table(spark, "/root/testdata/sf0.001", "documents"))
