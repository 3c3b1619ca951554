import random
import re
from collections import Counter

import numpy as np
import pytest

from linestream.llm import jaccard as j
from linestream.llm.common import WORD, table
from linestream.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, size=3):
    w = re.findall(WORD, (text or "").translate(FOLD))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, percent=90, size=3):
    sets = [grams(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def near(rng, words, edits, vocab):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(vocab)
    return w


@pytest.fixture(scope="module")
def rows(spark):
    """Chains of near copies whose ends do not link, groups around the limit, common passages, short texts."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    passage = [rng.choice(vocab) for _ in range(60)]
    for _ in range(25):
        w = [rng.choice(vocab) for _ in range(rng.choice([8, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            out.append(" ".join(w))
            w = near(rng, w, rng.choice([0, 1, 2, 3]), vocab)
    for _ in range(30):
        out.append(" ".join(passage + [rng.choice(vocab) for _ in range(rng.choice([0, 2, 3, 4, 9]))]))
    out += ["a", "A", "a b", "A b", "b a", "", "  ", None, "x y z", "X Y z", *[out[0]] * 20]
    ids = [*range(len(out) - 3), None, None, 5]
    rng.shuffle(ids)
    return spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, out, strict=True)], "doc_id long, text string, n int, token string")


def got(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("counters,block", [(1 << 20, 1024), (16, 2)])
def test_equals_brute_force(rows, monkeypatch, counters, block):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j.global_order, "__defaults__", (counters,))
    monkeypatch.setattr(j, "MASK", min(counters, 1 << 20))
    want = brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert got(j.jaccard_components(rows)) == want


def test_one_row_of_each_component_stays(rows, odd_docs):
    for df in (rows, odd_docs):
        data = df.collect()
        groups = brute([(r["doc_id"], r["text"]) for r in data])
        kept = j.keep_first(df)
        assert kept.schema == df.schema
        out = kept.collect()
        assert not Counter(map(repr, out)) - Counter(map(repr, data))
        words = [r for r in out if grams(r["text"])]
        assert len(out) - len(words) == sum(not grams(r["text"]) for r in data)
        ids = {c for _, n, c in groups if n}
        assert {r["doc_id"] for r in words} == ids and len(words) >= len(ids)
        again = brute([(r["doc_id"], r["text"]) for r in words])
        assert all(d == c for d, _, c in again)


def test_odd_rows(odd_docs, no_docs):
    assert got(j.jaccard_components(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert j.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("heads", [0, 1, 3])
def test_trees_rule_out_no_link(heads):
    """Without heads a pair is proposed at every token that fits, with them at fewer, but at one at least."""
    rng = random.Random(9)
    for _ in range(40):
        base = sorted(rng.sample(range(1000), 30))
        sets = [sorted(set(near(rng, base, rng.randrange(5), range(1000)))) for _ in range(12)]
        n = np.array([len(s) for s in sets])
        keep = [s[: len(s) - -(-90 * len(s) // 100) + 1] for s in sets]
        want = {(a, b) for a in range(12) for b in range(a) if 190 * len(set(sets[a]) & set(sets[b])) >= 90 * (n[a] + n[b])}
        found = set()
        for t in {t for k in keep for t in k}:
            have = [i for i in range(12) if t in keep[i]]
            pos = np.array([keep[i].index(t) for i in have])
            tails = [np.array(keep[i][p + 1 :], np.int64) for i, p in zip(have, pos, strict=True)]
            two = np.full(len(have), 2)
            mix = rng.sample(range(len(have)), len(have))
            have, pos, tails = [have[m] for m in mix], pos[mix], [tails[m] for m in mix]
            before = [keep[i][max(0, p - heads) : p] for i, p in zip(have, pos, strict=True)]
            head = np.array([[*b, *[-1] * (heads - len(b))] for b in before], np.int64).reshape(len(have), heads)
            pairs = j.tree_pairs(np.zeros(len(have), int), two, tails, n[have], pos, np.array(have), 90, head)
            found |= {(max(have[a], have[b]), min(have[a], have[b])) for a, b in pairs.T}
        assert want <= found


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(101), 0), **dict.fromkeys(range(1000, 1300), 1000), 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(j.jaccard_components(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_hot_tokens_take_their_own_way(rows, monkeypatch):
    monkeypatch.setattr(j, "HOT_ENTRIES", 1)
    monkeypatch.setattr(j, "HOT_MEANS", 0)
    assert got(j.jaccard_components(rows)) == brute([(r["doc_id"], r["text"]) for r in rows.collect()])


def test_sketches_rule_out_no_link_and_spare_texts():
    rng = np.random.default_rng(3)
    pool = j.mix64(np.arange(1, 60_000, dtype=np.uint64))
    spared = 0
    for n, apart in [(1, 0), (40, 2), (300, 10), (300, 60), (1_000, 200), (58_000, 900)]:
        a = rng.choice(pool, n, replace=False)
        rest = np.setdiff1d(pool, a)
        b = np.concatenate([a[apart:], rng.choice(rest, apart, replace=False)])
        hashes, first = np.concatenate([a, b, a, a]), np.array([0, n, 2 * n, 3 * n, 4 * n])
        cells = np.frombuffer(b"".join(j.sketches(hashes, first)), np.uint8).reshape(-1, j.CELLS)
        most = j.most_overlap(cells[[0, 2]], cells[[1, 3]])
        assert (most >= [n - apart, n]).all()
        spared += most[0] < j.least_overlap(n, n)
    assert spared == 2


def test_texts_of_pairs_that_sketches_rule_out_stay(spark, monkeypatch):
    """Sets that share half of their n-grams, none of them rare, cannot link: no text of theirs is gathered."""
    rng = random.Random(8)
    halves = [" ".join(f"w{rng.randrange(5_000)}" for _ in range(100)) for _ in range(7)]
    texts = [f"{x} {y}" for x in halves[:3] for y in halves[3:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, old = [], j._texts
    monkeypatch.setattr(j, "_texts", lambda d, reps, need: asked.append(need.count()) or old(d, reps, need))
    assert got(j.jaccard_components(docs)) == brute(list(enumerate(texts)))
    assert sum(asked) == 0
