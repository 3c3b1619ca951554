import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linestream.llm.common import WORD, mix64, table
from linestream.llm.mixing import SHARD_BLOCKS, mix_documents, mixed_shards, mixed_texts, shuffled

SF = "/root/testdata/sf0.001"


def fill(sizes):
    """The shares, by the rule as told: deal, stop at the limit, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, rest = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values())
    while rest > 1e-6:
        free = [s for s in order if target[s] < 2 * sizes[s] - 1e-9]
        part = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in free:
            target[s] += part * weight[s]
            if target[s] > 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
    return target


def check(docs, rows):
    want = Counter((r["doc_id"], len(re.findall(WORD, r["text"] or ""))) for r in docs)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == want
    sizes, by = defaultdict(int), defaultdict(int)
    for r in docs:
        sizes[r["source"]] += len(re.findall(WORD, r["text"] or ""))
    goal = fill(sizes)
    expect = Counter((r["doc_id"], sizes[r["source"]], round(goal[r["source"]], 3)) for r in docs)
    assert Counter((r["doc_id"], r["source_size"], round(r["target"], 3)) for r in rows) == expect
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source_size"], round(r["target"], 3)] += r["taken"]
    for (size, target), taken in by.items():
        block = min(128, max(1, size // 64))
        alike = sum(1 for s in sizes if (sizes[s], round(goal[s], 3)) == (size, target))
        assert abs(taken - alike * target) <= alike * 2.5 * block + 1e-3


def test_mix_on_odd_rows(odd_docs, no_docs):
    check(odd_docs.collect(), mix_documents(odd_docs).collect())
    assert mix_documents(no_docs).count() == 0


def test_mix_on_tables(spark):
    docs = table(spark, SF, "documents")
    rows = mix_documents(docs).collect()
    check(docs.collect(), rows)
    assert sorted(rows) == sorted(mix_documents(docs).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_files_and_partitions_do_not_matter(spark, odd_docs, seed):
    for docs in (table(spark, SF, "documents"), odd_docs):
        want = Counter(mix_documents(docs).collect())
        assert Counter(mix_documents(docs.repartition(1 + 2 * seed).sortWithinPartitions("text")).collect()) == want


def test_very_small_sources(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20 + i % 5)), f"s{i:03d}") for i in range(300)]
    out = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert abs(sum(r["taken"] for r in out) / sum(r["target"] for r in out) - 1) < 0.01
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in out)


def plain_taken(docs):
    """What each document gives, from a plain walk over the blocks of each source."""
    words = defaultdict(list)  # source -> (doc_id, word number), in the order of the blocks
    for r in sorted(docs, key=lambda r: (r["source"], r["doc_id"])):
        words[r["source"]] += [r["doc_id"]] * len(re.findall(WORD, r["text"] or ""))
    goal = fill({s: len(w) for s, w in words.items()})
    order, taken = sorted(words), Counter()
    for sid, s in enumerate(order):
        n = len(words[s])
        size = min(128, max(1, n // 64))
        blocks = [words[s][i : i + size] for i in range(0, n, size)]
        slots = min(math.floor(goal[s] / n * len(blocks) + 0.5), 2 * len(blocks))
        for turn in range(-(-slots // len(blocks))):
            key = mix64(np.array([turn * 1_000_003 + sid * 7919 + 17], np.uint64))
            for j in range(min(len(blocks), slots - turn * len(blocks))):
                at = shuffled(np.array([j]), np.array([len(blocks)]), key)[0]
                taken.update(blocks[at])
    return taken


def test_taken_equals_a_plain_walk(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r["taken"] for r in mix_documents(docs).collect()}
    want = plain_taken(docs.collect())
    assert got == {i: want[i] for i in got}


def test_shards_hold_the_mix(spark):
    docs = table(spark, SF, "documents")
    parts, taken = mixed_shards(docs).collect(), Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in parts:
        assert r["text"] in texts[r["doc_id"]] and len(re.findall(WORD, r["text"])) == r["words"]
        taken[r["doc_id"]] += r["words"]
    assert taken == Counter({r["doc_id"]: r["taken"] for r in mix_documents(docs).collect() if r["taken"]})
    places = sorted({(r["shard"], r["place"]) for r in parts})
    last = places[-1][0]
    assert places[: SHARD_BLOCKS * last] == [(s, p) for s in range(last) for p in range(SHARD_BLOCKS)]
    assert len({(r["shard"], r["place"], r["source"]) for r in parts}) == len(places)  # a place holds one source


def test_texts_hold_the_words_taken(odd_docs, no_docs):
    taken = Counter()
    for r in mix_documents(odd_docs.where("doc_id is not null")).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixed_texts(odd_docs.where("doc_id is not null"))
    assert out.schema == odd_docs.schema
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(re.findall(WORD, r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert +got == +taken
    assert mixed_texts(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096])
def test_shuffle_is_a_permutation(n):
    got = [shuffled(np.arange(n), np.full(n, n), np.full(n, k)) for k in (1, 2)]
    assert all(sorted(g.tolist()) == list(range(n)) for g in got)
    assert n < 17 or not math.isclose(np.corrcoef(*got)[0, 1], 1)
