"""The near-duplicate stage of the pipeline against brute force on five-word n-grams and a similarity of 0.8."""

import random
import re
from collections import Counter

import corpus_pipeline as cp

from linestream.llm import jaccard as j
from linestream.llm.common import WORD

SF = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(WORD, (text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def kept(rows):
    """Smallest id of each group of texts that link, and all texts without words."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return Counter(least.values())


def test_near_copies_between_the_limits_go(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    whole = rng.sample(vocab, 500)
    spread = ["new" + w if i % 50 == 25 else w for i, w in enumerate(whole)]
    short = rng.sample(vocab, 100)
    texts = [" ".join(w) for w in (whole, spread, short, short + rng.sample(vocab, 20))]
    for _ in range(25):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 5, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            texts.append(" ".join(w))
            for _ in range(rng.choice([0, 1, 2, 4])):
                w = [*w]
                w[rng.randrange(len(w))] = rng.choice(vocab)
    texts += ["a", "A", "a b c d", "A b c d", "b a c d", "", "  "]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(r["doc_id"] for r in cp.near_duplicates(spark, docs, SF).collect())
    assert got == kept(rows)
    assert not {1, 3} & got.keys()
    assert {1, 3} & {r["doc_id"] for r in j.keep_first(docs).collect()}
