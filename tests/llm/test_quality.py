import zlib
from collections import Counter

import numpy as np

from linestream.llm import quality as q
from linestream.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in q.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    for i, r in list(got.items())[:200]:
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    kept = {r["doc_id"] for r in q.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(i, i % 2, None, "x") for i in range(40)] + [(None, 1, 1, "x"), (5, None, 1, "x"), (7, 0, 1, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    rows = q.score_quality(odd_docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[100] == by[101] and all(0 <= s <= 1 for s in by.values())
    assert q.keep_good(odd_docs, labels).schema == odd_docs.schema
    none = q.score_quality(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert q.score_quality(no_docs, labels).count() == 0


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(q.FEATURES)))
    t = q.fit_trees(x, (x[:, 0] + x[:, 3] > 0).astype(float))
    for row, score in zip(x[:50], t.score(x[:50]), strict=True):
        total = t.base
        for node in t.roots:
            while t.left[node] >= 0:
                node = t.left[node] + (row[t.feature[node]] > t.cut[node])
            total += t.value[node]
        assert np.isclose(score, 1 / (1 + np.exp(-total)))
