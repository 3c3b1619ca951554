"""The pipeline, stage by stage, against plain versions of each stage's decision."""

import re
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
from tokenizers import Tokenizer

from linestream.llm import quality as q
from linestream.llm.common import WORD, table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), []
    schema = docs.schema
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        seen.append(docs)
        assert name == "packing" or docs.schema == schema
    good, single, clean, mixed, packed = ([*map(tuple, d.collect())] for d in seen)
    source = [tuple(r) for r in table(spark, SF, "documents").collect()]
    scores = q.score_quality(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    keep = {r["doc_id"] for r in scores if r["predicted"]}
    assert Counter(good) == Counter(r for r in source if r[0] in keep)
    from test_jaccard import brute

    groups = brute([(r[0], r[1]) for r in good], 80, 5)
    assert {r[0] for r in single} == {c for _, _, c in groups} and not Counter(single) - Counter(good)
    texts = {r[0]: r[1] for r in single}
    assert len(clean) == len(single)
    for r in clean:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r[1])
        if not re.search("[0-9@]", texts[r[0]]):
            assert r[1] == texts[r[0]]
        assert r[4] == len(r[1])
    words = {r[0]: Counter(re.findall(WORD, r[1])) for r in clean}
    used = {}
    for r in mixed:
        used[r[0]] = used.get(r[0], Counter()) + Counter(re.findall(WORD, r[1]))
        assert r[4] == len(r[1])
    for i, c in used.items():
        assert all(n <= 2 * words[i][w] for w, n in c.items())
    total = sum(c.total() for c in words.values())
    assert abs(sum(c.total() for c in used.values()) - 1.5 * total) < 20 * 256
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r[2] for r in packed) == want
    assert sum(1 for _ in {r[5] for r in packed}) == -(-want // 1024)
    assert cp.run(spark, SF).count() == len(packed)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = written(stage(spark, docs, SF), "stage")
            assert name == "packing" or out.schema == docs.schema
            out.count()
            docs = out
