import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linestream.llm import common as c


def test_word_hashes_agree_with_words(monkeypatch):
    monkeypatch.setattr(c, "_CHUNK", 64)
    texts = ["Ab aB ab", None, "", "  x\ty\nz\x0b ", "é É e", "w" * 500 + " tail", "ab", "tail x 　"] * 3
    hashes, first = c.word_hashes(pa.array(texts, pa.string()))
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(c.WORD, (t or "").translate(fold)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({(w, int(h)) for w, h in zip(flat, hashes, strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))
    assert len(c.word_hashes(pa.array([], pa.string()))[0]) == 0
    sliced = pa.array(["skip this", "Ab", None]).slice(1)
    assert c.word_hashes(sliced)[0].tolist() == hashes[:1].tolist()


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = c.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_running_total(spark):
    df = c.written(spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("v")), "t")
    got = c.running_total(df, ["k"], "v", "before").orderBy("k").collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]
    assert len(got) == 1000
    assert c.running_total(df.limit(0), ["k"], "v", "before").count() == 0


def test_settled_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "shared_dir", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    kept = lambda: sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    before = c.written(spark.range(5), "before")

    def inner():
        return c.written(before.where("id > 1"), "some").union(c.written(before.where("id < 2"), "rest"))

    one = c.settled(inner, "one")
    assert kept() == ["before", "one"] and one.count() == 5

    def outer():
        two = c.settled(inner, "two")
        assert kept() == ["before", "one", "two"]
        return two.join(c.written(spark.range(3), "three"), "id")

    last = c.settled(outer, "last")
    assert kept() == ["before", "last", "one"] and sorted(r["id"] for r in last.collect()) == [0, 1, 2]

    def fails():
        c.written(spark.range(1), "lost")
        raise ValueError

    with pytest.raises(ValueError):
        c.settled(fails, "never")
    assert "never" not in kept() and not c._open()
