import numpy as np

from linestream.llm import curves as cv


def test_recall_with_a_third_of_the_rows_equal(spark):
    """The answers of a large group of copies are its smallest ids, wherever its rows lie."""
    rng = np.random.default_rng(11)
    n = 3000
    x = rng.normal(size=(n, 8))
    x[rng.permutation(n)[: n // 3]] = x[0]
    x[rng.permutation(n)[:60]] = np.where(np.arange(8) < 4, 0.0, 1.0)
    x[7] = np.where(np.arange(8) < 4, -0.0, 1.0)
    ids = rng.permutation(n * 2)[:n]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in cv.nearest(df.repartition(5)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = asked = copies = right = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        mine = got.pop(int(ids[i]))
        assert sorted(mine) == list(range(1, 11)) and int(ids[i]) not in {m[0] for m in mine.values()}
        hits, asked = hits + len(set(best) & {m[0] for m in mine.values()}), asked + 10
        if (x == x[i]).all(axis=1).sum() > 10:
            copies += 1
            right += [mine[r][0] for r in range(1, 11)] == best
    assert not got
    assert copies >= 5 and right == copies
    assert hits / asked >= 0.9
