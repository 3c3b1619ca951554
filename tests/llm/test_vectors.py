import numpy as np
import pyarrow.parquet as pq
import pytest

from linestream.llm import curves as cv
from linestream.llm import topk
from linestream.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6) * 10.0 ** rng.integers(-2, 3)], "x", 1) for i in range(260)]
    rows += [
        (300, None, "x", 1), (350, [1.0, None], "x", 1), (400, [float("nan")] * 6, "x", 1), (450, [float("inf")] * 6, "x", 1),
        (500, [0.0] * 6, "x", 1), (550, [], "x", 1), (None, [1.0] * 6, "x", 1), (600, [1.0, 2.0], "x", 1), (50, rows[50][1], "x", 1),
        (601, rows[7][1], "x", 1), (602, rows[7][1], "x", 1), (650, [3e17] * 6, "x", 1), (651, [-3e17] * 6, "x", 1),
    ]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")


def plain(rows, every, floor):
    best = {}
    for r in rows:
        i, x = r["vec_id"], r["embedding"]
        if i is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        best[i] = min(best.get(i, x), x)
    dims = max(map(len, best.values()), default=0)
    return {i: [*x, *[0.0] * (dims - len(x))] for i, x in best.items()}, [i for i in best if i % every == 0]


def brute_products(rows):
    vectors, asked = plain(rows, 50, True)
    whole = {i: [int(np.floor(256 * v)) for v in x] for i, x in vectors.items()}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for q in asked:
        scores = [(-clip(sum(a * b for a, b in zip(whole[q], x, strict=True))), i) for i, x in whole.items() if i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    return sorted(out)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("group", [16384, 32, 7])
def test_products_equal_brute_force(odd_vectors, monkeypatch, group):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    got = rows_of(topk.top_products(odd_vectors), "query_id", "rank", "vec_id", "score")
    assert got == brute_products(odd_vectors.collect())
    small = odd_vectors.where("vec_id in (50, 100, 3)")
    assert rows_of(topk.top_products(small), "query_id", "rank", "vec_id", "score") == brute_products(small.collect())
    assert topk.top_products(odd_vectors.limit(0)).count() == 0


@pytest.mark.parametrize("coordinates_from", [-2.0, 0.5, 2.0])
def test_scan_prunes_nothing_it_needs(monkeypatch, coordinates_from):
    monkeypatch.setattr(topk, "COORDINATES_FROM", coordinates_from)
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(600, 8)) * 50 * rng.gamma(1, 1, (600, 1)))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    ids = np.arange(600)
    scan = topk.Scan(5, 8)
    monkeypatch.setattr(topk, "BUCKET", 32)
    scan.add_queries(ids[::50].copy(), x[::50], np.full(12, -np.inf))
    scan.add_vectors(ids, x)
    got = scan.result().to_pylist()
    for q in ids[::50]:
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:5]
        mine = [r for r in got if r["query_id"] == q]
        assert [r["vec_id"] for r in mine] == want.tolist() and [r["score"] for r in mine] == s[want].tolist()


def test_nearest_on_odd_rows(odd_vectors):
    rows = [r for r in odd_vectors.collect() if r["embedding"] is None or any(v for v in r["embedding"])]
    vectors, asked = plain(rows, 100, False)
    got = rows_of(cv.nearest(odd_vectors, window=1.0), "query_id", "rank", "vec_id", "score")
    want = []
    for q in asked:
        d = sorted((float(np.sqrt(((np.array(vectors[q]) - np.array(x)) ** 2).sum())), i) for i, x in vectors.items() if i != q)
        want += [(q, n + 1, i, s) for n, (s, i) in enumerate(d[:10])]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])
    assert cv.nearest(odd_vectors.limit(0)).count() == 0


@pytest.mark.parametrize("sf,held", [("/root/testdata/sf0.01", 2048), ("/root/testdata/sf0.1", 2)])
def test_recall(spark, monkeypatch, sf, held):
    monkeypatch.setattr(cv, "HELD", held)
    monkeypatch.setattr(cv, "STRETCH", 256)
    got = {}
    for r in cv.nearest(table(spark, sf, "embeddings")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    t = pq.read_table(f"{sf}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)
    hits = n = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = got[int(ids[i])]
        assert sorted(mine) == list(range(1, 11))
        assert [mine[r][1] for r in sorted(mine)] == sorted(m[1] for m in mine.values())
        hits, n = hits + len(best & {m[0] for m in mine.values()}), n + 10
    assert hits / n >= 0.9
