import random

import pytest
from pyspark.sql import functions as F

from linestream.operators import geometry as geo


def rects_of(spark, data, id_col="rect_id"):
    return spark.createDataFrame(data, f"{id_col} long, x double, y double, w double, h double")


@pytest.fixture(scope="module")
def displays(spark):
    rnd = random.Random(3)
    data = [(i, i, 900.0 * i - 1500, rnd.choice([0.0, -200.0, 300.0]), 1000.0, 800.0, 1.0 + i % 2) for i in range(6)]
    df = spark.createDataFrame(data, "display_id long, display_seq long, x double, y double, w double, h double, scale double")
    return df, data


@pytest.fixture(scope="module")
def rects(spark):
    rnd = random.Random(4)
    data = [(i, rnd.uniform(-4000, 6000), rnd.uniform(-1500, 1500), rnd.uniform(1, 1500), rnd.uniform(1, 900)) for i in range(300)]
    data += [(1000, -1500.0, 0.0, 10.0, 10.0), (1001, -600.0, 0.0, 0.0, 0.0), (1002, 1e5, 1e5, 5.0, 5.0)]
    return rects_of(spark, data), data


def area(r, d):
    w = min(r[1] + r[3], d[2] + d[4]) - max(r[1], d[2])
    h = min(r[2] + r[4], d[3] + d[5]) - max(r[2], d[3])
    return max(0, w) * max(0, h)


@pytest.mark.parametrize("max_displays", [256, 0])
def test_max_overlap_ways_agree_with_brute_force(displays, rects, max_displays):
    df, data = displays
    want = {r[0]: max(data, key=lambda d: (area(r, d), -d[1]))[0] for r in rects[1]}
    got = geo.max_overlap_display(rects[0], df, ["rect_id"], max_displays)
    assert {r["rect_id"]: r["display_id"] for r in got.collect()} == want
    assert want[1002] == 0  # no overlap still gives the first display


@pytest.mark.parametrize("max_displays", [256, 0])
def test_first_intersecting(displays, rects, max_displays):
    df, data = displays

    def first(r):
        for d in data:
            if min(r[1] + r[3], d[2] + d[4]) > max(r[1], d[2]) and min(r[2] + r[4], d[3] + d[5]) > max(r[2], d[3]):
                return d[0], d[6]
        return None, 2.0

    got = geo.first_intersecting_display(rects[0], df, ["rect_id"], max_displays=max_displays)
    assert {r["rect_id"]: (r["display_id"], r["scale"]) for r in got.collect()} == {r[0]: first(r) for r in rects[1]}
    main = geo.first_intersecting_display(rects[0].where("rect_id = 1002"), df, ["rect_id"], main_scale=3.0).first()
    assert (main["display_id"], main["scale"]) == (None, 3.0)


def test_both_ways_agree_on_null_zero_and_negative_sides(displays, spark):
    df = displays[0].unionByName(
        spark.createDataFrame([(90, 90, None, 0.0, 9e3, 9e3, 1.0), (91, 91, 0.0, 0.0, 0.0, 9.0, 1.0)], displays[0].schema)
    )
    sides = [None, 0.0, -20.0, 700.0]
    boxes = rects_of(spark, [(i * 4 + k, 10.0, 400.0, w, h) for i, w in enumerate(sides) for k, h in enumerate(sides)])
    boxes = boxes.unionByName(rects_of(spark, [(100, None, 10.0, 5.0, 5.0), (101, 10.0, None, 5.0, 5.0)]))
    ways = []
    for most in (256, 0):
        best = geo.max_overlap_display(boxes, df, ["rect_id"], most)
        first = geo.first_intersecting_display(boxes, df, ["rect_id"], max_displays=most)
        ways.append([{r["rect_id"]: r["display_id"] for r in d.collect()} for d in (best, first)])
    assert ways[0] == ways[1]
    best, first = ways[0]
    assert best[100] == best[101] == 0 and first[100] is first[101] is None
    assert first[15] is not None and all(v is None for k, v in first.items() if k != 15)


@pytest.mark.parametrize("small,hot", [(True, None), (False, 10)])
@pytest.mark.parametrize("cell", [16, 64, 4096])
def test_topmost_window_equals_brute_force(spark, small, hot, cell):
    rnd = random.Random(11)
    wins = [(i, rnd.randrange(10**6), float(rnd.randrange(-50, 200)), rnd.uniform(-50, 200), rnd.uniform(0, 150), float(rnd.randrange(0, 150))) for i in range(120)]
    # A pile of equal windows, which must collapse to its front-most one.
    wins += [(1000 + i, 2 * 10**6 - i, 20.0, 20.0, 33.0, 33.0) for i in range(100)]
    pts = [(i, rnd.uniform(-60, 300), float(rnd.randrange(-60, 300))) for i in range(400)]
    pts += [(5000, 20.0, 20.0), (5001, 53.0, 30.0), (5002, 52.999, 52.999)]

    def top(p):
        hit = [w for w in wins if w[2] <= p[1] < w[2] + w[4] and w[3] <= p[2] < w[3] + w[5]]
        return min(hit, key=lambda w: w[1])[0] if hit else None

    w = spark.createDataFrame(wins, "window_id long, z long, x double, y double, w double, h double")
    p = spark.createDataFrame(pts, "point_id long, px double, py double")
    got = geo.topmost_window_at(p, w, cell, small=small, hot_rows=hot)
    assert {r["point_id"]: r["window_id"] for r in got.collect()} == {q[0]: top(q) for q in pts}


@pytest.mark.parametrize("most,hot", [(64, None), (0, None), (3, 10)])
def test_snapshots_full_cells_and_large_windows(spark, most, hot):
    """10,000 windows shifted by less than a pixel in one cell, full screens and specks; each snapshot on its own."""
    rnd = random.Random(most)
    n = 10_000 if most == 64 else 200
    wins = [("a", i, rnd.randrange(10**6), 3 + i * 0.0007, 4 + i * 0.0005, 9.0 + i % 7, 8.0 + i % 5) for i in range(n)]
    wins += [("b", 20_000 + i, rnd.randrange(10**6), rnd.uniform(-500, 500), rnd.uniform(-500, 500), rnd.choice([0.01, 5.0, 64.0, 3000.0]), rnd.choice([0.5, 32.0, 1200.0])) for i in range(150)]
    wins += [("b", 30_000, 1, None, 0.0, 5.0, 5.0), ("a", 30_001, 2, 0.0, 0.0, 0.0, 5.0), (None, 30_002, 0, 0.0, 0.0, 9e9, 9e9)]
    pts = [(i, rnd.choice("abc"), rnd.uniform(0, 25), rnd.uniform(0, 25)) for i in range(150)]
    pts += [(1000 + i, "ab"[i % 2], *rnd.choice([(w[3], w[4]), (w[3] + w[5], w[4]), (w[3] + w[5] / 2, w[4] + w[6])])) for i, w in enumerate(rnd.sample(wins[:-3], 100))]
    pts += [(5000, "a", None, 3.0), (5001, None, 4.0, 5.0), (5002, "a", 5.0, 6.0), (5003, "a", 5.0, 6.0)]

    def top(p):
        hit = [w for w in wins if w[0] == p[1] is not None and p[2] is not None and w[3] is not None and w[3] <= p[2] < w[3] + w[5] and w[4] <= p[3] < w[4] + w[6]]
        return min(hit, key=lambda w: (w[2], w[1]))[1] if hit else None

    w = spark.createDataFrame(wins, "snap string, window_id long, z long, x double, y double, w double, h double")
    p = spark.createDataFrame(pts, "point_id long, snap string, px double, py double")
    got = geo.topmost_window_at(p, w, keys=["snap"], most=most, hot_rows=hot)
    assert got.columns == ["point_id", "snap", "px", "py", "window_id"]
    assert {r["point_id"]: r["window_id"] for r in got.collect()} == {q[0]: top(q) for q in pts}


@pytest.mark.parametrize("max_displays", [256, 1])
def test_displays_of_a_snapshot(displays, rects, spark, max_displays):
    df, data = displays
    some = df.where("display_id % 2 = 0").withColumn("snap", F.lit("a")).unionByName(df.where("display_id > 2").withColumn("snap", F.lit("b")))
    mine = {"a": [d for d in data if d[0] % 2 == 0], "b": [d for d in data if d[0] > 2], "c": []}
    r = rects[0].withColumn("snap", F.element_at(F.array(*map(F.lit, "abc")), (F.col("rect_id") % 3 + 1).cast("int")))
    snap = lambda i: "abc"[i % 3]
    best = {x[0]: max(mine[snap(x[0])], key=lambda d: (area(x, d), -d[1]), default=(None,))[0] for x in rects[1]}
    got = geo.max_overlap_display(r, some, ["rect_id"], max_displays, ["snap"])
    assert {x["rect_id"]: x["display_id"] for x in got.collect()} == best
    hit = lambda x: next((d[0] for d in mine[snap(x[0])] if min(x[1] + x[3], d[2] + d[4]) > max(x[1], d[2]) and min(x[2] + x[4], d[3] + d[5]) > max(x[2], d[3])), None)
    got = geo.first_intersecting_display(r, some, ["rect_id"], max_displays=max_displays, keys=["snap"])
    assert {x["rect_id"]: x["display_id"] for x in got.collect()} == {x[0]: hit(x) for x in rects[1]}


def test_half_open(spark):
    w = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0)], "window_id long, z long, x double, y double, w double, h double")
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 5.0), (3, 5.0, 10.0)], "point_id long, px double, py double")
    got = {r["point_id"]: r["window_id"] for r in geo.topmost_window_at(p, w).collect()}
    assert got == {1: 1, 2: None, 3: None}


def test_bundle_overrides_the_list(spark, rows):
    w = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, None, None)], "window_id long, pid int, bundle string")
    assert rows(geo.exclude_windows(w, "a", [2]), "window_id") == [(2,), (3,)]
    assert rows(geo.exclude_windows(w, "zz", [2]), "window_id") == [(1,), (3,)]
    assert rows(geo.exclude_windows(w, None, []), "window_id") == [(1,), (2,), (3,)]


def test_clip(spark):
    d = spark.createDataFrame([(1, 100.0, 0.0, 100.0, 50.0)], "display_id long, x double, y double, w double, h double")
    r = spark.createDataFrame(
        [(1, 1, 90.0, 10.0, 30.0, 100.0), (2, 1, 0.0, 0.0, 100.0, 10.0)],
        "rect_id long, display_id long, x double, y double, w double, h double",
    )
    got = {x["rect_id"]: (x["clip_x"], x["clip_y"], x["clip_w"], x["clip_h"]) for x in geo.clip_rects(r, d).collect()}
    assert got == {1: (0.0, 0.0, 20.0, 40.0), 2: (None, None, None, None)}


def test_pickable_and_drags(spark, rows):
    w = spark.createDataFrame(
        [(1, 0, 9, None, 0.0, 0.0, 40.0, 40.0), (2, 1, 9, 1.0, 0.0, 0.0, 99.0, 99.0), (3, 0, 5, 1.0, 0.0, 0.0, 99.0, 99.0),
         (4, 0, 9, 0.01, 0.0, 0.0, 99.0, 99.0), (5, 0, 9, 1.0, 0.0, 0.0, 39.9, 99.0), (None, 0, 9, 1.0, 0.0, 0.0, 99.0, 99.0)],
        "window_id long, layer int, pid int, alpha double, x double, y double, w double, h double",
    )
    assert rows(geo.pickable_windows(w, 5, 800.0), "window_id", "y") == [(1, 760.0)]
    d = spark.createDataFrame([(1, 10.0, 10.0, 2.0, 30.0), (2, 0.0, 0.0, 7.9, 30.0)], "id int, x0 double, y0 double, x1 double, y1 double")
    assert rows(geo.rect_from_drag(d), "id", "x", "y", "w", "h") == [(1, 2.0, 10.0, 8.0, 20.0)]


def test_paragraph_half_is_vertical_and_scale_averages_all(spark):
    obs = spark.createDataFrame(
        [(1, 0, "a", "ttb", 0.0, 0.0, 0.1, 0.5), (1, 1, "b", "ltr", 0.5, 0.1, 0.3, 0.2), (2, 0, "c", "ltr", 0.0, 0.0, 0.1, 0.1)],
        "para int, line_no int, text string, dir string, x double, y double, w double, h double",
    )
    one, two = geo.paragraph_rollup(obs, ["para"]).orderBy("para").collect()
    assert (one["text"], one["row_count"], one["is_vertical"], one["char_scale"]) == ("a\nb", 2, True, 0.2)
    assert (one["w"], one["h"]) == (0.8, 0.5)
    assert (two["is_vertical"], two["char_scale"]) == (False, 0.0)


def test_blank_paragraphs_are_none(spark, rows):
    obs = spark.createDataFrame(
        [(1, 0, "\u00a0a ", "ttb", 0.0, 0.0, 0.1, 0.5), (1, 1, " \t", "ltr", 0.5, 0.1, 0.3, 0.2), (2, 0, "\u3000", "ltr", 0.0, 0.0, 0.1, 0.1), (3, 0, None, "ltr", 0.0, 0.0, 0.1, 0.1)],
        "para int, line_no int, text string, dir string, x double, y double, w double, h double",
    )
    assert rows(geo.paragraph_rollup(obs, ["para"]), "para", "text", "row_count") == [(1, "a", 2)]


def test_font_size(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.5, 1, False, 0.0, "abcd"), (2, 0.5, 0.5, 0, False, 0.0, "abcd"), (3, 0.5, 0.5, 1, True, 0.0, "abcd"), (4, 0.5, 0.5, 1, True, 0.1, "abcd")],
        "id int, w double, h double, row_count int, is_vertical boolean, char_scale double, text string",
    ).withColumn("translated", F.lit(None).cast("string"))
    got = [round(r["font_size"], 6) for r in geo.line_font_size(df, 100.0, 100.0).orderBy("id").collect()]
    assert got == [42.5, 42.5, 22.5, 10.0]
