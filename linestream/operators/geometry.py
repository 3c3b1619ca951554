"""Boxes and rectangles: projections, clipping, which display, which window.

Rectangles are four columns ``x, y, w, h``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestream.functions.text import trim_unicode
from linestream.scale import Split, fits, lookup_join, materialize, running

MIN_DRAG = 8
MIN_WINDOW = 40
# Displays that fit into one row of candidates.  More of them go through the grid.
MAX_DISPLAYS = 256
DISPLAY_CELL = 1024
#: Side of the smallest grid cell; larger windows go into cells of twice, four times ... this side.
WINDOW_CELL = 32
#: Windows that a grid cell lists; a cell with more of them is searched by halves of its coordinates.
CELL_LIST = 64


def flip_boxes(df: DataFrame) -> DataFrame:
    """Bottom-left to top-left origin, for normalised boxes."""
    return df.withColumn("y", 1 - (F.col("y") + F.col("h")))


def boxes_to_pixels(df: DataFrame, width: float, height: float) -> DataFrame:
    """Pixel rectangles ``px, py, pw, ph`` (``py_up`` for a bottom-left origin) of lines that show text."""
    shown = F.coalesce("translated", "text")
    return df.where(shown != "").withColumns(
        {
            "px": F.col("x") * width,
            "py": F.col("y") * height,
            "py_up": (1 - (F.col("y") + F.col("h"))) * height,
            "pw": F.col("w") * width,
            "ph": F.col("h") * height,
        }
    )


def rect_from_drag(df: DataFrame, min_side: float = MIN_DRAG) -> DataFrame:
    """Two corners ``x0, y0, x1, y1`` to a rectangle; drags with a side below ``min_side`` are left out."""
    rect = df.withColumns(
        {
            "x": F.least("x0", "x1"),
            "y": F.least("y0", "y1"),
            "w": F.abs(F.col("x1") - F.col("x0")),
            "h": F.abs(F.col("y1") - F.col("y0")),
        }
    )
    return rect.where((F.col("w") >= min_side) & (F.col("h") >= min_side))


def pickable_windows(windows: DataFrame, own_pid: int, flip_h: float) -> DataFrame:
    """Windows a user can point at, with ``y`` turned to a bottom-left origin."""
    ok = (
        (F.col("layer") == 0)
        & ~F.col("pid").eqNullSafe(F.lit(own_pid))
        & (F.coalesce("alpha", F.lit(1.0)) > 0.01)
        & F.col("window_id").isNotNull()
        & F.col("x").isNotNull()
        & F.col("y").isNotNull()
        & (F.col("w") >= MIN_WINDOW)
        & (F.col("h") >= MIN_WINDOW)
    )
    return windows.where(ok).withColumn("y", F.lit(flip_h) - (F.col("y") + F.col("h")))


def line_font_size(df: DataFrame, width: float, height: float) -> DataFrame:
    """Add ``font_size``: from the row height for horizontal text, from the area per character for
    vertical blocks (where the scale of the columns caps it)."""
    w = F.greatest(F.lit(1.0), F.col("w") * width)
    h = F.greatest(F.lit(1.0), F.col("h") * height)
    rows = F.greatest(F.lit(1), F.col("row_count"))
    flat = F.greatest(F.lit(8.0), F.least(F.lit(96.0), h / rows * 0.85))
    n = F.greatest(F.length(F.coalesce("translated", "text")), F.lit(1))
    fit = F.sqrt(w * h / n) * 0.9
    scale = F.col("char_scale") * width
    tall = F.greatest(F.lit(8.0), F.least(fit, F.when(scale > 0, scale).otherwise(fit)))
    return df.withColumn("font_size", F.when(F.col("is_vertical"), tall).otherwise(flat))


def paragraph_rollup(line_obs: DataFrame, keys: list[str]) -> DataFrame:
    """Lines to paragraphs: text, bounding box, row count, direction, column scale.

    Vertical when at least half of the lines run top to bottom; the scale is then the mean width of
    all lines.  White space around the text is taken off; a paragraph without any other text is none.
    """
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    g = line_obs.groupBy(*keys).agg(
        trim_unicode(F.array_join(F.transform(rows, lambda r: r["text"]), "\n")).alias("text"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("__x1"),
        F.max(F.col("y") + F.col("h")).alias("__y1"),
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col("dir") == "ttb").alias("__ttb"),
        F.avg("w").alias("__avg_w"),
    )
    vertical = (F.col("__n") > 0) & (2 * F.col("__ttb") >= F.col("__n"))
    return g.where(F.col("text") != "").select(
        *keys,
        "text",
        "x",
        "y",
        (F.col("__x1") - F.col("x")).alias("w"),
        (F.col("__y1") - F.col("y")).alias("h"),
        F.greatest(F.lit(1), F.col("__n")).alias("row_count"),
        vertical.alias("is_vertical"),
        F.when(vertical, F.col("__avg_w")).otherwise(0.0).alias("char_scale"),
    )


def _overlap(a0: Column, alen: Column, b0: Column, blen: Column) -> Column:
    """Length of the common part of two intervals, 0 when there is none."""
    return F.greatest(F.lit(0.0), F.least(a0 + alen, b0 + blen) - F.greatest(a0, b0))


def clip_rects(rects: DataFrame, displays: DataFrame, display: str = "display_id") -> DataFrame:
    """Intersect each rectangle with its display: ``clip_x, clip_y, clip_w, clip_h`` in the display's
    own space with the origin at the top left; NULL where nothing is left."""
    d = displays.select(
        F.col("display_id").alias(display), *[F.col(c).cast("double").alias(f"__d{c}") for c in ("x", "y", "w", "h")]
    )
    j = lookup_join(rects, d, [display])
    x0, y0 = F.greatest(F.col("x"), F.col("__dx")), F.greatest(F.col("y"), F.col("__dy"))
    w = F.least(F.col("x") + F.col("w"), F.col("__dx") + F.col("__dw")) - x0
    h = F.least(F.col("y") + F.col("h"), F.col("__dy") + F.col("__dh")) - y0
    some = (w > 0) & (h > 0)
    out = {
        "clip_x": x0 - F.col("__dx"),
        "clip_y": (F.col("__dy") + F.col("__dh")) - (y0 + h),
        "clip_w": w,
        "clip_h": h,
    }
    return j.withColumns({n: F.when(some, e) for n, e in out.items()}).drop("__dx", "__dy", "__dw", "__dh")


def _cells(lo: Column, length: Column, cell: float) -> Column:
    first = F.floor(lo / cell)
    return F.sequence(first, F.greatest(first, F.ceil((lo + length) / cell) - 1))


def _sides_known() -> Column:
    """A rectangle with a NULL side touches nothing."""
    return F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()


def _with_candidates(df: DataFrame, displays: DataFrame, ids: list[str], max_displays: int, keys: list[str]) -> DataFrame:
    """Add ``__cand``: the array of displays of the row's snapshot that may overlap its rectangle.

    A desk has a handful of displays: after a check of their number they ride along as one constant array, with neither
    a join nor a shuffle, or, with snapshots, as one array per snapshot.  A larger table is cut into grid cells and
    joined on the cell.
    """
    d = displays.select(
        *keys,
        F.col("display_seq").cast("long").alias("seq"),
        F.col("display_id").alias("id"),
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")],
        F.col("scale").cast("double").alias("scale"),
    )
    one = ["seq", "id", "x", "y", "w", "h", "scale"]
    row = F.struct(*one)
    d = d.where(_sides_known())
    none = lambda c: F.slice(c, 1, 0)
    if not keys and fits(d, max_displays):
        every = d.agg(F.array_sort(F.collect_list(row))).scalar()
        return df.withColumn("__cand", F.when(_sides_known(), every).otherwise(none(every)))
    if keys and (d.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= max_displays:
        sets = d.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__cand"))
        empty = F.array().cast(sets.schema["__cand"].dataType)
        joined = lookup_join(df, sets, keys)
        return joined.withColumn("__cand", F.when(_sides_known(), F.coalesce("__cand", empty)).otherwise(empty))
    # Of equal rectangles the first one always wins, so copies of a display fold into one.
    d = d.groupBy(*keys, "x", "y", "w", "h").agg(F.min(F.struct("seq", "id", "scale")).alias("__one")).select(
        *keys, "__one.seq", "__one.id", "x", "y", "w", "h", "__one.scale"
    )
    cell = DISPLAY_CELL
    own = [c for c in ids if c not in keys]
    left = df.where(_sides_known()).select(
        *keys, *own, F.explode(_cells(F.col("x"), F.col("w"), cell)).alias("__cx"), F.col("y").alias("__y"), F.col("h").alias("__h")
    ).select(*keys, *own, "__cx", F.explode(_cells(F.col("__y"), F.col("__h"), cell)).alias("__cy"))
    right = d.select(*keys, row.alias("__d"), F.explode(_cells(F.col("x"), F.col("w"), cell)).alias("__cx")).select(
        *keys, "__d", "__cx", F.explode(_cells(F.col("__d.y"), F.col("__d.h"), cell)).alias("__cy")
    )
    by_cell = right.groupBy(*keys, "__cx", "__cy").agg(F.collect_list("__d").alias("__ds"))
    found = (
        lookup_join(left, by_cell, [*keys, "__cx", "__cy"], "inner")
        .groupBy(*keys, *own)
        .agg(F.array_distinct(F.flatten(F.collect_list("__ds"))).alias("__cand"))
    )
    return df.join(found, [*keys, *own], "left").withColumn("__cand", F.coalesce("__cand", F.array().cast(found.schema["__cand"].dataType)))


def max_overlap_display(
    rects: DataFrame, displays: DataFrame, ids: list[str], max_displays: int = MAX_DISPLAYS, keys: list[str] | None = None
) -> DataFrame:
    """Add ``display_id``: the display that shares the largest area with the rectangle.

    Of equal areas, and when no display is touched (as by a rectangle with a NULL side), the first one.  With
    ``keys``, a rectangle only meets the displays of its own snapshot; NULL where that has none.
    """
    keys = keys or []
    c = _with_candidates(rects, displays, ids, max_displays, keys)
    if keys:
        firsts = displays.groupBy(*keys).agg(F.min_by("display_id", "display_seq").alias("__first"))
        c, first = lookup_join(c, firsts, keys), F.col("__first")
    else:
        first = displays.agg(F.min_by("display_id", "display_seq")).scalar()
    area = F.transform(
        "__cand",
        lambda d: F.struct(
            (_overlap(F.col("x"), F.col("w"), d["x"], d["w"]) * _overlap(F.col("y"), F.col("h"), d["y"], d["h"])).alias("area"),
            (-d["seq"]).alias("rank"),
            d["id"].alias("id"),
        ),
    )
    best = F.array_max(area)
    return c.withColumn("display_id", F.when(best["area"] > 0, best["id"]).otherwise(first)).drop("__cand", "__first")


def first_intersecting_display(
    windows: DataFrame,
    displays: DataFrame,
    ids: list[str],
    main_scale: float | None = None,
    max_displays: int = MAX_DISPLAYS,
    keys: list[str] | None = None,
) -> DataFrame:
    """Add ``display_id`` of the first display that truly overlaps the window (else NULL) and
    ``scale`` (else the main display's, else 2).  With ``keys``, of the displays of its own snapshot."""
    c = _with_candidates(windows, displays, ids, max_displays, keys or [])
    hit = F.filter(
        "__cand",
        lambda d: (F.least(F.col("x") + F.col("w"), d["x"] + d["w"]) > F.greatest(F.col("x"), d["x"]))
        & (F.least(F.col("y") + F.col("h"), d["y"] + d["h"]) > F.greatest(F.col("y"), d["y"])),
    )
    one = F.array_min(hit)
    return c.withColumns(
        {
            "display_id": one["id"],
            "scale": F.coalesce(one["scale"], F.lit(main_scale).cast("double"), F.lit(2.0)),
        }
    ).drop("__cand")


def topmost_window_at(
    points: DataFrame,
    windows: DataFrame,
    cell: float = WINDOW_CELL,
    small: bool | None = None,
    hot_rows: int | None = None,
    keys: list[str] | None = None,
    most: int = CELL_LIST,
) -> DataFrame:
    """Add ``window_id``: the front-most window (least ``z``) that holds the point, else NULL.

    Half-open: ``x <= px < x + w``.  With ``keys``, a point only meets the windows of its own snapshot.

    A grid of several levels: a window lies in at most four cells of the first level whose cells are as large as it
    is, so a full screen is four pieces and not thousands; a point has one cell per level.  Pieces are clipped to their
    cells, and of equal pieces only the front-most stays, which is a minimum combined ahead of the shuffle.  A cell with up to
    ``most`` pieces lists them.  Fuller ones have no list: see ``_by_halves``.  Equal points are asked for once.
    """
    keys = keys or []
    at = [*keys, "__level", "__cx", "__cy"]
    win = windows.where((F.col("w") > 0) & (F.col("h") > 0) & _sides_known()).select(
        *keys, "window_id", "z", *[F.col(k).cast("double").alias(k) for k in ("x", "y", "w", "h")]
    )
    side = F.greatest(F.col("w"), F.col("h"))
    level = F.greatest(F.ceil(F.log2(side / F.lit(float(cell)))), F.lit(0)).cast("int")
    win = win.withColumn("__level", level).withColumn("__c", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("__level")))
    cut = lambda lo, n: F.sequence(F.floor(lo / F.col("__c")), F.greatest(F.floor(lo / F.col("__c")), F.ceil((lo + n) / F.col("__c")) - 1))
    cells = win.withColumn("__cx", F.explode(cut(F.col("x"), F.col("w")))).withColumn("__cy", F.explode(cut(F.col("y"), F.col("h"))))
    ox, oy = F.col("__cx") * F.col("__c"), F.col("__cy") * F.col("__c")
    piece = cells.select(
        *at,
        F.greatest(F.col("x"), ox).alias("x0"),
        F.greatest(F.col("y"), oy).alias("y0"),
        F.least(F.col("x") + F.col("w"), ox + F.col("__c")).alias("x1"),
        F.least(F.col("y") + F.col("h"), oy + F.col("__c")).alias("y1"),
        F.struct("z", "window_id").alias("win"),
    )
    front = piece.groupBy(*at, "x0", "y0", "x1", "y1").agg(F.min("win").alias("win"))
    counts = front.groupBy(*at).count()
    # As many levels as there are powers of two between the smallest and the largest window.
    known = materialize(counts)
    levels = sorted(r[0] for r in known.select("__level").distinct().collect())
    full = known.where(F.col("count") > most).drop("count")
    px, py = F.col("px").cast("double"), F.col("py").cast("double")
    spots = points.select(*keys, px.alias("__px"), py.alias("__py")).where("__px is not null and __py is not null").distinct()
    asked = spots.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("__level"))
    asked = asked.withColumns({"__cx": F.floor(F.col("__px") / size), "__cy": F.floor(F.col("__py") / size)})
    listed = lookup_join(front, full, at, "left_anti", small=small)
    lists = listed.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("win", "x0", "y0", "x1", "y1"))).alias("__wins"))
    found = lookup_join(asked, lists, at, "inner", small=small)
    inside = F.filter(
        "__wins",
        lambda r: (r["x0"] <= F.col("__px")) & (F.col("__px") < r["x1"]) & (r["y0"] <= F.col("__py")) & (F.col("__py") < r["y1"]),
    )
    hits = found.select(*keys, "__px", "__py", F.try_element_at(inside, F.lit(1))["win"].alias("win"))
    if not full.isEmpty():
        pieces = materialize(lookup_join(front, full, at, "left_semi", small=small))
        there = materialize(lookup_join(asked, full, at, "left_semi", small=small))
        hits = hits.unionByName(_by_halves(pieces, there, at, hot_rows).select(*keys, "__px", "__py", "win"))
    best = hits.where(F.col("win").isNotNull()).groupBy(*keys, "__px", "__py").agg(F.min("win").alias("__best"))
    out = points.withColumns({"__px": px, "__py": py}).join(best, [*keys, "__px", "__py"], "left")
    return out.withColumn("window_id", F.col("__best.window_id")).select(*points.columns, "window_id")


def _ranks(pieces: DataFrame, there: DataFrame, at: list[str], axis: str, hot_rows: int | None) -> DataFrame:
    """Per cell, for each coordinate of an edge or a point: how many distinct edges lie at or before it."""
    edge = lambda c: pieces.select(*at, F.col(c).alias("v"), F.lit(1).alias("e"))
    spot = there.select(*at, F.col(f"__p{axis}").alias("v"), F.lit(0).alias("e"))
    values = edge(f"{axis}0").unionByName(edge(f"{axis}1")).unionByName(spot).groupBy(*at, "v").agg(F.max("e").alias("e"))
    return running(values, Split.of(values, at, ["v"], hot_rows), sums={"r": F.col("e").cast("long")}).select(*at, "v", "r")


def _halves(lo: Column, hi: Column, bits: int) -> Column:
    """``[lo, hi)`` as blocks ``(level, index)`` of ``2**level`` ranks: at most two a level."""

    def step(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        blocks = F.array_compact(F.array(F.when(left, F.struct(i.alias("l"), a.alias("i"))), F.when(right, F.struct(i.alias("l"), (b - 1).alias("i")))))
        return F.struct(
            F.shiftright(F.when(left, a + 1).otherwise(a), 1).alias("a"),
            F.shiftright(F.when(right, b - 1).otherwise(b), 1).alias("b"),
            F.concat(acc["out"], blocks).alias("out"),
        )

    start = F.struct(lo.cast("long").alias("a"), hi.cast("long").alias("b"), F.array().cast("array<struct<l:int,i:bigint>>").alias("out"))
    return F.array_distinct(F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step, lambda acc: acc["out"]))


def _by_halves(pieces: DataFrame, there: DataFrame, at: list[str], hot_rows: int | None) -> DataFrame:
    """The front-most piece at each point of cells with many pieces: ``there`` with ``win``, without any list of pieces.

    Coordinates are ranked among the edges of their cell.  A piece is then a range of ranks each way, cut into blocks
    of powers of two, at most two a level; a point lies in one block a level.  So each pair of blocks keeps one minimum, and
    a point looks up as many pairs as the square of the levels, whatever the number of pieces.
    """
    ranks = {a: materialize(_ranks(pieces, there, at, a, hot_rows)) for a in "xy"}
    highest = max((r.agg(F.max("r")).first()[0] or 0) for r in ranks.values())
    bits = max(int(highest), 1).bit_length()

    def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
        axis = column[-1] if column.startswith("__") else column[0]
        r = ranks[axis].withColumnsRenamed({"v": column, "r": out})
        return lookup_join(df, r, [*at, column], "inner")

    for c in ("x0", "x1", "y0", "y1"):
        pieces = ranked(pieces, c, f"__{c}")
    blocks = pieces.select(*at, "win", F.explode(_halves(F.col("__x0"), F.col("__x1"), bits)).alias("bx"), "__y0", "__y1").select(
        *at, "win", "bx", F.explode(_halves(F.col("__y0"), F.col("__y1"), bits)).alias("by")
    )
    best = blocks.groupBy(*at, "bx", "by").agg(F.min("win").alias("win"))
    up = lambda c: F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda i: F.struct(i.alias("l"), F.call_function("shiftright", F.col(c), i).alias("i")))
    for axis in "xy":
        there = ranked(there, f"__p{axis}", f"__r{axis}")
    steps = there.select(*at, "__px", "__py", F.explode(up("__rx")).alias("bx"), "__ry").select(
        *at, "__px", "__py", "bx", F.explode(up("__ry")).alias("by")
    )
    met = lookup_join(steps, best, [*at, "bx", "by"], "inner")
    return met.groupBy(*at, "__px", "__py").agg(F.min("win").alias("win"))


def exclude_windows(windows: DataFrame, bundle: str | None, ids: list[int]) -> DataFrame:
    """Leave out all windows of the app with this bundle id; only if there is no such app, those in ``ids``.

    Whether the app is there is one scalar sub-query: no join.
    """
    app = windows.where(F.col("bundle") == bundle).agg(F.min("pid")).scalar() if bundle is not None else F.lit(None)
    listed = F.coalesce(F.col("window_id").isin(ids), F.lit(False)) if ids else F.lit(False)
    return windows.where(F.when(app.isNotNull(), ~F.col("pid").eqNullSafe(app)).otherwise(~listed))
