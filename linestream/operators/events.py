"""Event rows in order: last value, changes, bursts, spans, sampling, control state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestream.scale import Split, flag, running, runs


def latest_region(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last placed region per key.  Only one row per key and task reaches the shuffle."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("__v")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"__v.{v}").alias(v) for v in values])


def changes_only(
    df: DataFrame, key: str, order: list[str], value: str, hot_rows: int | None = None
) -> DataFrame:
    """Rows whose value differs from the one before; a leading NULL is no change."""
    split = Split.of(df, [key], order, hot_rows)
    prev = running(df, split, lags={"__prev": F.col(value)})
    return prev.where(~F.col(value).eqNullSafe(F.col("__prev"))).drop("__prev")


def _apart(later: Column, earlier: Column, gap: str) -> Column:
    return later > earlier + F.expr(f"interval {gap}")


def debounce_last(
    df: DataFrame, key: str, order: list[str], gap: str, flush_col: str | None = None, hot_rows: int | None = None
) -> DataFrame:
    """The last event of each burst.  Events exactly ``gap`` apart are still one burst.

    A flush event is kept at once; an earlier event of its burst is then dropped like any other
    that has a follower.  ``order[0]`` is the time.
    """
    ts = order[0]
    split = Split.of(df, [key], order, hot_rows)
    nxt = running(df, split, leads={"__next": F.col(ts)})
    keep = F.col("__next").isNull() | _apart(F.col("__next"), F.col(ts), gap)
    if flush_col:
        keep = keep | F.coalesce(F.col(flush_col), F.lit(False))
    return nxt.where(keep).drop("__next")


def interaction_spans(
    df: DataFrame, key: str, order: list[str], gap: str, hot_rows: int | None = None, kind: str | None = None
) -> DataFrame:
    """Spans of activity ``[start, last + gap)`` with their number of events.

    The same spans as a session window gives, but a hot key is scanned in chunks and a hot span
    is combined ahead of the shuffle.

    ``kind`` names a column that tells ``begin`` and ``end`` events from others, which only say that there is activity.
    What came last decides: after other activity the span ends when ``gap`` has passed, after ``begin`` it stays open, and
    ``end`` ends it at once.  A span still open has no ``end``; an ``end`` outside of a span is nothing; ``n_events``
    does not count the ends.
    """
    ts = order[0]
    if kind is None:
        src = df.select(key, *order)
        split = Split.of(src, [key], order, hot_rows)
        marked = runs(src, split, "start", F.col(ts), lambda before, here: _apart(here, before, gap), F.col(ts))
        return marked.groupBy(key, "start").agg(
            (F.max(ts) + F.expr(f"interval {gap}")).alias("end"), F.count(F.lit(1)).alias("n_events")
        )
    what = F.when(F.col(kind).isin("begin", "end"), F.col(kind)).otherwise("move")
    src = df.select(key, *order, what.alias("__kind"))
    split = Split.of(src, [key], order, hot_rows)
    row = F.struct(F.col(ts).alias("ts"), F.col("__kind").alias("kind"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    opens = lambda before, here: (before["kind"] == "end") | (
        (before["kind"] == "move") & _apart(here["ts"], before["ts"], gap)
    )
    marked = runs(src, split, "__open", row, opens, row).where(F.col("__open.kind") != "end")
    last = F.max_by(F.struct(F.col(ts).alias("ts"), F.col("__kind").alias("kind")), F.struct(*order))
    spans = marked.groupBy(key, "__open").agg(last.alias("__last"), F.count_if(F.col("__kind") != "end").alias("n_events"))
    end = F.when(F.col("__last.kind") == "end", F.col("__last.ts")).when(
        F.col("__last.kind") == "move", F.col("__last.ts") + F.expr(f"interval {gap}")
    )
    return spans.select(key, F.col("__open.ts").alias("start"), end.alias("end"), "n_events")


def sample_latest(df: DataFrame, key: str, ts: str, every: str, values: list[str], tie: str) -> DataFrame:
    """The latest row in each tick of length ``every``.  The same call works on a watermarked stream."""
    last = F.max_by(F.struct(F.col(ts).alias("ts"), *values), F.struct(ts, tie)).alias("__v")
    return (
        df.groupBy(key, F.window(ts, every).alias("__w"))
        .agg(last)
        .select(
            key,
            F.col("__w.start").alias("tick"),
            F.col("__v.ts").alias(ts),
            *[F.col(f"__v.{v}").alias(v) for v in values],
        )
    )


def _with_active(events: DataFrame, split: Split, kind: str) -> DataFrame:
    """Add ``active`` after, and ``active_before``, each event."""
    k = F.col(kind)
    df = flag(
        events,
        split,
        "active",
        F.when(k == "place", 1).when(k == "dismiss", 0),
        k == "toggle_overlay",
    )
    before = F.when(k == "toggle_overlay", 1 - F.col("active")).otherwise(F.col("active"))
    # place and dismiss hide what was there; nothing below asks for it at these events.
    return df.withColumn("active_before", before)


def session_state(
    events: DataFrame,
    key: str,
    order: list[str],
    kind: str = "kind",
    hot_rows: int | None = None,
    split: Split | None = None,
) -> DataFrame:
    """Add ``active`` and ``live`` (0 / 1) after each control event.

    place: both on.  dismiss: both off.  toggle_overlay: dismiss when active, else place.
    toggle_live: flips live while active.  set_live_on: live if active, else off.
    set_live_off: off.  permission_error: live off.
    """
    split = split or Split.of(events, [key], order, hot_rows)
    df = _with_active(events, split, kind)
    k, active = F.col(kind), F.col("active")
    sets = (
        F.when(k == "place", 1)
        .when(k.isin("dismiss", "permission_error", "set_live_off"), 0)
        .when(k.isin("toggle_overlay", "set_live_on"), active)
    )
    return flag(df, split, "live", sets, (k == "toggle_live") & (active == 1)).drop("active_before")


def availability_status(
    events: DataFrame,
    key: str,
    order: list[str],
    kind: str = "kind",
    message: str = "message",
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``unavailable`` (0 / 1) and ``last_error`` after each event.

    A failed translation sets both.  An answer, a dismiss, and a live on/off that takes effect
    clear ``unavailable``; a failed capture sets ``last_error``, a good frame or dismiss clears it.
    """
    split = Split.of(events, [key], order, hot_rows)
    df = _with_active(events, split, kind)
    k, before = F.col(kind), F.col("active_before") == 1
    toggles = (
        k.isin("place", "toggle_overlay", "set_live_off")
        | ((k == "toggle_live") & before)
        | ((k == "set_live_on") & before)
    )
    dismisses = (k == "dismiss") | ((k == "toggle_overlay") & before)
    unavailable = F.when(k == "translation_failed", 1).when((k == "answer") | toggles | dismisses, 0)
    error = F.when(
        k.isin("translation_failed", "capture_failed", "permission_error"), F.struct(F.col(message).alias("m"))
    ).when((k == "good_frame") | dismisses, F.struct(F.lit(None).cast("string").alias("m")))
    out = running(df, split, lasts={"__u": unavailable, "__e": error})
    return out.select(
        *events.columns, F.coalesce("__u", F.lit(0)).alias("unavailable"), F.col("__e")["m"].alias("last_error")
    )
