"""Frames in time order: good and bad frames, line identity, carrying results over, late answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linestream.operators.events import session_state
from linestream.scale import Split, running, runs
from linestream.schema import FRAME

IDENTITY = ["session_id", "epoch", "text", "k"]


def route_errors(frames: DataFrame) -> DataFrame:
    """Add ``route`` (``pipeline`` or ``dead_letter``) and ``fatal`` (a permission failure stops live)."""
    return frames.withColumns(
        {
            "route": F.when(F.col("status") == "ok", "pipeline").otherwise("dead_letter"),
            "fatal": F.coalesce(F.col("status") == "permission", F.lit(False)),
        }
    )


_MOMENT = ["ts", "__rank", "__no"]


def _live_moments(frames: DataFrame, control: DataFrame, hot_rows: int | None) -> tuple[DataFrame, Split]:
    """Control events and captures of each session in one order, with the state after each.

    At one time a control event comes ahead of a capture.  ``__clears``: the event takes the lines off and cancels
    what is in flight; ``epoch`` counts these.  ``__was_live``: live was on before it.
    """
    kind = (
        F.when(F.col("status") == "ok", "good_frame").when(F.col("status") == "permission", "permission_error").otherwise("capture_failed")
    )
    own = [c for c in frames.columns if c != "epoch"]
    shots = frames.select(
        "session_id", "ts", F.lit(1).alias("__rank"), F.col("frame_seq").alias("__no"), kind.alias("__kind"), F.struct(*own).alias("__frame")
    )
    asked = control.select(
        "session_id", "ts", F.lit(0).alias("__rank"), F.col("no").cast("long").alias("__no"), F.col("kind").alias("__kind")
    )
    both = shots.unionByName(asked, allowMissingColumns=True)
    split = Split.of(both, ["session_id"], _MOMENT, hot_rows)
    state = session_state(both, "session_id", _MOMENT, "__kind", split=split)
    k = F.col("__kind")
    clears = k.isin("place", "dismiss", "toggle_overlay", "set_live_off") | (
        k.isin("toggle_live", "set_live_on") & (F.col("active") == 1)
    )
    out = running(
        state.withColumn("__clears", F.coalesce(clears, F.lit(False))),
        split,
        sums={"epoch": F.col("__clears").cast("int")},
        lags={"__was_live": F.col("live")},
    )
    return out.withColumn("__was_live", F.coalesce("__was_live", F.lit(0))), split


def live_epochs(frames: DataFrame, control: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Captures with the ``epoch`` and ``route`` that the control events of their session give them.

    ``control``: ``session_id, ts, no, kind``, the kinds of ``session_state``.  Each start or stop of live and
    each dismiss that takes effect opens an epoch.  A permission failure stops live; so captures after it, like those
    while live is paused or the overlay is off, are ``ignored`` until live starts again.  What was asked before the failure
    is still awaited, as only the captures stop.
    """
    moments, _ = _live_moments(frames, control, hot_rows)
    routed = route_errors(moments.where(F.col("__frame").isNotNull()).select("__frame.*", "epoch", "__was_live"))
    return routed.withColumn("route", F.when(F.col("__was_live") == 1, F.col("route")).otherwise("ignored")).drop("__was_live")


def good_frames(frames: DataFrame, hot_rows: int | None = None, control: DataFrame | None = None) -> DataFrame:
    """The good frames, numbered ``seq`` = 1, 2, ... in their session, with what comes next.

    ``next_ts`` is the time up to which answers to the frame count: that of the session's next good frame;
    ``continues`` says that this one is in the same epoch, so that its lines follow on from this frame's.  Frames
    without lines are kept: they clear the lines and so break identity.

    Without ``control`` the frames name their ``epoch`` themselves and all were captured while live.  With it (see
    ``live_epochs``) epochs come from the control events, captures made while live is off do not count, and an event that
    clears the lines ends the answers of the frame before it.
    """
    if control is None:
        ok = frames.where(F.col("status") == "ok")
        split = Split.of(ok, ["session_id"], ["frame_seq"], hot_rows)
        num = running(
            ok,
            split,
            sums={"seq": F.lit(1)},
            leads={"next_ts": F.col("ts"), "__next_epoch": F.col("epoch")},
        )
        return num.withColumn("continues", F.coalesce(F.col("__next_epoch") == F.col("epoch"), F.lit(False))).drop(
            "__next_epoch"
        )
    moments, split = _live_moments(frames, control, hot_rows)
    shown = (F.col("__kind") == "good_frame") & (F.col("live") == 1)
    cuts = moments.where(shown | F.col("__clears"))
    num = running(
        cuts,
        split,
        sums={"seq": shown.cast("int")},
        leads={"next_ts": F.col("ts"), "__next": F.col("__frame").isNotNull()},
    )
    return num.where(F.col("__frame").isNotNull()).select(
        "__frame.*", "epoch", "seq", "next_ts", F.coalesce("__next", F.lit(False)).alias("continues")
    )


def on_good_frames(lines: DataFrame, numbered: DataFrame, cols: list[str]) -> DataFrame:
    """Lines of good frames with frame columns ``cols``."""
    return lines.join(numbered.select(*FRAME, *cols), FRAME)


def _occurrence(lines: DataFrame) -> DataFrame:
    """Add ``k``: the how-manieth occurrence of its text in its frame a line is."""
    w = Window.partitionBy(*FRAME, "text").orderBy("line_no")
    return lines.withColumn("k", F.row_number().over(w))


def line_identity(lines: DataFrame, frames: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Add ``seq``, ``epoch``, ``k``, ``first_seq`` and ``line_id`` to the lines of good frames.

    The k-th occurrence of a text keeps the identity of its k-th occurrence in the good frame
    just before; so an identity is an unbroken run of ``seq``, and is named by the run's start.
    """
    numbered = good_frames(frames, hot_rows)
    occ = occurrences(lines, numbered)
    return name_identities(occ, identity_split(occ, hot_rows))


def occurrences(lines: DataFrame, numbered: DataFrame) -> DataFrame:
    """Lines of good frames with ``seq``, ``epoch`` and ``k``."""
    return _occurrence(on_good_frames(lines, numbered, ["seq", "epoch"]))


def identity_split(occ: DataFrame, hot_rows: int | None = None) -> Split:
    """The order in which identities are followed; made once for identity and carrying."""
    return Split.of(occ, IDENTITY, ["seq"], hot_rows)


def name_identities(occ: DataFrame, split: Split) -> DataFrame:
    named = runs(
        occ, split, "first_seq", F.col("seq"), lambda before, here: before != here - 1, F.col("seq")
    )
    name = F.concat_ws(":", "session_id", "epoch", "first_seq", "k", F.md5("text"))
    return named.withColumn("line_id", name)


def frame_diff(lines: DataFrame, frames: DataFrame, attrs: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """What each good frame changed against the one before: ``kept``, ``added``, ``removed`` lines.

    Kept lines show the new frame's ``attrs``, removed ones the old frame's.  The first frame of an
    epoch only adds.
    """
    attrs = attrs or ["line_no"]
    occ = _occurrence(on_good_frames(lines, good_frames(frames, hot_rows), ["seq", "epoch", "continues"]))
    # Each line twice, for its own frame and for the next: one grouped reduce brings the two frames' sides together.
    here = F.struct(F.col("seq").alias("seq"), F.lit(True).alias("cur"))
    after = F.struct((F.col("seq") + 1).alias("seq"), F.lit(False).alias("cur"))
    sides = F.when(F.col("continues"), F.array(here, after)).otherwise(F.array(here))
    each = occ.select("session_id", "epoch", "text", "k", F.struct(*attrs).alias("__a"), F.explode(sides).alias("__s"))
    key = ["session_id", "epoch", "seq", "text", "k"]
    side = lambda cur: F.first(F.when(F.col("__s.cur") == cur, F.col("__a")), ignorenulls=True)
    both = each.withColumn("seq", F.col("__s.seq")).groupBy(*key).agg(side(True).alias("__cur"), side(False).alias("__old"))
    change = (
        F.when(F.col("__cur").isNull(), "removed").when(F.col("__old").isNull(), "added").otherwise("kept")
    )
    shown = F.coalesce("__cur", "__old")
    return both.select(*key, change.alias("change"), *[shown[a].alias(a) for a in attrs])


def carry_forward(
    lines: DataFrame,
    value: str = "value",
    out: str = "translated",
    carry_key: list[str] | None = None,
    split: Split | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Fill ``out`` with the last known ``value`` of the line's identity up to its frame.

    As in the live overlay, a value outlives a change of target or strategy until live is
    toggled; name these columns in ``carry_key`` to stop that.

    The scan runs over all occurrences of a text, in the same partitions as the naming of the
    identities; a value from ahead of the identity's first frame does not count.
    """
    if split is None:
        split = Split.of(lines, IDENTITY + (carry_key or []), ["seq"], hot_rows)
    last = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("seq").alias("at")))
    seen = running(lines, split, lasts={"__last": last})
    return seen.withColumn(out, F.when(F.col("__last.at") >= F.col("first_seq"), F.col("__last.v"))).drop("__last")


def drop_stale_responses(
    responses: DataFrame, frames: DataFrame, hot_rows: int | None = None, control: DataFrame | None = None
) -> DataFrame:
    """Answers that arrive while their frame is the session's latest good one.

    With ``control``, a pause, a restart or a dismiss ends that too (see ``good_frames``).  An equi-join on the frame, then a
    test of the time; frames are unique on the key.
    """
    return fresh_on_good(responses, good_frames(frames, hot_rows, control))


def fresh_on_good(responses: DataFrame, numbered: DataFrame) -> DataFrame:
    f = numbered.select(*FRAME, F.col("ts").alias("__from"), F.col("next_ts").alias("__to"))
    live = (F.col("ts") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("ts") < F.col("__to")))
    return responses.join(f, FRAME).where(live).drop("__from", "__to")


def frame_status(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per frame: number of lines, in the target language, from the memory, pending; ``is_translating``."""
    n = lambda c: F.count_if(c)
    return lines.groupBy(*(keys or FRAME)).agg(
        F.count(F.lit(1)).alias("n_lines"),
        n(F.col("same_language")).alias("n_same"),
        n(F.col("cache_hit")).alias("n_hits"),
        n(F.col("translated").isNull()).alias("n_pending"),
        F.bool_or(F.col("translated").isNull()).alias("is_translating"),
    )
