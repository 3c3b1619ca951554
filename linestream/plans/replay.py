"""The live overlay over recorded frames: what every line showed at the end of every frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestream.operators.frames import (
    IDENTITY,
    carry_forward,
    fresh_on_good,
    good_frames,
    name_identities,
    occurrences,
)
from linestream.operators.language import Profile, resolve_sources
from linestream.operators.memory import tm_lookup
from linestream.operators.text import clean_lines
from linestream.scale import Split, lookup_join, materialize, running
from linestream.schema import AUTO, FRAME, LINE

#: An identity with the digest of its text, by which its name goes too: the scans over what lines show need not move the texts.
KEY = ["text_key" if c == "text" else c for c in IDENTITY]
#: What a growing cache is asked by; without one, an answer serves the run of its own line only.
SCOPES = {
    "app": ["source_max", "text_key"],
    "session": ["session_id", "source_max", "text_key"],
    None: [*KEY, "first_seq"],
}
#: Later answers win; of answers at one time the order below, which is total.
_SAID = ["ts", "arrival", "answer", *LINE]


def replay_live(
    frames: DataFrame,
    lines: DataFrame,
    tm: DataFrame,
    responses: DataFrame,
    configured: str | None = AUTO,
    target: str = "en",
    strategy: str = "lowLatency",
    profile: Profile | None = None,
    cache: str | None = "app",
    carry_key: list[str] | None = None,
    hot_rows: int | None = None,
    control: DataFrame | None = None,
) -> DataFrame:
    """One row per line of each good frame, with its identity and its ``translated`` text.

    ``responses``: ``LINE + (answer, ts, arrival)``.  A line is asked for when nothing is known for it at its
    frame: it is not in the target language, neither in ``tm`` nor in the cache, and carries nothing over.  Only
    then do its answers count, and only while its frame is the session's latest good one.  ``configured=None`` takes
    the ``source`` column of ``lines`` as given.

    ``cache``: answers that count also serve all later frames with a line of the same source and text: those of every
    session (``app``), of their own (``session``), or none (``None``).  At one time a frame comes ahead of an answer.
    ``control``: see ``good_frames``.
    """
    # A few columns per frame, asked for at every step: numbered once, written once.
    numbered = materialize(good_frames(frames, hot_rows, control))
    # Counted for hot keys and then numbered: the texts are brought to their frames once.
    occ = materialize(occurrences(clean_lines(lines), numbered).withColumn("text_key", F.unhex(F.md5("text"))))
    split = Split.of(occ, KEY, ["seq"], hot_rows)
    named = name_identities(occ, split)
    if configured is not None:
        named = named.drop("source")
    sourced = named if configured is None else resolve_sources(named, configured, profile, checkpoint=True)
    found = tm_lookup(sourced, tm, target, strategy).withColumnRenamed("translated", "known")
    # Asked for by the answers, by the cache and by the carrying: worked out once.
    found = materialize(found)
    start = numbered.select(*FRAME, F.col("ts").alias("__at"))
    waiting = found.where(F.col("known").isNull()).select(*LINE, *KEY[1:], "first_seq", "source_max", "seq")
    offered = fresh_on_good(responses.where(F.col("answer").isNotNull()), numbered).select(*LINE, "answer", "ts", "arrival")
    offers = materialize(waiting.join(offered, LINE).join(start, FRAME))
    scope = SCOPES[cache]
    told = _told(found, offers, start, scope, carry_key, split, hot_rows, mixed=configured in (None, AUTO))
    shown = _shown(found, told, start, scope, carry_key, split, hot_rows)
    return shown.drop("known", "remembered", "own", "value", "text_key")


def _first_asked(offers: DataFrame, scope: list[str]) -> DataFrame:
    """Offers to lines that were shown no later than their key's first answer.

    The first answer to a key was asked for, as nothing could be known before it; whoever was shown later
    knew it.  So one minimum per key, combined ahead of the shuffle, says which lines were asked for.
    """
    first = offers.groupBy(*scope).agg(F.min("ts").alias("__first"))
    return lookup_join(offers, first, scope).where(F.col("__at") <= F.col("__first")).drop("__first")


def _told(
    found: DataFrame,
    offers: DataFrame,
    start: DataFrame,
    scope: list[str],
    carry_key: list[str] | None,
    split: Split,
    hot_rows: int | None,
    mixed: bool,
) -> DataFrame:
    """Those of ``offers`` that answer a line that was asked for.

    A text that has one source wherever it is carried over is settled by ``_first_asked``: a value it
    carries is in the cache too.  A text whose source changes from frame to frame may carry a value that the cache
    does not have under its new source.  These are settled in rounds: the lines that the last round's answers leave
    without a value are asked for.  What a round decides rests on earlier answers only, so each round settles at least
    the next answer of each text, and they end when nothing changes.
    """
    told = _first_asked(offers, scope)
    if not mixed:
        return told
    runs = found.groupBy("session_id", "epoch", "text_key").agg(F.min("source_max").alias("a"), F.max("source_max").alias("b"))
    texts = materialize(runs.where(~F.col("a").eqNullSafe(F.col("b"))).select("text_key").distinct())
    if texts.isEmpty():
        return told
    part = lambda df, how: lookup_join(df, texts, ["text_key"], how)
    some, open_offers = materialize(part(found.drop("text"), "left_semi")), materialize(part(offers, "left_semi"))
    now, mark = materialize(part(told, "left_semi")), None
    while True:
        size = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*_SAID).cast("decimal(38,0)")).alias("h")).first()
        if mark == tuple(size):
            break
        mark = tuple(size)
        at_frame = _shown(some, now, start, scope, carry_key, split, hot_rows)
        before = running(at_frame, split, lags={"__before": F.struct("translated", "seq")})
        carried = F.when((F.col("__before.seq") == F.col("seq") - 1) & (F.col("seq") > F.col("first_seq")), F.col("__before.translated"))
        asked = before.where(F.coalesce("known", "remembered", carried).isNull()).select(*LINE)
        now = materialize(open_offers.join(asked, LINE, "left_semi"))
    return part(told, "left_anti").unionByName(now)


def _shown(
    found: DataFrame,
    told: DataFrame,
    start: DataFrame,
    scope: list[str],
    carry_key: list[str] | None,
    split: Split,
    hot_rows: int | None,
) -> DataFrame:
    """``found`` with ``remembered`` (the cache at the frame), ``own`` (the line's last answer) and ``translated``."""
    last: Column = F.max_by("answer", F.struct(*_SAID))
    own = told.groupBy(*LINE).agg(last.alias("own"))
    asked = found.join(own, LINE, "left")
    if "first_seq" in scope:
        asked = asked.withColumn("remembered", F.lit(None).cast("string"))
    else:
        asked = _with_cache(asked, told, start, scope, hot_rows)
    value = F.coalesce("known", "remembered", "own")
    if carry_key:
        split = Split.of(asked, KEY + carry_key, ["seq"], hot_rows)
    return carry_forward(asked.withColumn("value", value), split=split)


def _with_cache(asked: DataFrame, told: DataFrame, start: DataFrame, scope: list[str], hot_rows: int | None) -> DataFrame:
    """Add ``remembered``: the last answer to the same key ahead of the line's frame.

    An as-of join: lines of keys that have an answer and the answers themselves in one order of time, a frame ahead of
    the answers of its moment.  Other lines take no part in it.
    """
    keys = told.groupBy(*scope).agg(F.min("ts").alias("__first"))
    when = lookup_join(asked.where(F.col("known").isNull()).join(start, FRAME), keys, scope)
    late = when.where(F.col("__first") < F.col("__at"))
    moments = late.select(
        *LINE, *[c for c in scope if c not in LINE], F.col("__at").alias("__ts"), F.lit(0).alias("__tag"),
        F.lit(None).cast("long").alias("__arrival"), F.lit(None).cast("string").alias("__say"),
    )
    answers = told.select(
        *LINE, *[c for c in scope if c not in LINE], F.col("ts").alias("__ts"), F.lit(1).alias("__tag"),
        F.col("arrival").cast("long").alias("__arrival"), F.col("answer").alias("__say"),
    )
    both = moments.unionByName(answers)
    split = Split.of(both, scope, ["__ts", "__tag", "__arrival", "__say", *LINE], hot_rows)
    seen = running(both, split, lasts={"remembered": F.col("__say")})
    return asked.join(seen.where(F.col("__tag") == 0).select(*LINE, "remembered"), LINE, "left")
