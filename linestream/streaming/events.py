"""Event operators on streams.  ``ts`` must be ``timestamp`` (watermarks refuse the form without zone)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linestream.streaming.state import needs_rocksdb


def debounce_stream(
    df: DataFrame, key: str, ts: str, gap: str, delay: str, values: list[str], tie: str, flush_col: str | None = None
) -> DataFrame:
    """The last event of each burst, as ``debounce_last`` gives it.

    A flush event goes through at once; its burst then gives nothing but an event after it.
    """
    src = df.withWatermark(ts, delay)
    keep = [ts, *values]
    flush = F.coalesce(F.col(flush_col), F.lit(False)) if flush_col else F.lit(False)
    last = F.max_by(F.struct(*keep, flush.alias("__flush")), F.struct(ts, tie)).alias("__v")
    bursts = src.groupBy(key, F.session_window(ts, gap).alias("__w")).agg(last)
    out = bursts.where(~F.col("__v.__flush")).select(key, *[F.col(f"__v.{c}").alias(c) for c in keep])
    if flush_col:
        out = out.unionByName(df.where(flush).select(key, *keep))
    return out


def spans_stream(df: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Spans of activity, as ``interaction_spans`` gives them."""
    w = F.session_window(ts, gap).alias("__w")
    return (
        df.withWatermark(ts, delay)
        .groupBy(key, w)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), "n_events")
    )


class SpanFold(StatefulProcessor):
    """The open span of one key: when it began, its last event, how many there were.  Times are microseconds."""

    def __init__(self, gap: timedelta, key: str) -> None:
        self.gap, self.key = gap // timedelta(microseconds=1), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("span", "start long, at long, kind string, n long")

    def close(self) -> None:
        pass

    def _told(self, key, start: int, end: int, n: int) -> Row:
        return Row(self.key, "start", "end", "n_events")(key[0], start, end, n)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out, span = [], self.state.get()
        span = tuple(span) if span else None
        for r in sorted(rows, key=lambda r: (r.at, r.tie)):
            if span and span[2] == "move" and r.at > span[1] + self.gap:
                out.append(self._told(key, span[0], span[1] + self.gap, span[3]))
                span = None
            if r.kind == "end":
                if span:
                    out.append(self._told(key, span[0], r.at, span[3]))
                span = None
            else:
                span = (span[0] if span else r.at, r.at, r.kind, span[3] + 1 if span else 1)
        if span:
            self.state.update(span)
            if span[2] == "move":  # told when the watermark has passed its end, unless more comes
                self.handle.registerTimer((span[1] + self.gap) // 1000 + 1)
        else:
            self.state.clear()
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        span = self.state.get()
        if span and span[2] == "move" and (span[1] + self.gap) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.state.clear()
            yield self._told(key, span[0], span[1] + self.gap, span[3])


def interaction_stream(df: DataFrame, key: str, ts: str, gap: timedelta, delay: str, tie: str, kind: str) -> DataFrame:
    """Spans with ``begin`` and ``end`` events, as ``interaction_spans`` gives them, each told once it is over.

    The state of a key is its open span alone.  A span after ``begin`` is told when something ends it.  Events of a key
    must come in order of time from batch to batch; within one they are put in order.
    """
    needs_rocksdb(df.sparkSession)
    what = F.when(F.col(kind).isin("begin", "end"), F.col(kind)).otherwise("move")
    src = df.select(key, F.col(ts).alias("__ts"), F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), what.alias("kind"))
    schema = f"{key} {df.schema[key].dataType.simpleString()}, start long, end long, n_events long"
    told = src.withWatermark("__ts", delay).groupBy(key).transformWithState(
        statefulProcessor=SpanFold(gap, key), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return told.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})
