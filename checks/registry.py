"""One query per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from linestream.functions.languages import LIKELY, maximal_id, primary_subtag
from linestream.operators import events as ev
from linestream.operators import frames as fr
from linestream.operators import geometry as geo
from linestream.operators import language as lg
from linestream.operators import memory as mem
from linestream.operators import sections as sec
from linestream.operators import text as tx
from linestream.plans.capture import lexicon_backend, translate_capture, translator_backend
from linestream.plans.replay import replay_live as replay
from linestream.scale import shared_dir
from linestream.schema import FRAME, LINE
from linestream.sources.sinks import export_stamped
from linestream.sources.tables import lines_from_text, read_lines
from linestream.streaming import sinks
from linestream.streaming.events import interaction_stream
from linestream.streaming.live import fresh_responses_stream, live_events, live_translate, shown_lines
from linestream.streaming.state import rocksdb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TARGET, STRATEGY = "en", "lowLatency"
WIDTH, HEIGHT = 1920.0, 1080.0
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# Sources and sinks


@query("read_lines")
def _(spark, sf):
    docs = read_lines(spark, f"{sf}/documents.parquet", schema=DOCUMENTS)
    return docs.select("doc_id", "lang", F.length("text").alias("n"))


@query("lines_from_text")
def _(spark, sf):
    return lines_from_text(fx.documents(spark, sf), ["doc_id"])


@query("latest_region")
def _(spark, sf):
    return ev.latest_region(fx.regions(spark, sf), "user_id", ["ts", "event_id"], ["ts", "x", "y", "w", "h"])


@query("export_stamped")
def _(spark, sf):
    return export_stamped(fx.events(spark, sf).select("event_id", "ts"), "ts", "capture").select("event_id", "name")


# Projections and filters


@query("clean_lines")
def _(spark, sf):
    # Every third line gets white space around it, every eleventh is white space only.
    n = F.col("doc_id") + F.col("line_no")
    pad = (
        F.when(n % 11 == 0, F.lit("\u00a0\u2003\t"))
        .when(n % 3 == 0, F.concat(F.lit("\u3000\u00a0 "), F.col("text"), F.lit("\u0085\u2028\t ")))
        .otherwise(F.col("text"))
    )
    return tx.clean_lines(fx.lines(spark, sf).withColumn("text", pad)).select(*LINE, "text")


@query("flip_boxes")
def _(spark, sf):
    return rounded(geo.flip_boxes(fx.boxes(spark, sf)).select(*LINE, "x", "y", "w", "h"), "y")


@query("boxes_to_pixels")
def _(spark, sf):
    b = fx.boxes(spark, sf).withColumn("translated", F.when(F.col("doc_id") % 7 == 0, F.lit("")))
    out = geo.boxes_to_pixels(b, WIDTH, HEIGHT).select(*LINE, "px", "py", "py_up", "pw", "ph")
    return rounded(out, "px", "py", "py_up", "pw", "ph")


@query("rect_from_drag")
def _(spark, sf):
    return geo.rect_from_drag(fx.drags(spark, sf)).select("drag_id", "x", "y", "w", "h")


@query("clip_rects")
def _(spark, sf):
    d = fx.displays(spark, sf)
    placed = geo.max_overlap_display(fx.rects(spark, sf), d, ["rect_id"])
    return geo.clip_rects(placed, d).select("rect_id", "display_id", "clip_x", "clip_y", "clip_w", "clip_h")


@query("pickable_windows")
def _(spark, sf):
    return geo.pickable_windows(fx.windows(spark, sf), 3, 800.0).select("window_id", "z", "x", "y", "w", "h")


@query("line_font_size")
def _(spark, sf):
    b = fx.boxes(spark, sf).withColumns(
        {
            "translated": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("tm:"), F.col("text"))),
            "row_count": (F.col("line_no") % 3).cast("int"),
            "is_vertical": F.col("dir") == "ttb",
            "char_scale": F.when(F.col("line_no") % 2 == 0, 0.0).otherwise(0.01),
            "h": F.when(F.col("line_no") % 4 == 0, 0.3).otherwise(0.02),
        }
    )
    return rounded(geo.line_font_size(b, WIDTH, HEIGHT).select(*LINE, "font_size"), "font_size")


# Aggregations


@query("paragraph_rollup")
def _(spark, sf):
    out = geo.paragraph_rollup(fx.boxes(spark, sf), [*FRAME, "para_no"])
    return rounded(out, "x", "y", "w", "h", "char_scale")


@query("paragraph_rollup_padded")
def _(spark, sf):
    """White space around some lines, and paragraphs of white space only."""
    text = (
        F.when(F.col("para_no") % 5 == 1, F.lit("\u00a0 \t"))
        .when(F.col("line_no") % 3 == 0, F.concat(F.lit("\u3000 "), F.col("text")))
        .otherwise(F.concat(F.col("text"), F.lit(" \u2028")))
    )
    out = geo.paragraph_rollup(fx.boxes(spark, sf).withColumn("text", text), [*FRAME, "para_no"])
    return out.select(*FRAME, "para_no", "text", "row_count")


@query("assemble_original")
def _(spark, sf):
    return tx.assemble_original(fx.lines(spark, sf))


def _looked_up(spark, sf, tm=None):
    return mem.tm_lookup(fx.resolved(spark, sf), fx.tm(spark, sf) if tm is None else tm, TARGET, STRATEGY)


@query("assemble_translation_region")
def _(spark, sf):
    return tx.assemble_translation(_looked_up(spark, sf), "region")


@query("assemble_translation_live")
def _(spark, sf):
    return tx.assemble_translation(_looked_up(spark, sf), "live")


@query("frame_status")
def _(spark, sf):
    return fr.frame_status(_looked_up(spark, sf))


@query("translation_batches")
def _(spark, sf):
    out = mem.translation_batches(fx.requests(spark, sf))
    flat = F.array_join(F.transform("items", lambda r: F.concat(r["line_id"], F.lit("="), r["text"])), "\n")
    return out.select(*FRAME, "source_max", "n", flat.alias("items"))


# Language


def _profile(spark, sf):
    return lg.language_profile(lines_from_text(fx.documents(spark, sf), ["doc_id", "lang"]), ["de", "en", "es", "fr"])


@query("language_profile")
def _(spark, sf):
    p = _profile(spark, sf)
    cols = [F.round(f"lp_{i}", 6).alias(f"lp_{v}") for i, v in enumerate(p.langs)]
    return p.grams.select("g", *cols)


@query("detect_language")
def _(spark, sf):
    texts = lines_from_text(fx.documents(spark, sf), ["doc_id"])
    found = lg.detect_language(texts, _profile(spark, sf), ["doc_id", "line_no"], 0.65)
    return rounded(found, "confidence")


@query("resolve_sources")
def _(spark, sf):
    lines = tx.clean_lines(fx.lines(spark, sf))
    return lg.resolve_sources(lines, "auto", _profile(spark, sf)).select(*LINE, "source")


@query("normalize_language")
def _(spark, sf):
    c = F.col("code")
    return fx.language_codes(spark, sf).select(
        "doc_id", "code", primary_subtag(c).alias("primary"), maximal_id(c).alias("maximal")
    )


@query("normalize_language_table")
def _(spark, sf):
    likely = spark.createDataFrame(list(LIKELY.items()), "tag string, full string")
    found = lg.maximal_ids(fx.language_codes(spark, sf), likely)
    return found.select("doc_id", "code", primary_subtag(F.col("code")).alias("primary"), "maximal")


def _catalog(spark, sf, for_source):
    docs = fx.table(spark, sf, "documents").select(F.col("lang").alias("code"))
    html = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    pages = fx.table(spark, sf, "pages").select(html.alias("code"))
    return lg.language_catalog(docs, pages, fx.language_names(spark), for_source)


@query("language_catalog_source")
def _(spark, sf):
    return _catalog(spark, sf, True)


@query("language_catalog_target")
def _(spark, sf):
    return _catalog(spark, sf, False)


@query("language_display_name")
def _(spark, sf):
    return lg.language_display_name(fx.language_codes(spark, sf), fx.language_names(spark)).select(
        "doc_id", "code", "display"
    )


# Joins


@query("tm_lookup")
def _(spark, sf):
    return _looked_up(spark, sf).select(*LINE, "source_max", "same_language", "cache_hit", "translated")


@query("pending_lines")
def _(spark, sf):
    return fx.requests(spark, sf).select("line_id", "source", "text")


@query("match_responses")
def _(spark, sf):
    req = fx.requests(spark, sf)
    return mem.match_responses(req, fx.responses(spark, sf, req)).select("line_id", "source", "text", "answer")


def _applied(spark, sf, policy):
    tm = fx.tm(spark, sf)
    lines = _looked_up(spark, sf, tm).withColumn("line_id", fx.line_id())
    req = fx.requests(spark, sf, tm)
    answers = mem.match_responses(req, fx.responses(spark, sf, req)).select("line_id", "answer")
    return mem.apply_translations(lines, answers, policy, ["line_id"]).select("line_id", "translated")


@query("apply_translations_region")
def _(spark, sf):
    return _applied(spark, sf, "region")


@query("apply_translations_live")
def _(spark, sf):
    return _applied(spark, sf, "live")


@query("max_overlap_display")
def _(spark, sf):
    out = geo.max_overlap_display(fx.rects(spark, sf), fx.displays(spark, sf), ["rect_id"])
    return out.select("rect_id", "display_id")


@query("topmost_window_at")
def _(spark, sf):
    wins = geo.pickable_windows(fx.windows(spark, sf), 3, 800.0)
    return geo.topmost_window_at(fx.points(spark, sf), wins).select("point_id", "window_id")


def _snapshots(df, key):
    """Every row in three of five snapshots, each time a little further to the right."""
    each = df.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("snapshot", (F.col(key) + F.col("j")) % 5)
    return each.withColumn("x", F.col("x") + F.col("j") * 7.0)


@query("topmost_window_at_snapshots")
def _(spark, sf):
    wins = _snapshots(geo.pickable_windows(fx.windows(spark, sf), 3, 800.0), "window_id")
    points = fx.points(spark, sf).withColumn("snapshot", F.col("point_id") % 5)
    return geo.topmost_window_at(points, wins, keys=["snapshot"], most=4).select("point_id", "snapshot", "window_id")


@query("max_overlap_display_snapshots")
def _(spark, sf):
    rects, displays = fx.rects(spark, sf).withColumn("snapshot", F.col("rect_id") % 5), _snapshots(fx.displays(spark, sf), "display_id")
    out = geo.max_overlap_display(rects, displays, ["rect_id"], keys=["snapshot"])
    return out.select("rect_id", "snapshot", "display_id")


@query("first_intersecting_display_snapshots")
def _(spark, sf):
    wins, displays = fx.windows(spark, sf).withColumn("snapshot", F.col("window_id") % 5), _snapshots(fx.displays(spark, sf), "display_id")
    out = geo.first_intersecting_display(wins, displays, ["window_id"], keys=["snapshot"])
    return out.select("window_id", "snapshot", "display_id", "scale")


@query("first_intersecting_display")
def _(spark, sf):
    out = geo.first_intersecting_display(fx.windows(spark, sf), fx.displays(spark, sf), ["window_id"])
    return out.select("window_id", "display_id", "scale")


@query("exclude_windows_by_app")
def _(spark, sf):
    return geo.exclude_windows(fx.windows(spark, sf), "app3", [1, 2]).select("window_id", "pid")


@query("exclude_windows_by_id")
def _(spark, sf):
    return geo.exclude_windows(fx.windows(spark, sf), "nobody", [1, 2, 5]).select("window_id", "pid")


@query("drop_stale_responses")
def _(spark, sf):
    out = fr.drop_stale_responses(fx.responses(spark, sf), fx.frames(spark, sf))
    return out.select("line_id", *FRAME, "text", "arrival", "ts")


@query("drop_stale_responses_control")
def _(spark, sf):
    frames, control = fx.frames(spark, sf), fx.live_control(spark, sf)
    out = fr.drop_stale_responses(fx.responses(spark, sf), frames, control=control)
    return out.select("line_id", *FRAME, "text", "arrival", "ts")


@query("live_epochs")
def _(spark, sf):
    out = fr.live_epochs(fx.frames(spark, sf), fx.live_control(spark, sf))
    return out.select(*FRAME, "status", "epoch", "route", "fatal")


# Ordered scans


def _identified(spark, sf):
    return fr.line_identity(fx.lines(spark, sf), fx.frames(spark, sf))


@query("line_identity")
def _(spark, sf):
    return _identified(spark, sf).select(*LINE, "seq", "epoch", "k", "first_seq", "line_id")


@query("frame_diff")
def _(spark, sf):
    b = fx.boxes(spark, sf)
    out = fr.frame_diff(b, fx.frames(spark, sf), ["line_no", "x", "y"])
    return out.select("session_id", "epoch", "seq", "text", "k", "change", "line_no", "x", "y")


@query("carry_forward")
def _(spark, sf):
    # A value only at even frames, so that odd ones have something to carry.
    named = _identified(spark, sf).withColumn(
        "value", F.when(F.col("seq") % 2 == 0, F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("text")))
    )
    return fr.carry_forward(named).select(*LINE, "line_id", "translated")


@query("changes_only")
def _(spark, sf):
    return ev.changes_only(fx.events(spark, sf), "user_id", ["ts", "event_id"], "event_type").select(
        "event_id", "user_id", "event_type"
    )


@query("session_state")
def _(spark, sf):
    return ev.session_state(fx.control(spark, sf), "user_id", ["ts", "event_id"]).select(
        "event_id", "user_id", "kind", "active", "live"
    )


@query("availability_status")
def _(spark, sf):
    return ev.availability_status(fx.status_events(spark, sf), "user_id", ["ts", "event_id"]).select(
        "event_id", "user_id", "kind", "unavailable", "last_error"
    )


# Streams, batch form


@query("debounce_last")
def _(spark, sf):
    return ev.debounce_last(fx.events(spark, sf), "user_id", ["ts", "event_id"], "6 hours").select(
        "event_id", "user_id", "ts"
    )


@query("debounce_last_flush")
def _(spark, sf):
    e = fx.events(spark, sf).withColumn("flush", F.col("event_type") == "purchase")
    return ev.debounce_last(e, "user_id", ["ts", "event_id"], "6 hours", "flush").select("event_id", "user_id", "ts")


@query("interaction_spans")
def _(spark, sf):
    return ev.interaction_spans(fx.events(spark, sf), "user_id", ["ts", "event_id"], "6 hours")


def _interactions(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "signup", "begin").when(t == "purchase", "end").otherwise(t)
    return fx.events(spark, sf).withColumn("kind", kind)


@query("interaction_spans_begin_end")
def _(spark, sf):
    return ev.interaction_spans(_interactions(spark, sf), "user_id", ["ts", "event_id"], "6 hours", kind="kind")


@query("interaction_stream")
def _(spark, sf):
    """The same on a stream, in two arrivals; two later signs of life move the watermark past the last spans."""
    work = shared_dir(spark, "interactions")
    events = _interactions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.col("ts").cast("double")
    half, last = events.agg(F.percentile_approx(at, 0.5), F.max("ts")).first()
    alive = [
        events.limit(1).withColumns(
            {"user_id": F.lit(None).cast("long"), "kind": F.lit("end"), "ts": F.lit(last) + F.expr(f"interval {30 * i} days")}
        )
        for i in (1, 2)
    ]
    for part in (events.where(at <= half), events.where(at > half), *alive):
        part.write.mode("append").parquet(f"{work}/in")
        stream = read_lines(spark, f"{work}/in", streaming=True, schema=events.schema)
        with rocksdb(spark):
            out = interaction_stream(stream, "user_id", "ts", timedelta(hours=6), "0 seconds", "event_id", "kind")
            _rows_of(out.writeStream, work)
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}
    return spark.read.parquet(f"{work}/out").select("user_id", "start", "end", "n_events").withColumns(ntz)


@query("sample_latest")
def _(spark, sf):
    return ev.sample_latest(fx.events(spark, sf), "user_id", "ts", "1 hour", ["event_id", "event_type"], "event_id")


def _said(spark, sf):
    return fx.responses(spark, sf).select(
        F.col("source_max").alias("source"),
        F.lit(STRATEGY).alias("strategy"),
        F.lit(TARGET).alias("target"),
        F.col("source_text").alias("text"),
        F.col("text").alias("translated"),
        "arrival",
    )


@query("tm_upsert")
def _(spark, sf):
    return mem.tm_upsert(fx.tm(spark, sf), _said(spark, sf))


@query("tm_upsert_stream")
def _(spark, sf):
    """The answers in seven arrivals, compacted after each three."""
    work = shared_dir(spark, "tm_upsert_stream")
    res = _said(spark, sf)
    res.write.parquet(f"{work}/all")
    res = spark.read.parquet(f"{work}/all")
    cuts = res.agg(F.percentile_approx("arrival", [i / 7 for i in range(1, 7)])).first()[0] or [0]
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = res.where((F.lit(lo).isNull() | (F.col("arrival") > F.lit(lo))) & (F.lit(hi).isNull() | (F.col("arrival") <= F.lit(hi))))
        part.write.mode("append").parquet(f"{work}/in")
        stream = read_lines(spark, f"{work}/in", streaming=True, schema=res.schema)
        _until_done(stream.writeStream.foreachBatch(sinks.tm_sink(f"{work}/tm", 3)), work)
    return sinks.read_tm(spark, f"{work}/tm", fx.tm(spark, sf))


@query("route_errors")
def _(spark, sf):
    return fr.route_errors(fx.frames(spark, sf)).select(*FRAME, "status", "route", "fatal")


# Translators


@query("lexicon_translate")
def _(spark, sf):
    return tx.lexicon_translate(fx.resolved(spark, sf), fx.lexicon(spark, sf), LINE, TARGET)


def stub_translator(batch: pd.DataFrame) -> pd.Series:
    return "mt:" + batch["text"]


@query("translate_batches")
def _(spark, sf):
    req = fx.requests(spark, sf)
    out = mem.translate_batches(req, stub_translator, TARGET, STRATEGY)
    return mem.join_answers(req, out).select("line_id", "source_max", "text", "answer", "error")


# Sections


def _sections(spark, sf):
    return sec.split_sections(fx.lines(spark, sf), r"^(\S+)\.$")


@query("split_sections")
def _(spark, sf):
    return _sections(spark, sf)


@query("split_sections_dated")
def _(spark, sf):
    """Headings in the default form, with and without a date."""
    n = F.col("doc_id") + F.col("line_no")
    head = F.concat(F.lit("##  "), F.col("text"), F.lit(" "))
    text = (
        F.when(n % 9 == 0, F.concat(head, F.lit(" (2024-01-05)  ")))
        .when(n % 7 == 0, head)
        .otherwise(F.concat(F.lit("\u00a0"), F.col("text")))
    )
    return sec.split_sections(fx.lines(spark, sf).withColumn("text", text))


@query("unique_slugs")
def _(spark, sf):
    s = _sections(spark, sf).withColumn("title", F.concat(F.lit(" "), F.col("title"), F.lit(" - A!")))
    return sec.unique_slugs(s).select("doc_id", "section_no", "title", "slug")


# On a stream: the given table arrives, the query runs until all of it is worked off.


def _until_done(writer, work: str) -> None:
    q = sinks.live_trigger(writer.option("checkpointLocation", f"{work}/state"), once=True).start()
    q.awaitTermination()


@query("live_trigger")
def _(spark, sf):
    work = shared_dir(spark, "live_trigger")
    docs = read_lines(spark, f"{sf}/documents.parquet", streaming=True, schema=DOCUMENTS)
    lines = tx.clean_lines(lines_from_text(docs, ["doc_id"]))
    _until_done(lines.writeStream.foreachBatch(sinks.rows_sink(f"{work}/out")), work)
    return spark.read.parquet(f"{work}/out").select("doc_id", "line_no", "text")


def _arrivals(spark, sf, work):
    """Raw captures, answers and control events in two arrivals; the second is read by a query that goes on from the first one's state."""
    per_frame = fx.resolved(spark, sf).groupBy(*FRAME).agg(F.collect_list(F.struct("line_no", "text", "source")).alias("lines"))
    frames = fx.frames(spark, sf).join(per_frame, FRAME, "left")
    events = live_events(frames, fx.live_answers(spark, sf), fx.live_control(spark, sf))
    events.write.option("compression", "zstd").parquet(f"{work}/all")
    events = spark.read.parquet(f"{work}/all")
    half = events.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5)).first()[0]
    for part in (F.col("ts").cast("double") <= half, F.col("ts").cast("double") > half):
        events.where(part).write.mode("append").option("compression", "zstd").parquet(f"{work}/in")
        yield read_lines(spark, f"{work}/in", streaming=True, schema=events.schema)


def _rows_of(writer, work: str) -> None:
    _until_done(writer.outputMode("append").foreachBatch(sinks.rows_sink(f"{work}/out")), work)


@query("live_translate")
def _(spark, sf):
    work, tm = shared_dir(spark, "live_translate"), fx.tm(spark, sf)
    for stream in _arrivals(spark, sf, work):
        with rocksdb(spark):
            _rows_of(live_translate(stream, tm, TARGET, STRATEGY).writeStream, work)
    return shown_lines(spark.read.parquet(f"{work}/out"))


@query("live_translate_auto")
def _(spark, sf):
    work, tm = shared_dir(spark, "live_translate_auto"), fx.tm(spark, sf)
    profile = _profile(spark, sf)
    for stream in _arrivals(spark, sf, work):
        with rocksdb(spark):
            _rows_of(live_translate(stream, tm, TARGET, STRATEGY, "auto", profile).writeStream, work)
    return shown_lines(spark.read.parquet(f"{work}/out"))


@query("fresh_responses_stream")
def _(spark, sf):
    work = shared_dir(spark, "fresh_responses")
    for stream in _arrivals(spark, sf, work):
        with rocksdb(spark):
            _rows_of(fresh_responses_stream(stream).writeStream, work)
    return spark.read.parquet(f"{work}/out").select(*LINE, "answer", F.col("ts").cast("timestamp_ntz").alias("ts"), "no")


# End to end


def _replay(spark, sf, **kw):
    frames, control = fx.frames(spark, sf), fx.live_control(spark, sf)
    tm = fx.tm(spark, sf)
    lines, answers = fx.resolved(spark, sf), fx.live_answers(spark, sf, tm)
    return replay(frames, lines, tm, answers, target=TARGET, strategy=STRATEGY, control=control, **kw)


REPLAY_COLUMNS = [*LINE, "seq", "line_id", "source_max", "same_language", "cache_hit", "translated"]


@query("replay_live")
def _(spark, sf):
    return _replay(spark, sf, configured=None).select(*REPLAY_COLUMNS)


@query("replay_live_session_cache")
def _(spark, sf):
    return _replay(spark, sf, configured=None, cache="session").select(*REPLAY_COLUMNS)


@query("replay_live_no_cache")
def _(spark, sf):
    return _replay(spark, sf, configured=None, cache=None).select(*REPLAY_COLUMNS)


@query("replay_live_status")
def _(spark, sf):
    return fr.frame_status(_replay(spark, sf, configured=None))


@query("replay_live_auto")
def _(spark, sf):
    return _replay(spark, sf, configured="auto", profile=_profile(spark, sf)).select(*REPLAY_COLUMNS)


@query("translate_capture")
def _(spark, sf):
    backend = lexicon_backend(fx.lexicon(spark, sf), TARGET)
    lines = translate_capture(fx.lines(spark, sf), backend, "auto", TARGET, STRATEGY, _profile(spark, sf))
    return tx.assemble_translation(lines, "region")


def failing_translator(batch: pd.DataFrame) -> pd.Series:
    if batch["source"].iloc[0].startswith("de"):
        raise RuntimeError("no model")
    return "mt:" + batch["text"]


@query("translate_capture_failures")
def _(spark, sf):
    """A translator without a model for one of the languages."""
    backend = translator_backend(failing_translator, TARGET, STRATEGY)
    lines = translate_capture(fx.lines(spark, sf), backend, "auto", TARGET, STRATEGY, _profile(spark, sf))
    return lines.select(*LINE, "translated", "unavailable", "error")


@query("translate_capture_lines")
def _(spark, sf):
    backend = translator_backend(stub_translator, TARGET, STRATEGY)
    lines = translate_capture(fx.lines(spark, sf), backend, "fr-FR", TARGET, STRATEGY)
    return lines.select(*LINE, "source_max", "same_language", "translated")
