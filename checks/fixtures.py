"""Inputs of the queries, derived from the given tables by the rules of FIXTURES.md.

Rules only: every table here grows with the tables it is made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linestream.functions.languages import maximal_id
from linestream.scale import Split, materialize, running
from linestream.schema import LINE
from linestream.sources.tables import lines_from_text, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One frame per document; numbered on the two key columns only, never on the texts."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("session_id"))
    num = running(docs, Split.of(docs, ["session_id"], ["doc_id"]), sums={"frame_seq": F.lit(1)})
    return num.select(
        "session_id",
        "frame_seq",
        F.when(F.col("frame_seq") > 25, 1).otherwise(0).alias("epoch"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + frame_seq * interval '0.8' second").alias("ts"),
        F.when(F.col("doc_id") % 17 == 0, "error")
        .when(F.col("doc_id") % 101 == 0, "permission")
        .otherwise("ok")
        .alias("status"),
        "doc_id",
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    # Joined ahead of the split, so a text moves once and as one row.
    docs = documents(spark, sf).join(frames(spark, sf).select("doc_id", "session_id", "frame_seq"), "doc_id")
    each = lines_from_text(docs, ["doc_id", "lang", "session_id", "frame_seq"])
    return each.select("doc_id", "lang", "line_no", "text", "session_id", "frame_seq")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    n, d = F.col("line_no"), F.col("doc_id")
    return lines(spark, sf).withColumns(
        {
            "para_no": F.floor(n / 3),
            "dir": F.when((d + n) % 3 == 0, "ttb").otherwise("ltr"),
            "x": (n % 4) * 0.25,
            "y": ((n * 7) % 50) / 50.0,
            "w": F.lit(0.2),
            "h": F.lit(0.02),
        }
    )


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).withColumnRenamed("lang", "source")


def tm(spark: SparkSession, sf: str) -> DataFrame:
    """What was translated before: every other document, so that the rest of the lines are misses, as a memory has them.

    Written, as a memory is a table: a query looks at its size and at its rows, and would work it out for each look.
    """
    known = (
        lines_from_text(
            documents(spark, sf).where((F.col("doc_id") % 2 == 0) & (F.col("lang") != "en")), ["lang"]
        )
        .select(
            maximal_id(F.col("lang")).alias("source"),
            F.lit("lowLatency").alias("strategy"),
            F.lit("en").alias("target"),
            "text",
        )
        .distinct()
        .withColumn("translated", F.concat(F.lit("tm:"), F.col("text")))
    )
    return materialize(known)


def line_id() -> F.Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))


def requests(spark: SparkSession, sf: str, memory: DataFrame | None = None) -> DataFrame:
    from linestream.operators.memory import pending_lines

    out = pending_lines(resolved(spark, sf), tm(spark, sf) if memory is None else memory, "en", "lowLatency")
    return out.select(*LINE, "doc_id", "source", "source_max", "text", line_id().alias("line_id"))


def responses(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Answers to the requests; a fifth of them never comes, as with a translator that fails on some lines."""
    req = requests(spark, sf) if of is None else of
    k = (F.length("text") * 31 + F.length("line_id")).cast("long")
    out = req.withColumn("arrival", k).where(F.col("arrival") % 5 != 0)
    at = frames(spark, sf).select("doc_id", F.col("ts").alias("__ts"))
    return out.join(at, "doc_id").select(
        *LINE,
        F.when(F.col("arrival") % 13 == 0, "bad").otherwise(F.col("line_id")).alias("line_id"),
        F.concat(F.lit("mt:"), F.col("text")).alias("text"),
        "arrival",
        F.expr("__ts + (arrival % 1600) * interval '0.001' second").alias("ts"),
        "source_max",
        F.col("text").alias("source_text"),
    )


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    each = lines_from_text(documents(spark, sf), ["lang"])
    return (
        each.select(F.col("lang").alias("source"), F.explode(F.split("text", " ", -1)).alias("token"))
        .where(F.length("token") % 2 == 0)  # so that some tokens are unknown, at every size
        .distinct()
        .select("source", F.lit("en").alias("target"), "token", F.concat(F.lit("lx"), F.col("token")).alias("out"))
    )


def language_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A language code per document, in many spellings."""
    up = F.upper("lang")
    forms = [
        F.lit("auto"), F.concat("lang", F.lit("-"), up), F.col("lang"), F.lit("en-US"), F.lit("zh-Hans"),
        F.lit("zh-Hant-TW"), F.lit("pt-BR"), F.lit(""), F.lit("tlh"), F.lit("zh-TW"),
        F.lit("sw"), F.lit("hy"), F.lit("az"), F.lit("az-IR"), F.lit("uz-AF"), F.lit("zh-SG"), F.lit("uz_Cyrl"),
    ]
    code = F.element_at(F.array(*forms), (F.col("doc_id") % len(forms) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", code.alias("code"))


def language_names(spark: SparkSession) -> DataFrame:
    """English names of the fixture's languages."""
    names = {
        "en": "English", "fr": "French", "de": "German", "es": "Spanish", "en-US": "English (US)",
        "en-Latn-US": "English (United States)", "fr-Latn-FR": "French (France)",
        "de-Latn-DE": "German (Germany)", "zh-Hans": "Chinese, Simplified", "pt-BR": "Portuguese (Brazil)",
    }
    rows = [F.struct(F.lit(k).alias("code"), F.lit(v).alias("name")) for k, v in names.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def displays(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, sf, "region").select(
        k.cast("long").alias("display_id"),
        k.cast("long").alias("display_seq"),
        (k * 1000).cast("double").alias("x"),
        F.lit(0.0).alias("y"),
        F.lit(1000.0).alias("w"),
        F.lit(800.0).alias("h"),
        (1 + k % 2).cast("double").alias("scale"),
    )


def rects(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("rect_id"),
        ((k * 37) % 5200).cast("double").alias("x"),
        ((k * 11) % 700).cast("double").alias("y"),
        (40 + F.col("p_size") * 10).cast("double").alias("w"),
        (20 + F.col("p_size") * 5).cast("double").alias("h"),
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("window_id"),
        k.alias("z"),
        F.col("s_nationkey").alias("pid"),
        F.concat(F.lit("app"), F.col("s_nationkey").cast("string")).alias("bundle"),
        F.when(k % 3 == 1, 1).otherwise(0).alias("layer"),
        F.when(k % 10 == 0, 0.0).when(k % 10 != 1, 1.0).alias("alpha"),
        ((k * 53) % 4800).cast("double").alias("x"),
        ((k * 29) % 700).cast("double").alias("y"),
        (20 + (k * 17) % 600).cast("double").alias("w"),
        (20 + (k * 13) % 400).cast("double").alias("h"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("point_id"),
        ((k * 41) % 5000).cast("double").alias("px"),
        ((k * 23) % 900).cast("double").alias("py"),
    )


def drags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("drag_id"),
        (k % 640).cast("double").alias("x0"),
        (k % 480).cast("double").alias("y0"),
        ((k * 7) % 640).cast("double").alias("x1"),
        ((k * 3) % 480).cast("double").alias("y1"),
    )


def live_control(spark: SparkSession, sf: str) -> DataFrame:
    """What a user does around some frames: (session_id, ts, no, kind).

    Starts each session, restarts it at frame 26, pauses and goes on, dismisses and comes back a frame later, and
    starts again at once or two frames after a permission failure.
    """
    d, f = F.col("doc_id"), F.col("frame_seq")
    denied = (d % 101 == 0) & (d % 17 != 0)
    acts = [  # condition, milliseconds from the frame, kind
        (f == 1, -400, "place"),
        (f == 26, -100, "set_live_on"),
        (d % 23 == 0, 300, "set_live_off"),
        (d % 23 == 0, 500, "set_live_on"),
        (d % 29 == 1, 200, "dismiss"),
        (d % 29 == 1, 900, "toggle_overlay"),
        (denied & (d % 2 == 0), 1700, "toggle_live"),
        (denied & (d % 2 == 1), 100, "place"),
        (d % 31 == 2, 250, "toggle_live"),
        (d % 31 == 2, 700, "toggle_live"),
    ]
    each = [
        F.when(when, F.struct(F.lit(i).alias("i"), F.lit(ms).alias("ms"), F.lit(kind).alias("kind")))
        for i, (when, ms, kind) in enumerate(acts)
    ]
    found = frames(spark, sf).select("session_id", "ts", d, F.explode(F.array_compact(F.array(*each))).alias("a"))
    return found.select(
        "session_id",
        F.expr("ts + a.ms * interval '0.001' second").alias("ts"),
        (d * 10 + F.col("a.i")).alias("no"),
        F.col("a.kind").alias("kind"),
    )


def live_answers(spark: SparkSession, sf: str, memory: DataFrame | None = None) -> DataFrame:
    """Answers by line for the live overlay: the responses whose ids exist, each naming its frame in the answer."""
    said = F.concat(F.lit("mt:"), "session_id", F.lit(":"), "frame_seq", F.lit(":"), "source_text")
    return responses(spark, sf, requests(spark, sf, memory)).where(F.col("line_id") != "bad").select(*LINE, said.alias("answer"), "ts", "arrival")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return (
        events(spark, sf)
        .where(F.col("event_type") == "signup")
        .select(
            "user_id",
            "ts",
            "event_id",
            F.col("value").alias("x"),
            (F.col("value") * 2).alias("y"),
            F.lit(520.0).alias("w"),
            F.lit(280.0).alias("h"),
        )
    )


def _kinds(spark: SparkSession, sf: str, names: dict[str, str]) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    return events(spark, sf).select("event_id", "ts", "user_id", kind.alias("kind"))


def control(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(
        spark,
        sf,
        {
            "signup": "place",
            "purchase": "dismiss",
            "view": "toggle_overlay",
            "click": "toggle_live",
            "error": "permission_error",
        },
    )


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    """Translation outcomes; every seventh event is a control event instead."""
    out = _kinds(
        spark,
        sf,
        {
            "error": "translation_failed",
            "signup": "answer",
            "view": "good_frame",
            "purchase": "dismiss",
            "click": "capture_failed",
        },
    )
    k = F.col("event_id") % 35
    kind = (
        F.when(k == 0, "place").when(k == 7, "toggle_overlay").when(k == 14, "toggle_live")
        .when(k == 21, "set_live_on").when(k == 28, "set_live_off").otherwise(F.col("kind"))
    )
    return out.withColumn("kind", kind).withColumn("message", F.concat(F.lit("e"), F.col("event_id").cast("string")))
