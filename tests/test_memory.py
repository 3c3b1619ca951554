import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import QUERIES
from linestream.operators import memory as mem
from linestream.plans.capture import translator_backend
from linestream.scale import fits

LINES = "session_id string, frame_seq long, line_no int, line_id string, text string, source string"


@pytest.fixture(scope="module")
def lines(spark):
    data = [
        ("s", 1, 0, "a", "hola", "es-MX"), ("s", 1, 1, "b", "hello", "en-GB"), ("s", 1, 2, "c", "hola", "es"),
        ("s", 1, 3, "d", "adios", "es"), ("s", 2, 0, "e", "hola", "fr"),
    ]
    return spark.createDataFrame(data, LINES)


@pytest.fixture(scope="module")
def tm(spark):
    return spark.createDataFrame(
        [("es-Latn-ES", "lowLatency", "en-US", "hola", "hi"), ("es-Latn-ES", "lowLatency", "en", "adios", "bye"),
         ("es-Latn-ES", "highFidelity", "en-US", "adios", "farewell")],
        "source string, strategy string, target string, text string, translated string",
    )


@pytest.mark.parametrize("small", [True, False])
def test_key_is_maximal_source_raw_target_and_strategy(lines, tm, rows, small):
    out = mem.tm_lookup(lines, tm, "en-US", "lowLatency", small=small)
    assert rows(out, "line_id", "translated", "cache_hit") == [
        ("a", None, False), ("b", "hello", False), ("c", "hi", True), ("d", None, False), ("e", None, False),
    ]
    left = mem.pending_lines(lines, tm, "en-US", "lowLatency", small=small)
    assert rows(left, "line_id") == [("a",), ("d",), ("e",)]


def test_scripts_of_one_language_pass_through(spark, tm):
    df = spark.createDataFrame([("s", 1, 0, "a", "x", "zh-Hans")], LINES)
    row = mem.tm_lookup(df, tm, "zh-Hant", "lowLatency").first()
    assert row["same_language"] and row["translated"] == "x" and row["source_max"] == "zh-Hans-CN"


def test_batches_are_per_frame_and_ordered(lines, tm):
    left = mem.pending_lines(lines.orderBy(F.desc("line_no")), tm, "en-US", "lowLatency")
    got = mem.translation_batches(left).orderBy("frame_seq", "source_max").collect()
    assert [(r["frame_seq"], r["source_max"], r["n"], [tuple(i) for i in r["items"]]) for r in got] == [
        (1, "es-Latn-ES", 1, [("d", "adios")]), (1, "es-Latn-MX", 1, [("a", "hola")]), (2, "fr-Latn-FR", 1, [("e", "hola")]),
    ]


def test_match_drops_unknown_and_takes_the_last(spark, rows):
    req = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "line_id string, src string")
    res = spark.createDataFrame(
        [("a", "1", 5), ("a", "2", 9), ("a", "3", 7), (None, "q", 1), ("zz", "q", 1), ("b", None, 3), ("b", "4", 1)],
        "line_id string, text string, arrival int",
    )
    assert rows(mem.match_responses(req, res), "line_id", "answer") == [("a", "2"), ("b", "4")]


def test_policies_on_missing_answers(spark, rows):
    lines = spark.createDataFrame([(1, "x", None), (2, "y", "Y"), (3, "z", None)], "id int, text string, translated string")
    ans = spark.createDataFrame([(1, "X")], "id int, answer string")
    assert rows(mem.apply_translations(lines, ans, "region", ["id"]), "translated") == [("X",), ("Y",), ("z",)]
    assert rows(mem.apply_translations(lines, ans, "live", ["id"]), "translated") == [("X",), ("Y",), (None,)]
    with pytest.raises(ValueError):
        mem.apply_translations(lines, ans, "other", ["id"])


def test_upsert_is_last_write_and_idempotent(spark, tm, rows):
    new = spark.createDataFrame(
        [("es-Latn-ES", "lowLatency", "en", "adios", "ciao", 4), ("es-Latn-ES", "lowLatency", "en", "adios", "bye bye", 9),
         ("fr", "lowLatency", "en", "n", "new", 1), ("fr", "lowLatency", "en", "q", None, 1)],
        "source string, strategy string, target string, text string, translated string, arrival long",
    )
    once = mem.tm_upsert(tm, new)
    got = {(r["strategy"], r["target"], r["text"]): r["translated"] for r in once.collect()}
    assert got == {
        ("lowLatency", "en-US", "hola"): "hi", ("lowLatency", "en", "adios"): "bye bye",
        ("highFidelity", "en-US", "adios"): "farewell", ("lowLatency", "en", "n"): "new",
    }
    assert rows(mem.tm_upsert(once, new)) == rows(once)


def test_translator_failure_stays_in_its_group_and_asks_once(spark, rows, tmp_path):
    log = str(tmp_path / "asked")
    data = [(i, "fr-Latn-FR" if i % 3 else "de-Latn-DE", f"t{i % 10}") for i in range(300)]
    pending = spark.createDataFrame(data, "id long, source_max string, text string")

    def translator(req: pd.DataFrame) -> pd.Series:
        assert req["source"].nunique() == 1 and set(req["target"]) == {"en"} and set(req["strategy"]) == {"lowLatency"}
        with open(log, "a") as f:
            f.write("".join(f"{s} {t}\n" for s, t in zip(req["source"], req["text"])))
        if req["source"].iloc[0].startswith("de"):
            raise RuntimeError("no model")
        return req["text"].str.upper()

    answers = mem.translate_batches(pending, translator, "en", "lowLatency", partitions=3)
    out = mem.join_answers(pending, answers)
    got = {(r["source_max"], r["text"], r["answer"], r["error"]) for r in out.collect()}
    assert {g for g in got if g[0] == "fr-Latn-FR"} == {("fr-Latn-FR", f"t{i}", f"T{i}", None) for i in range(10)}
    assert {g[2:] for g in got if g[0] == "de-Latn-DE"} == {(None, "RuntimeError: no model")}
    assert out.count() == 300
    asked = open(log).read().split("\n")[:-1]
    assert len(asked) == len(set(asked)) == 20


def test_one_hot_language_is_asked_in_many_tasks(spark):
    pending = spark.range(4000).select(F.lit("fr-Latn-FR").alias("source_max"), F.col("id").cast("string").alias("text"))
    out = mem.translate_batches(pending, lambda r: r["text"], "en", "lowLatency", partitions=8, checkpoint=False)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_width_follows_the_number_of_texts(spark, monkeypatch):
    monkeypatch.setattr(mem, "TASK_TEXTS", 100)
    pending = spark.range(1000).select(F.lit("fr-Latn-FR").alias("source_max"), F.col("id").cast("string").alias("text"))
    out = mem.translate_batches(pending, lambda r: r["text"], "en", "lowLatency", checkpoint=False)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000


def test_answers_ahead_of_a_failure_stay(spark):
    def translator(req):
        for i, text in enumerate(req["text"]):
            if text == "c":
                raise RuntimeError("lost")
            yield i, text.upper()

    pending = spark.createDataFrame([("fr-Latn-FR", t) for t in "abcd"], "source_max string, text string")
    pending = pending.coalesce(1)
    out = {r["text"]: (r["answer"], r["error"]) for r in mem.translate_batches(pending, translator, "en", "lowLatency", 1).collect()}
    assert out["c"] == (None, "RuntimeError: lost")
    assert all(v in ((t.upper(), None), (None, "RuntimeError: lost")) for t, v in out.items())


def test_unknown_source_is_asked_and_empty_memory_row_knows_nothing(spark):
    lines = spark.createDataFrame([("s", 1, 0, "a", "hola", None), ("s", 1, 1, "b", "hola", "es")], LINES)
    tm = spark.createDataFrame(
        [("es-Latn-ES", "lowLatency", "en", "hola", None)], "source string, strategy string, target string, text string, translated string"
    )
    assert {r["line_id"] for r in mem.pending_lines(lines, tm, "en", "lowLatency").collect()} == {"a", "b"}
    found = mem.tm_lookup(lines, tm, "en", "lowLatency").collect()
    assert {(r["same_language"], r["cache_hit"], r["translated"]) for r in found} == {(False, False, None)}


def test_tasks_that_ask_do_not_grow_with_the_texts(spark):
    """One per thousand texts as long as they are few; the driver's books on them stay bounded at any size."""
    assert [mem._call_tasks(n, spark) for n in (0, 1, 1_000, 1_001, 5_000)] == [1, 1, 1, 2, 5]
    most = mem._call_tasks(10**6, spark)
    assert most == mem._call_tasks(10**9, spark) <= max(mem.TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_lines_go_to_their_answers_without_texts(spark, rows, monkeypatch):
    sides = []
    old = mem.lookup_join
    monkeypatch.setattr(mem, "lookup_join", lambda left, right, on: sides.append(left.columns) or old(left, right, on))
    lines = spark.createDataFrame(
        [("s", 1, 0, "fr-Latn-FR", "a", 7), ("s", 1, 1, "fr-Latn-FR", "a", 8), ("s", 1, 2, "fr-Latn-FR", "b", 9), ("s", 1, 3, None, "a", 1)],
        "session_id string, frame_seq long, line_no int, source_max string, text string, more int",
    )
    run = translator_backend(lambda batch: ("mt:" + batch["text"]).where(batch["text"] != "b"), "en", "lowLatency")
    out = run(lines)
    assert rows(out, "line_no", "source_max", "text", "more", "answer") == rows(
        spark.createDataFrame(
            [(0, "fr-Latn-FR", "a", 7, "mt:a"), (1, "fr-Latn-FR", "a", 8, "mt:a"), (2, "fr-Latn-FR", "b", 9, None), (3, None, "a", 1, None)],
            "line_no int, source_max string, text string, more int, answer string",
        )
    )
    assert sides and all("text" not in s for s in sides)


def test_size_checks_move_sizes_only(spark):
    """A table whose columns are wide is counted by one number a row."""
    wide = spark.range(40, numPartitions=4).selectExpr("id", "repeat(cast(id as string), 10000) as text")
    seen = []

    class Look:
        isStreaming, schema = False, wide.schema

        def select(self, *cols):
            seen.append(len(cols))
            return wide.select(*cols)

    assert fits(Look(), 100, 1 << 30) and not fits(Look(), 100, 1 << 10) and not fits(Look(), 39)
    assert seen == [1, 1, 1]


def test_a_query_makes_its_memory_once(spark, monkeypatch):
    made, tm = [], fx.tm
    monkeypatch.setattr(fx, "tm", lambda *a: made.append(tm(*a)) or made[-1])
    QUERIES["apply_translations_region"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and all("/table-" in p for p in made[0].inputFiles())
