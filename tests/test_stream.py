"""Stream results must equal batch results on the same rows."""

import hashlib
import json
import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linestream.operators import events as ev
from linestream.operators import frames as fr
from linestream.plans.replay import replay_live
from linestream.streaming import live, sinks
from linestream.operators.language import language_profile, resolve_sources
from linestream.streaming.events import debounce_stream, spans_stream
from linestream.streaming.live import EVENTS, fresh_responses_stream, live_events, live_translate, shown_lines, source_finder

START = datetime(2024, 1, 1)


def as_stream(spark, batches, schema, path):
    """A stream that gets one micro-batch per given list of rows."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:04d}")
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(str(path))
    )


def run(df, tmp_path, mode="append"):
    """All rows a stream gives."""
    name = "out_" + str(abs(hash(str(tmp_path))))
    q = sinks.live_trigger(
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")), once=True
    ).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def burst_rows(seed=3):
    rnd = random.Random(seed)
    t, out = 0, []
    for i in range(120):
        t += rnd.choice([1, 1, 2, 5, 6, 30])
        out.append((rnd.choice([1, 2]), START + timedelta(seconds=t), i, rnd.random() < 0.1))
    # A last event far ahead moves the watermark past all others.
    return out, [(9, START + timedelta(days=2), 999, False)]


EVENT = "key int, ts timestamp, id int, flush boolean"


@pytest.mark.parametrize("flush", [None, "flush"])
def test_debounce(spark, tmp_path, flush, rows):
    data, end = burst_rows()
    batches = [data[i : i + 30] for i in range(0, 120, 30)] + [end, [(9, START + timedelta(days=4), 1000, False)]]
    s = as_stream(spark, batches, EVENT, tmp_path / "in")
    got = run(debounce_stream(s, "key", "ts", "5 seconds", "0 seconds", ["id"], "id", flush), tmp_path).where("key < 9")
    want = ev.debounce_last(spark.createDataFrame(data, EVENT), "key", ["ts", "id"], "5 seconds", flush)
    assert rows(got, "id") == rows(want, "id")


def test_spans_and_samples(spark, tmp_path, rows):
    data, end = burst_rows(8)
    batches = [data[:50], data[50:], end, [(9, START + timedelta(days=4), 1000, False)]]
    s = as_stream(spark, batches, EVENT, tmp_path / "in")
    batch = spark.createDataFrame(data, EVENT)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    got = run(spans_stream(s, "key", "ts", "5 seconds", "0 seconds"), tmp_path / "a").where("key < 9")
    cols = ["key", "start", "end", "n_events"]
    assert rows(got, *cols) == rows(ev.interaction_spans(batch, "key", ["ts", "id"], "5 seconds"), *cols)
    tick = lambda d: ev.sample_latest(d, "key", "ts", "20 seconds", ["id"], "id")
    got = run(tick(s.withWatermark("ts", "0 seconds")), tmp_path / "b").where("key < 9")
    assert rows(got, "key", "tick", "id") == rows(tick(batch), "key", "tick", "id")


def test_memory_sink_survives_a_repeated_batch(spark, tmp_path, rows):
    schema = "source string, strategy string, target string, text string, translated string, arrival long"
    row = lambda t, v, a: ("fr", "lowLatency", "en", t, v, a)
    batches = [[row("a", "1", 1), row("a", "2", 2), row("b", "x", 9)], [row("b", "y", 1), row("c", None, 1)]]
    s = as_stream(spark, batches, schema, tmp_path / "in")
    put = sinks.tm_sink(str(tmp_path / "tm"))
    writer = s.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck"))
    sinks.live_trigger(writer, once=True).start().awaitTermination(120)
    base = spark.createDataFrame([row("a", "old", 0)[:5], row("z", "keep", 0)[:5]], schema.rsplit(",", 1)[0])
    want = [("a", "2"), ("b", "y"), ("z", "keep")]
    assert rows(sinks.read_tm(spark, str(tmp_path / "tm"), base), "text", "translated") == want
    put(spark.createDataFrame(batches[1], schema), 1)
    assert rows(sinks.read_tm(spark, str(tmp_path / "tm"), base), "text", "translated") == want
    assert rows(sinks.read_tm(spark, str(tmp_path / "tm")), "text", "translated") == want[:2]


@pytest.mark.parametrize("fails_at", [None, "write", "marker", "remove"])
def test_compacted_memory_reads_the_same_after_a_failure_at_any_step(spark, tmp_path, rows, monkeypatch, fails_at):
    schema = "source string, strategy string, target string, text string, translated string, arrival long"
    rnd, path, want = random.Random(5), str(tmp_path / "tm"), {}
    put = sinks.tm_sink(path, 3)
    for batch in range(14):
        said = [("fr", "lowLatency", "en", rnd.choice("abcdef"), f"{batch}:{i}", i) for i in range(3)]
        want.update({r[3]: r[4] for r in said})
        df = spark.createDataFrame(said, schema).coalesce(1)
        if fails_at and batch == 8:
            with monkeypatch.context() as m:
                if fails_at == "remove":
                    m.setattr(sinks, "_remove", lambda *a: 1 / 0)
                else:
                    real = sinks.compact_tm

                    def half(spark, path, upto):
                        real(spark, path, upto)
                        folder = tmp_path / "tm" / f"version={upto}"
                        if fails_at == "write":  # some files are there, the mark of completion is not
                            next(folder.glob("*.parquet")).unlink()
                        (folder / "_SUCCESS").unlink()
                        raise ZeroDivisionError

                    m.setattr(sinks, "compact_tm", half)
                    m.setattr(sinks, "_remove", lambda *a: None)
                with pytest.raises(ZeroDivisionError):
                    put(df, batch)
            assert rows(sinks.read_tm(spark, path), "text", "translated") == sorted(want.items())
            put(df, batch)  # the stream runs the batch again
        else:
            put(df, batch)
        assert rows(sinks.read_tm(spark, path), "text", "translated") == sorted(want.items())
    put(spark.createDataFrame([("fr", "lowLatency", "en", "a", "late", 1)], schema), 2)  # a batch that a version holds already
    assert rows(sinks.read_tm(spark, path), "text", "translated") == sorted(want.items())
    left = sorted(p.name for p in (tmp_path / "tm").iterdir())
    assert [p for p in left if p.startswith("version")] == ["version=11", "version=8"]
    assert {p for p in left if p.startswith("batch")} == {"batch=10", "batch=11", "batch=12", "batch=13", "batch=2", "batch=9"}


def test_region_sink(spark, tmp_path, rows):
    schema = "user int, ts long, x double"
    s = as_stream(spark, [[(1, 1, 1.0), (1, 3, 3.0), (2, 1, 5.0)], [(1, 2, 2.0)]], schema, tmp_path / "in")
    put = sinks.region_sink(str(tmp_path / "r"), "user", ["ts"], ["x"])
    sinks.live_trigger(s.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")), once=True).start().awaitTermination(120)
    # The last to be placed wins, as batches arrive in order.
    assert rows(sinks.read_regions(spark, str(tmp_path / "r"), "user", ["ts"], ["x"])) == [(1, 2.0), (2, 5.0)]


def test_sources_sink(spark, tmp_path, rows):
    schema = "session_id string, frame_seq long, line_no int, text string"
    s = as_stream(spark, [[("s", 1, 0, " le "), ("s", 1, 1, " ")], [("s", 2, 0, "x")]], schema, tmp_path / "in")
    put = sinks.sources_sink(str(tmp_path / "o"), "fr")
    sinks.live_trigger(s.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")), once=True).start().awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "o")), "frame_seq", "text", "source") == [(1, "le", "fr"), (2, "x", "fr")]


FRAME_COLS = "session_id string, frame_seq long, ts timestamp, status string, lines array<struct<line_no:int,text:string,source:string>>"
ANSWER_COLS = "session_id string, frame_seq long, line_no int, answer string, ts timestamp, arrival long"
CONTROL_COLS = "session_id string, ts timestamp, no long, kind string"
CUTS = [0, 5_000, 5_500, 12_000, 20_000, 99_999]


def at(ms):
    return START + timedelta(milliseconds=ms)


def live_rows(seed):
    """Captures, answers and control events of two sessions; many at the same moments."""
    rnd = random.Random(seed)
    frames, answers = [], []
    for s in ("a", "b"):
        for f in range(1, 31):
            texts = [(n, rnd.choice([" p", "q", "r", "r ", "\u3000"]), rnd.choice(["fr", "fr", "en", "de"])) for n in range(rnd.randrange(0, 5))]
            frames.append((s, f, at(800 * f), rnd.choice(["ok"] * 8 + ["error", "permission"]), texts))
            for n, text, src in texts:
                if src != "en" and text.strip() and rnd.random() < 0.5:
                    answers.append((s, f, n, f"{text.strip()}{len(answers)}", at(800 * f + rnd.choice([-50, 0, 100, 300, 700, 799, 800, 1200])), len(answers)))
    kinds = ["place", "place", "dismiss", "toggle_overlay", "toggle_live", "toggle_live", "set_live_on", "set_live_off"]
    control = [(s, at(0), -1, "place") for s in ("a", "b")]
    control += [(rnd.choice("ab"), at(rnd.randrange(1, 30) * 800 + rnd.choice([0, 100, 400])), i, rnd.choice(kinds)) for i in range(16)]
    return frames, answers, control


def live_stream(spark, rows, path):
    frames, answers, control = rows
    table = live_events(spark.createDataFrame(frames, FRAME_COLS), spark.createDataFrame(answers, ANSWER_COLS), spark.createDataFrame(control, CONTROL_COLS))
    assert table.schema.simpleString().replace("bigint", "long")[7:-1] == EVENTS.replace(", ", ",").replace(" ", ":")
    told = [tuple(r) for r in table.collect()]
    return as_stream(spark, [[r for r in told if at(a) <= r[1] < at(b)] for a, b in zip(CUTS, CUTS[1:])], table.schema, path)


@pytest.mark.parametrize("seed", [4, 5])
def test_stale_answers(spark, tmp_path, rows, seed):
    frames, answers, control = given = live_rows(seed)
    got = run(fresh_responses_stream(live_stream(spark, given, tmp_path / "in")), tmp_path)
    batch = fr.drop_stale_responses(
        spark.createDataFrame(answers, ANSWER_COLS), spark.createDataFrame(frames, FRAME_COLS), control=spark.createDataFrame(control, CONTROL_COLS)
    )
    cols = ["session_id", "frame_seq", "line_no", "answer", "ts"]
    assert rows(got, *cols) == rows(batch, *cols) and 0 < batch.count() < len(answers)


@pytest.mark.parametrize("seed,configured", [(6, None), (7, None), (8, "fr-FR"), (9, "auto")])
def test_live_translate_equals_replay(spark, tmp_path, seed, configured):
    frames, answers, control = given = live_rows(seed)
    memory = spark.createDataFrame([("fr-Latn-FR", "lowLatency", "en", "p", "P")], "source string, strategy string, target string, text string, translated string")
    profile = None
    if configured == "auto":
        profile = language_profile(spark.createDataFrame([("p q r", "fr"), ("q", "en"), ("r\np", "de")], "text string, lang string"))
    out = run(live_translate(live_stream(spark, given, tmp_path / "in"), memory, "en", "lowLatency", configured, profile), tmp_path)
    got = {tuple(r[:3]): (r["line_id"], r["translated"], r["seq"]) for r in shown_lines(out).collect()}
    lines = [(s, f, *t) for s, f, _, _, texts in frames for t in texts]
    batch = replay_live(
        spark.createDataFrame([f[:4] for f in frames], FRAME_COLS.split(", lines")[0]),
        spark.createDataFrame(lines, "session_id string, frame_seq long, line_no int, text string, source string"),
        memory,
        spark.createDataFrame(answers, ANSWER_COLS),
        configured=configured,
        profile=profile,
        cache="session",
        control=spark.createDataFrame(control, CONTROL_COLS),
    )
    want = {(r["session_id"], r["frame_seq"], r["line_no"]): (r["line_id"], r["translated"], r["seq"]) for r in batch.collect()}
    assert got == want
    assert want and (configured == "auto" or any(v[1] is None for v in want.values()) and any(v[1] for v in want.values()))


def test_sources_of_a_frame(spark):
    labelled = spark.createDataFrame([("the cat sat on", "en"), ("le chat est la", "fr"), ("der Hund ist da", "de")], "text string, lang string")
    profile = language_profile(labelled)
    lines = [("s", 1, 0, "the cat"), ("s", 1, 1, "x"), ("s", 1, 2, "le"), ("s", 2, 0, "zz"), ("s", 3, 0, "Hund"), ("s", 3, 1, "ca"), ("s", 4, 0, "at")]
    df = spark.createDataFrame(lines, "session_id string, frame_seq long, line_no int, text string")
    want = {tuple(r[:3]): r["source"] for r in resolve_sources(df, "auto", profile).collect()}
    frames = df.groupBy("session_id", "frame_seq").agg(F.array_sort(F.collect_list(F.struct("line_no", F.lower("text").alias("t")))).alias("x"))
    found = frames.select("session_id", "frame_seq", "x", source_finder(profile)(F.transform("x", lambda r: r["t"])).alias("s")).collect()
    assert {(r[0], r[1], x["line_no"]): s for r in found for x, s in zip(r["x"], r["s"], strict=True)} == want


def test_idle_texts_are_forgotten(spark, tmp_path):
    """The answer of a text that was not shown for a while does not serve its next frame."""
    one = [(0, "t", "fr")]
    frames = [("s", f, at(1000 * f), "ok", one if f != 2 else []) for f in (1, 2, 3)]
    answers, control = [("s", 1, 0, "T", at(1100), 1)], [("s", at(0), 0, "place")]
    table = live_events(spark.createDataFrame(frames, FRAME_COLS), spark.createDataFrame(answers, ANSWER_COLS), spark.createDataFrame(control, CONTROL_COLS))
    told = [tuple(r) for r in table.collect()]
    memory = spark.createDataFrame([], "source string, strategy string, target string, text string, translated string")
    for idle, last in ((3_600_000, "T"), (1, None)):
        name, folder = f"idle_{idle}", tmp_path / str(idle)
        stream = as_stream(spark, [[r for r in told if r[1] < at(2500)]], table.schema, folder / "in")
        out = live_translate(stream, memory, "en", "lowLatency", idle_ms=idle)
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "ck")).trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(300):
                if spark.table(name).where("translated is not null").count():
                    break
                time.sleep(0.1)
            time.sleep(0.3)
            spark.createDataFrame([r for r in told if r[1] >= at(2500)], table.schema).coalesce(1).write.parquet(f"{folder}/in/9999")
            for _ in range(300):
                got = {r["frame_seq"]: r["translated"] for r in shown_lines(spark.table(name)).collect()}
                if 3 in got:
                    break
                time.sleep(0.1)
        finally:
            q.stop()
        assert got == {1: "T", 3: last}


def test_cadence(spark, tmp_path):
    s = as_stream(spark, [[(1,)]], "x int", tmp_path / "in")
    q = sinks.live_trigger(s.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")), 0.3).start()
    q.processAllAvailable()
    assert q.isActive
    q.stop()


@pytest.mark.parametrize("name", ["fresh_responses_stream", "interaction_stream"])
def test_stream_queries_on_a_session_with_the_default_state_store(spark, name):
    """Whoever runs the queries need not set the state store; the session's own setting comes back."""
    from checks.registry import QUERIES
    from linestream.streaming.state import PROVIDER, ROCKSDB

    spark.conf.unset(PROVIDER)
    default = spark.conf.get(PROVIDER)
    if default == ROCKSDB:  # set when the session was made, as the tests do
        default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
        spark.conf.set(PROVIDER, default)
    try:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert spark.conf.get(PROVIDER) == default
    finally:
        spark.conf.set(PROVIDER, ROCKSDB)


class Kept:
    """State of one key, as a fold sees it; counts how often it is asked for or written."""

    calls = 0

    def __init__(self):
        self.value = {}

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        Kept.calls += 1
        return self.value.get(key)

    def updateValue(self, key, value):
        Kept.calls += 1
        self.value[key] = value


def test_many_texts_of_a_session_share_their_state(monkeypatch):
    """A read and a write of state for each text took most of the time; pages are dealt anew as texts grow, and none is lost."""
    fold, said = live.LiveFold(), {}
    fold.size, fold.pages = Kept(), Kept()
    monkeypatch.setattr(Kept, "calls", 0)

    def frame(seq, texts):
        known = [("s", "ab", d, 0, 800 * seq, seq, seq, i, 0, 0, "fr-Latn-FR", None) for i, d in enumerate(texts)]
        shown = [("s", "ab", d, 1, 800 * seq, seq, seq, i, 1, seq, None, None) for i, d in enumerate(texts)]
        answers = [("s", "ab", d, 2, 800 * seq + 1, i, seq, i, 1, seq, None, f"{seq}:{i}") for i, d in enumerate(texts) if i % 2]
        rows = pd.DataFrame(answers + shown + known, columns=live._TOLD.split(", "))
        for out in fold.handleInputRows(("s", "ab"), iter([rows.iloc[::2], rows.iloc[1::2]]), None):
            for r in out.itertuples():
                said[r.seq, r.line_no] = (r.line_id, r.translated)

    texts = ["ab" + hashlib.md5(str(i).encode()).hexdigest()[2:] for i in range(3000)]
    frame(1, texts[:100])
    frame(2, texts)
    assert Kept.calls < 3000 / 5
    before = Kept.calls
    frame(3, texts[:40])
    assert Kept.calls - before <= 2 * 40 + 2
    frame(5, texts[-10:])
    # Shown in the frame before: the same line, and the value carried; after a gap a new line, but the session's answer.
    assert said[2, 99] == (f"s:1:1:1:{texts[99]}", "1:99") and said[2, 98] == (f"s:1:1:1:{texts[98]}", None)
    assert said[3, 7] == (f"s:1:1:1:{texts[7]}", "1:7") and said[3, 8][1] is None and said[2, 2999][1] == "2:2999"
    assert said[5, 3] == (f"s:1:5:1:{texts[-7]}", "2:2993") and said[5, 2] == (f"s:1:5:1:{texts[-8]}", None)
    kept = [d for page in fold.pages.value.values() for d in json.loads(page[0])]
    assert sorted(kept) == sorted(texts) and fold.size.get() == (6, 3000)


def test_no_text_passes_the_fold_of_a_session(spark):
    frames = [("s", 1, at(800), "ok", [(0, " a long text ", "fr"), (None, "b", "fr"), (-5, "c", "fr")])]
    answers, control = [("s", 1, 0, "A", at(900), 1)], [("s", at(0), 0, "place")]
    table = live_events(spark.createDataFrame(frames, FRAME_COLS), spark.createDataFrame(answers, ANSWER_COLS), spark.createDataFrame(control, CONTROL_COLS))
    rows = live._light(table, live._cleaned(F.col("lines"))).toPandas()
    assert "text" not in str(rows.to_dict()) and sum(len(x) for x in rows["lines"] if x is not None) == 3 * 20
    fold = live.SessionFold()
    fold.state = Kept()
    out = pd.concat(list(fold.handleInputRows(("s",), iter([rows]), None)))
    assert [len(x) for x in out["lines"]] == [60, 20] and list(out["answer"]) == [None, "A"]
