import random
from datetime import datetime, timedelta

import pytest

from linestream.operators import events as ev

KINDS = "place dismiss toggle_overlay toggle_live set_live_on set_live_off permission_error translation_failed answer good_frame capture_failed".split()


@pytest.fixture(scope="module")
def control(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["hot", "hot", "u", "v"]), i // 2, i, rnd.choice(KINDS), f"m{i}") for i in range(600)]
    return spark.createDataFrame(data, "user string, ts long, id long, kind string, message string").repartition(4), data


def fold(data):
    states, out = {}, {}
    for user, _, i, kind, msg in data:
        active, live, bad, err = states.get(user, (0, 0, 0, None))
        if kind == "toggle_overlay":
            kind = "dismiss" if active else "place"
        if kind == "toggle_live":
            kind = None if not active else "set_live_off" if live else "set_live_on"
        if kind == "place":
            active, live, bad = 1, 1, 0
        elif kind == "dismiss":
            active, live, bad, err = 0, 0, 0, None
        elif kind == "set_live_on":
            live, bad = (1, 0) if active else (0, bad)
        elif kind == "set_live_off":
            live, bad = 0, 0
        elif kind == "permission_error":
            live, err = 0, msg
        elif kind == "translation_failed":
            bad, err = 1, msg
        elif kind == "answer":
            bad = 0
        elif kind == "good_frame":
            err = None
        elif kind == "capture_failed":
            err = msg
        states[user] = (active, live, bad, err)
        out[i] = states[user]
    return out


@pytest.mark.parametrize("hot", [None, 40, 7])
def test_state_and_status_equal_a_fold(control, hot):
    df, data = control
    want = fold(data)
    got = ev.session_state(df, "user", ["ts", "id"], hot_rows=hot).collect()
    assert {r["id"]: (r["active"], r["live"]) for r in got} == {i: s[:2] for i, s in want.items()}
    got = ev.availability_status(df, "user", ["ts", "id"], hot_rows=hot).collect()
    assert {r["id"]: (r["unavailable"], r["last_error"]) for r in got} == {i: s[2:] for i, s in want.items()}


def at(*seconds):
    return [(1, datetime(2024, 1, 1) + timedelta(seconds=s), i, f"v{i}") for i, s in enumerate(seconds)]


SCHEMA = "key int, ts timestamp_ntz, id int, v string"


@pytest.mark.parametrize("hot", [None, 2])
def test_events_exactly_a_gap_apart_are_one_burst(spark, hot):
    df = spark.createDataFrame(at(0, 5, 10, 15.001, 40), SCHEMA)
    kept = ev.debounce_last(df, "key", ["ts", "id"], "5 seconds", hot_rows=hot)
    assert sorted(r["id"] for r in kept.collect()) == [2, 3, 4]
    spans = ev.interaction_spans(df, "key", ["ts", "id"], "5 seconds", hot_rows=hot).orderBy("start").collect()
    assert [(r["n_events"], (r["end"] - r["start"]).total_seconds()) for r in spans] == [(3, 15.0), (1, 5.0), (1, 5.0)]


def literal_spans(rows, gap=5):
    """By the rules of the window: activity starts a timer, begin stops it, end closes at once."""
    out = []
    for key in {r[0] for r in rows}:
        start, until, n = None, None, 0  # until: None while open without a timer
        for _, t, _, kind in sorted(r for r in rows if r[0] == key):
            if start is not None and until is not None and t > until:
                out.append((key, start, until, n))
                start = None
            if kind == "end":
                if start is not None:
                    out.append((key, start, t, n))
                start = None
                continue
            if start is None:
                start, n = t, 0
            n, until = n + 1, None if kind == "begin" else t + gap
        if start is not None:
            out.append((key, start, until, n))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,hot", [(1, None), (2, 3), (3, 10)])
def test_begin_and_end(spark, seed, hot):
    import random
    from datetime import datetime, timedelta

    rnd, t, data = random.Random(seed), 0, []
    for i in range(150):
        t += rnd.choice([0, 1, 2, 5, 6, 20])
        data.append((rnd.choice([1, 2]), t, i, rnd.choice(["begin", "end", "move", "move", "scroll", None])))
    zero = datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, zero + timedelta(seconds=s), i, v) for k, s, i, v in data], "key int, ts timestamp_ntz, id int, kind string")
    got = ev.interaction_spans(df, "key", ["ts", "id"], "5 seconds", hot_rows=hot, kind="kind").collect()
    seconds = lambda x: None if x is None else int((x - zero).total_seconds())
    assert sorted(((r["key"], seconds(r["start"]), seconds(r["end"]), r["n_events"]) for r in got), key=repr) == literal_spans(data)


def test_flush_emits_at_once_and_cancels_the_pending_one(spark):
    df = spark.createDataFrame(at(0, 1, 2, 9), SCHEMA).selectExpr("*", "id = 1 as flush")
    kept = ev.debounce_last(df, "key", ["ts", "id"], "5 seconds", "flush")
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3]


@pytest.mark.parametrize("hot", [None, 2])
def test_changes_only(spark, hot):
    vals = [None, None, "a", "a", None, None, "b", "b", "a"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "key int, ts int, v string")
    got = ev.changes_only(df, "key", ["ts"], "v", hot_rows=hot)
    assert [(r["ts"], r["v"]) for r in got.orderBy("ts").collect()] == [(2, "a"), (4, None), (6, "b"), (8, "a")]


def test_latest_and_sample(spark, rows):
    df = spark.createDataFrame(at(0, 30, 61, 61, 200), SCHEMA)
    assert rows(ev.latest_region(df, "key", ["ts", "id"], ["v"])) == [(1, "v4")]
    assert rows(ev.sample_latest(df, "key", "ts", "1 minute", ["v"], "id"), "v") == [("v1",), ("v3",), ("v4",)]
