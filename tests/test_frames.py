"""Frame operators against a literal replay in plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linestream.operators import frames as fr
from linestream.plans.replay import replay_live

FRAMES = "session_id string, frame_seq long, epoch int, ts long, status string"
LINES = "session_id string, frame_seq long, line_no int, text string, source string"


def make(seed, sessions=3, n_frames=40):
    """Random frames with few texts, so that they repeat in and across frames."""
    rnd = random.Random(seed)
    frames, lines = [], []
    for s in range(sessions):
        epoch = 0
        for f in range(1, n_frames + 1):
            epoch += rnd.random() < 0.1
            status = rnd.choice(["ok"] * 6 + ["error", "permission"])
            frames.append((f"s{s}", f, epoch, f * 800, status))
            if rnd.random() < 0.15:
                continue  # a frame without lines
            for n in range(rnd.randrange(1, 6)):
                lines.append((f"s{s}", f, n, rnd.choice("aabbcd"), rnd.choice(["fr", "fr", "en"])))
    return frames, lines


def good(frames):
    """Good frames of each session in order."""
    out = defaultdict(list)
    for f in sorted(frames):
        if f[4] == "ok":
            out[f[0]].append(f)
    return out


def literal(frames, lines, tm=None, answers=None, cache=None, control=None):
    """Event by event, as the live overlay does it; a line's identity and final value in each frame.

    Without ``control`` the frames' own epochs clear the lines.
    """
    by_frame = defaultdict(list)
    for line in sorted(lines):
        by_frame[line[:2]].append(line)
    events = [(f[3], 1, f[0], f[1], f) for f in frames]
    events += [(c[1], 0, c[0], c[2], c) for c in control or []]
    events += [(a[4], 2, a[5], a[3], *a[:3], a) for a in answers or []]
    state = defaultdict(lambda: {"active": control is None, "live": control is None, "shown": [], "frame": None, "epoch": None})
    out, serial, memory = {}, 0, {}
    for e in sorted(events, key=lambda e: (e[0], e[1], *map(repr, e[2:3]), e[2:-1])):
        rank, row = e[1], e[-1]
        s = state[row[0]]
        if rank == 0:
            kind = row[3]
            if kind == "toggle_overlay":
                kind = "dismiss" if s["active"] else "place"
            if kind == "toggle_live":
                if not s["active"]:
                    continue
                kind = "set_live_off" if s["live"] else "set_live_on"
            if kind == "set_live_on" and not s["active"]:
                s["live"] = False
                continue
            if kind in ("place", "dismiss"):
                s["active"] = kind == "place"
            s["live"] = kind in ("place", "set_live_on")
            s["shown"], s["frame"] = [], None  # what is in flight is cancelled
        elif rank == 1:
            if control is not None and not s["live"]:
                continue
            if row[4] != "ok":
                if row[4] == "permission" and control is not None:
                    s["live"] = False
                continue
            buckets = defaultdict(list)
            if control is not None or row[2] == s["epoch"]:
                for old in s["shown"]:
                    buckets[old["text"]].append(old)
            s["epoch"], s["frame"], s["shown"] = row[2], row[1], []
            for line in by_frame[row[:2]]:
                text, source = line[3], line[4]
                key = (source, text) if cache == "app" else (row[0], source, text)
                known = text if source == "en" else (tm or {}).get((source, text))
                if known is None and cache:
                    known = memory.get(key)
                if buckets[text]:
                    now = dict(buckets[text].pop(0))
                else:
                    serial += 1
                    now = {"id": serial, "text": text, "value": None}
                if known is not None:
                    now["value"] = known
                now |= {"no": line[2], "key": key, "asked": now["value"] is None}
                s["shown"].append(now)
        elif s["frame"] == row[1]:
            for now in s["shown"]:
                if now["no"] == row[2] and now["asked"]:
                    memory[now["key"]] = now["value"] = row[3]
        if rank and s["frame"] == row[1]:
            for now in s["shown"]:
                out[(row[0], row[1], now["no"])] = (now["id"], now["value"])
    return out


def same_partition(got: dict, want: dict):
    """Equal up to the names of the identities."""
    assert got.keys() == want.keys()
    names, back = {}, {}
    for k in want:
        assert names.setdefault(want[k], got[k]) == got[k]
        assert back.setdefault(got[k], want[k]) == want[k]


@pytest.mark.parametrize("seed,hot", [(1, None), (2, None), (3, 10), (4, 4)])
def test_identity_equals_literal_replay(spark, seed, hot):
    frames, lines = make(seed)
    got = fr.line_identity(spark.createDataFrame(lines, LINES), spark.createDataFrame(frames, FRAMES), hot).collect()
    want = {k: v[0] for k, v in literal(frames, lines).items()}
    same_partition({(r["session_id"], r["frame_seq"], r["line_no"]): r["line_id"] for r in got}, want)
    per_frame = [(r["session_id"], r["frame_seq"], r["line_id"]) for r in got]
    assert len(per_frame) == len(set(per_frame))


MEMORY = [
    ("fr-Latn-FR", "lowLatency", "en", "a", "A"), ("fr-Latn-FR", "lowLatency", "en-US", "b", "x"), ("fr", "lowLatency", "en", "c", "x"),
    ("fr-Latn-FR", "highFidelity", "en", "d", "x"),
]
KINDS = ["place", "dismiss", "toggle_overlay", "toggle_live", "set_live_on", "set_live_off"]


def users(rnd, sessions, n_frames):
    """Control events around the frames; some at the very time of a frame or an answer."""
    out = [(f"s{s}", rnd.choice([0, 700, 800]), -1, "place") for s in range(sessions)]
    for i in range(sessions * n_frames // 5):
        kind = rnd.choice(KINDS + ["place", "toggle_live", "set_live_on"])
        out.append((f"s{rnd.randrange(sessions)}", rnd.randrange(1, n_frames) * 800 + rnd.choice([0, 0, 100, 399, 700]), i, kind))
    return out


@pytest.mark.parametrize("cache", ["app", "session", None])
@pytest.mark.parametrize("seed,hot,controlled", [(5, None, False), (6, 5, True), (7, None, True), (8, 5, False), (9, None, True)])
def test_replay_equals_literal_replay(spark, seed, hot, cache, controlled):
    rnd = random.Random(seed)
    frames, lines = make(seed)
    # Sources of a text change from frame to frame, so that values are carried over into another key.
    lines = [(*x[:4], rnd.choice(["fr", "fr", "de", "en"])) if x[3] in "bc" else x for x in lines]
    answers = [
        (*line[:3], f"{line[3]}{i}", line[1] * 800 + rnd.choice([-50, 0, 100, 399, 500, 799, 800, 1600]), i)
        for i, line in enumerate(lines)
        if line[4] != "en" and rnd.random() < 0.5
    ]
    control = users(rnd, 3, 40) if controlled else None
    said = "session_id string, frame_seq long, line_no int, answer string, ts long, arrival int"
    got = replay_live(
        spark.createDataFrame(frames, FRAMES),
        spark.createDataFrame(lines, LINES),
        spark.createDataFrame(MEMORY, "source string, strategy string, target string, text string, translated string"),
        spark.createDataFrame(answers, said),
        configured=None,
        cache=cache,
        hot_rows=hot,
        control=control and spark.createDataFrame(control, "session_id string, ts long, no int, kind string"),
    ).collect()
    want = literal(frames, lines, {("fr", "a"): "A"}, answers, cache, control)
    assert {(r["session_id"], r["frame_seq"], r["line_no"]): r["translated"] for r in got} == {k: v[1] for k, v in want.items()}
    same_partition({(r["session_id"], r["frame_seq"], r["line_no"]): r["line_id"] for r in got}, {k: v[0] for k, v in want.items()})
    assert any(v is None for _, v in want.values()) and any(v and v[-1].isdigit() for _, v in want.values())


LIVE = "session_id string, ts long, no int, kind string"
ANSWERS = "session_id string, frame_seq long, line_no int, answer string, ts long, arrival int"


def shown(spark, frames, lines, answers, control, **kw):
    memory = spark.createDataFrame([], "source string, strategy string, target string, text string, translated string")
    out = replay_live(
        spark.createDataFrame(frames, FRAMES), spark.createDataFrame(lines, LINES), memory, spark.createDataFrame(answers, ANSWERS),
        configured=None, control=spark.createDataFrame(control, LIVE), **kw,
    )
    return {(r["session_id"], r["frame_seq"]): (r["line_id"], r["translated"]) for r in out.collect()}


def test_pause_ends_identity_and_answers(spark):
    frames = [("s", i, 0, i * 100, "ok") for i in (1, 2, 3)]
    lines = [("s", i, 0, "t", "fr") for i in (1, 2, 3)]
    control = [("s", 0, 0, "place"), ("s", 110, 1, "set_live_off"), ("s", 120, 2, "toggle_live"), ("s", 250, 3, "set_live_on")]
    got = shown(spark, frames, lines, [("s", 1, 0, "late", 130, 1), ("s", 2, 0, "in time", 240, 2)], control)
    assert len({i for i, _ in got.values()}) == 3
    assert [v for _, v in sorted(got.items())] and [got["s", i][1] for i in (1, 2, 3)] == [None, "in time", "in time"]


def test_dismiss_ends_identity_and_answers_and_hides_frames(spark):
    frames = [("s", i, 0, i * 100, "ok") for i in (1, 2, 3)]
    lines = [("s", i, 0, "t", "fr") for i in (1, 2, 3)]
    control = [("s", 0, 0, "place"), ("s", 110, 1, "dismiss"), ("s", 250, 2, "toggle_overlay")]
    got = shown(spark, frames, lines, [("s", 1, 0, "late", 130, 1), ("s", 2, 0, "never shown", 210, 2)], control)
    assert got.keys() == {("s", 1), ("s", 3)} and {v for _, v in got.values()} == {None}


def test_permission_failure_stops_live_but_not_what_is_in_flight(spark, rows):
    frames = [("s", 1, 0, 100, "ok"), ("s", 2, 0, 200, "permission"), ("s", 3, 0, 300, "ok"), ("s", 4, 0, 400, "ok"), ("s", 5, 0, 500, "permission")]
    lines = [("s", i, 0, "t", "fr") for i in (1, 3, 4)]
    control = [("s", 0, 0, "place"), ("s", 350, 1, "toggle_live")]
    got = shown(spark, frames, lines, [("s", 1, 0, "yes", 310, 1)], control, cache=None)
    assert {k: v for k, (_, v) in got.items()} == {("s", 1): "yes", ("s", 4): None} and len(set(got.values())) == 2
    out = fr.live_epochs(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(control, LIVE))
    assert rows(out, "frame_seq", "epoch", "route", "fatal") == [
        (1, 1, "pipeline", False), (2, 1, "dead_letter", True), (3, 1, "ignored", False), (4, 2, "pipeline", False), (5, 2, "dead_letter", True),
    ]


def test_answers_serve_other_sessions_later_frames(spark):
    frames = [("s", 1, 0, 100, "ok"), ("q", 1, 0, 150, "ok"), ("q", 2, 0, 160, "ok")]
    lines = [("s", 1, 0, "t", "fr"), ("q", 1, 0, "t", "fr"), ("q", 2, 0, "t", "fr")]
    control = [("s", 0, 0, "place"), ("q", 0, 0, "place")]
    answers = [("s", 1, 0, "S", 150, 1), ("q", 2, 0, "not asked", 165, 2)]
    values = lambda **kw: {k: v for k, (_, v) in shown(spark, frames, lines, answers, control, **kw).items()}
    assert values() == {("s", 1): "S", ("q", 1): None, ("q", 2): "S"}
    assert values(cache="session") == values(cache=None) == {("s", 1): "S", ("q", 1): None, ("q", 2): "not asked"}


def test_diff_adds_up(spark):
    frames, lines = make(9)
    f, d = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(lines, LINES)
    diff = fr.frame_diff(d, f)
    n_ok = d.join(f.where("status = 'ok'"), ["session_id", "frame_seq"]).count()
    kinds = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    assert kinds["kept"] + kinds["added"] == n_ok
    ident = fr.line_identity(d, f)
    starts = ident.where("seq = first_seq").count()
    assert kinds["added"] == starts


def test_empty_good_frame_breaks_identity_but_failed_frame_does_not(spark):
    frames = [("s", i, 0, i, st) for i, st in enumerate(["ok", "error", "ok", "ok", "ok"])]
    lines = [("s", 0, 0, "t", "fr"), ("s", 1, 0, "t", "fr"), ("s", 2, 0, "t", "fr"), ("s", 4, 0, "t", "fr")]
    got = fr.line_identity(spark.createDataFrame(lines, LINES), spark.createDataFrame(frames, FRAMES))
    ids = {r["frame_seq"]: r["line_id"] for r in got.collect()}
    assert ids[0] == ids[2] != ids[4] and 1 not in ids


def test_live_start_breaks_identity(spark):
    frames = [("s", 0, 0, 0, "ok"), ("s", 1, 1, 1, "ok")]
    lines = [("s", 0, 0, "t", "fr"), ("s", 1, 0, "t", "fr")]
    got = fr.line_identity(spark.createDataFrame(lines, LINES), spark.createDataFrame(frames, FRAMES))
    assert got.select("line_id").distinct().count() == 2
    diff = fr.frame_diff(spark.createDataFrame(lines, LINES), spark.createDataFrame(frames, FRAMES))
    assert [r["change"] for r in diff.collect()] == ["added", "added"]


def test_carry_key_stops_old_targets(spark):
    cols = "session_id string, epoch int, text string, k int, seq long, first_seq long, line_id string, target string, value string"
    df = spark.createDataFrame(
        [("s", 0, "t", 1, 1, 1, "i", "en", "E"), ("s", 0, "t", 1, 2, 1, "i", "de", None), ("s", 0, "t", 1, 3, 3, "j", "de", None)], cols
    )
    get = lambda **kw: [r["translated"] for r in fr.carry_forward(df, **kw).orderBy("seq").collect()]
    assert get() == ["E", "E", None]
    assert get(carry_key=["target"]) == ["E", None, None]


def test_stale_answers(spark, rows):
    frames = spark.createDataFrame([("s", 1, 0, 100, "ok"), ("s", 2, 0, 150, "error"), ("s", 3, 0, 200, "ok")], FRAMES)
    ans = spark.createDataFrame(
        [("s", 1, 99), ("s", 1, 100), ("s", 1, 199), ("s", 1, 200), ("s", 2, 160), ("s", 3, 9999), ("q", 1, 100)],
        "session_id string, frame_seq long, ts long",
    )
    assert rows(fr.drop_stale_responses(ans, frames), "frame_seq", "ts") == [(1, 100), (1, 199), (3, 9999)]


def test_routes(spark, rows):
    f = spark.createDataFrame([("s", 1, 0, 1, "ok"), ("s", 2, 0, 2, "error"), ("s", 3, 0, 3, "permission"), ("s", 4, 0, 4, None)], FRAMES)
    assert rows(fr.route_errors(f), "frame_seq", "route", "fatal") == [
        (1, "pipeline", False), (2, "dead_letter", False), (3, "dead_letter", True), (4, "dead_letter", False),
    ]


def test_status(spark):
    df = spark.createDataFrame(
        [("s", 1, True, False, "a"), ("s", 1, False, True, "b"), ("s", 1, False, False, None), ("s", 2, True, False, "x")],
        "session_id string, frame_seq long, same_language boolean, cache_hit boolean, translated string",
    )
    one, two = fr.frame_status(df).orderBy("frame_seq").collect()
    assert tuple(one)[2:] == (3, 1, 1, 1, True)
    assert tuple(two)[2:] == (1, 1, 0, 0, False)


def test_scans_over_what_lines_show_do_not_move_texts(spark):
    """Identities are followed by the digest of their text; what does not ask for the text does not read it again."""
    frames = [("s", i, 0, i * 100, "ok") for i in (1, 2, 3)]
    lines = [("s", i, 0, "t", "fr") for i in (1, 2, 3)]
    got = replay_live(
        spark.createDataFrame(frames, FRAMES), spark.createDataFrame(lines, LINES),
        spark.createDataFrame([], "source string, strategy string, target string, text string, translated string"),
        spark.createDataFrame([("s", 1, 0, "S", 150, 1)], "session_id string, frame_seq long, line_no int, answer string, ts long, arrival long"),
        configured=None,
    )
    assert [r["text"] for r in got.collect()] == ["t"] * 3
    plan = got.select("session_id", "frame_seq", "translated")._jdf.queryExecution().optimizedPlan().toString()
    moved = [x for x in plan.splitlines() if "Relation [" not in x]
    assert any("text_key#" in x for x in moved) and not any(" text#" in x or "[text#" in x for x in moved)
