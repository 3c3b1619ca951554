"""Wider forms of personal data are added, however many there are; look-alikes that the rules refused are not."""

import random

from linestream.llm import pii


def card(rng, good):
    d = [rng.randrange(10) for _ in range(15)]
    for last in range(10):
        total = sum(v if i % 2 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) + last
        if (total % 10 == 0) == good:
            v = "".join(map(str, [*d, last]))
            return [v[i : i + 4] for i in range(0, 16, 4)]


def test_wider_forms_are_added_and_look_alikes_are_not(spark):
    rng = random.Random(12)
    num = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    v4 = lambda: ".".join(str(rng.randrange(10, 256)) for _ in range(4))
    v6 = lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8))
    matched = [
        lambda: f"please write mail a{num(3)}@host.example.org today", lambda: f"from a{num(3)}@host.example.org today",
        lambda: f"the server {v4()} is up", lambda: f"then {v4()} is up",
        lambda: f"pay by card {' '.join(card(rng, True))} now", lambda: f"please call +1 ({num(3)}) {num(3)}-{num(4)} now",
        lambda: f"so +1 ({num(3)}) {num(3)}-{num(4)} then",
    ]
    wider = [
        ("email", lambda: f"b{num(3)} [at] host.example.org", "please write mail "), ("email", lambda: f"b{num(3)} @ host.example.org", "hear from "),
        ("ip", v6, "the server "), ("ip", lambda: "2001:db8::" + v6()[:4], "then "),
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}", "please call "), ("card", lambda: ".".join(card(rng, True)), "pay by card "),
    ]
    refused = [
        lambda: f"pay by card {'.'.join(card(rng, False))} now", lambda: f"pay by card {' '.join(card(rng, False))} now",
        lambda: f"the server {v4().rsplit('.', 1)[0]}.{rng.randrange(256, 999)} is up", lambda: f"part {num(3)}-{num(3)}-{num(4)} of it",
        lambda: f"we sold {num(2)} @ {num(2)}.{num(2)} each", lambda: f"at 12:{num(2)}:{num(2)}:{num(2)} sharp",
    ]
    rows, want = [], {}
    for f in matched * 60 + refused * 60:
        rows.append((len(rows), f()))
    plain = len(rows)
    for kind, value, before in wider * 60:
        v = value()
        want[len(rows)] = f"{kind}:{len(before)}:{len(before) + len(v)}"
        rows.append((len(rows), f"{before}{v} today"))
    out = {r["doc_id"]: r["spans"] for r in pii.scan_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] for i in range(len(matched) * 60))
    assert [rows[i] for i in range(len(matched) * 60, plain) if out[i]] == []
    assert [(rows[i][1], out[i], s) for i, s in want.items() if out[i] != s] == []
