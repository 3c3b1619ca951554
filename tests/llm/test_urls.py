from collections import Counter, defaultdict

from linestream.llm import urls as u
from linestream.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string, host string, rule int"


def judge(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    return u.filter_urls(df, URL_RULES).collect()


def test_rules_and_odd_urls(spark):
    cases = {
        "http://a.example.net/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.example.net/fr/x": ("a.example.net", "/fr/x", "net/", "block"),
        "HTTP://Net/": ("net", "/", "net/", "block"),
        "http://planet/": ("planet", "/", None, "allow"),
        "http://x.net": ("x.net", "", None, None),
        "http://x.net?a=/b": ("x.net", "", None, None),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://myexample.com/de/": ("myexample.com", "/de/", None, None),
        "ftp://Q.ORG/fr/1#x://y/z": ("q.org", "/fr/1", "org/fr/", "allow"),
        "x.org/fr/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a\nb://h\u00c9.org/p\nq?x": ("h\u00c9.org", "/p\nq", None, None),
        "://": ("", "", None, "allow"),
    }
    rows = [(i, url, None if i % 2 else "") for i, url in enumerate(cases)]
    rows += [(None, "http://planet/", "x"), (1, "http://a.example.net/fr/x", "")]
    out = judge(spark, rows)
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = by[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
    assert u.filter_urls(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_masses_equal_a_plain_walk(spark):
    def page(i, host, path, links):
        return (i, f"http://{host}{path}", " ".join(f'<a HREF = "//{h}/x">' for h in links))

    rows = [page(i, f"s{i % 7}.spam.net", "/x", ["hub.example.com", f"s{i % 3}.spam.net"]) for i in range(40)]
    rows += [page(100 + i, f"g{i % 5}.org", "/fr/1", [f"g{(i + 1) % 5}.org", "good.example.com"]) for i in range(20)]
    rows += [page(200, "link.example.com", "/a", ["s1.spam.net", "s2.spam.net"]), page(201, "good.example.com", "/a", []), page(202, "hub.example.com", "/a", [])]
    edges, tally = set(), defaultdict(Counter)
    for _, url, html in rows:
        host, path = url[7:].split("/", 1)
        for h in html.split('"//')[1:]:
            edges.add((host, h.split("/")[0]))
        tally[host]["n"] += 1
        tally[host]["b"] += host.endswith(".net")
        tally[host]["a"] += host.endswith(".org") and path.startswith("fr/")
    for h in [*tally, *[b for _, b in edges]]:
        parts = h.split(".")
        for i in range(len(parts) - 2):
            edges.add((".".join(parts[i:]), ".".join(parts[i + 1 :])))
    edges = {(a, b) for a, b in edges if a != b}
    bad = [h for h, t in tally.items() if 2 * t["b"] > t["n"]]
    good = [h for h, t in tally.items() if t["a"] and h not in bad]
    nodes = {h for e in edges for h in e} | set(tally)
    start = [{h: (u.MASS // len(s) if h in s else 0) for h in nodes} for s in (good, bad)]
    mass = [dict(s) for s in start]
    outs, ins = Counter(a for a, _ in edges), Counter(b for _, b in edges)
    unit, moved = u.MASS // (u.PART * len(nodes)), None
    while moved is None or moved and moved * 85 >= unit * 15:
        new = [{h: s[h] * 15 // 100 for h in nodes} for s in start]
        for a, b in edges:
            new[0][b] += mass[0][a] * 85 // 100 // outs[a]
            new[1][a] += mass[1][b] * 85 // 100 // ins[b]
        moved = sum(abs(new[i][h] - mass[i][h]) for i in (0, 1) for h in nodes)
        mass = new
    judged = judge(spark, rows)
    for r in judged:
        t, d = (m[r["host"]] for m in mass)
        assert (r["trust"], r["distrust"]) == (t, d)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if d > t and d >= u.MASS // (u.PART * len(nodes)) else "allow")
    verdict = {r["host"]: r["verdict"] for r in judged}
    assert verdict["link.example.com"] == "block" and verdict["good.example.com"] == "allow"


def test_long_chains_are_walked_to_their_end(spark):
    """Fifteen hosts in a row, the last of which links to a blocked one; and a circle, which ends by the masses still moved."""
    page = lambda i, host, to: (i, f"http://{host}/x", "".join(f'<a href="//{h}/">' for h in to))
    rows = [page(i, f"h{i}.com", [f"h{i + 1}.com" if i < 14 else "spam.net"]) for i in range(15)] + [page(50, "spam.net", [])]
    rows += [page(60 + i, f"c{i}.com", [f"c{(i + 1) % 3}.com"]) for i in range(3)] + [(70, "http://good.org/fr/", '<a href="//c0.com/">')]
    ranks = {r["host"]: r for r in judge(spark, rows)}
    got = {h: r["verdict"] for h, r in ranks.items()}
    assert all(got[f"h{i}.com"] == "block" for i in range(15)) and got["spam.net"] == "block"
    assert all(got[f"c{i}.com"] == "allow" for i in range(3)) and got["good.org"] == "allow"
    hosts = 15 + 1 + 3 + 1
    unit = u.MASS // (u.PART * hosts)
    trust = [ranks[f"c{i}.com"]["trust"] for i in range(3)]
    t = [0.0] * 3  # the circle's own limit: good.org's mass enters at c0 and goes round
    for _ in range(500):
        t = [0.85 * t[2] + 0.85 * 0.15 * u.MASS, 0.85 * t[0], 0.85 * t[1]]
    assert all(abs(a - b) < unit for a, b in zip(trust, t, strict=True))
