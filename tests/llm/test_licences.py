"""Licence scans against a plain version: words by the pattern, phrases by comparing words, expressions by recursive descent."""

import random
import re
from collections import Counter

import pytest

from linestream.llm import licences as li
from linestream.llm.common import table

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def descend(tokens):
    """(labels, demand) of the longest valid beginning, by trying every length with a recursive parser."""

    def primary(i):
        if i < len(tokens) and tokens[i] == "(":
            v, i = either(i + 1)
            if v is None or i >= len(tokens) or tokens[i] != ")":
                return None, i
            return v, i + 1
        if i < len(tokens) and tokens[i].lower() not in ("and", "or", "with", "(", ")"):
            lab = li.label_of(tokens[i])
            return ((lab,), li.terms(lab)), i + 1
        return None, i

    def chain(name, inner, join):
        def run(i):
            v, i = inner(i)
            while v is not None and i < len(tokens) and tokens[i].lower() == name:
                w, j = inner(i + 1)
                if w is None:
                    return None, j
                v, i = join(v, w), j
            return v, i

        return run

    exc = chain("with", primary, lambda v, w: (v[0], v[1] * li.EXCEPTION))
    both = chain("and", exc, lambda v, w: (v[0] + w[0], max(v[1], w[1])))
    either = chain("or", both, lambda v, w: (v[0] + w[0], min(v[1], w[1])))
    for n in range(len(tokens), 0, -1):
        whole, tokens = tokens, tokens[:n]
        v, i = either(0)
        tokens = whole
        if v is not None and i == n:
            return tuple(dict.fromkeys(v[0])), v[1]
    return None


def test_expressions():
    one = lambda s: (lambda e: e and (e.labels, round(e.demand, 6)))(li.expression(s))
    assert one(" MIT") == (("mit",), 0.1)
    assert one("GPL-3.0-or-later WITH Classpath-exception-2.0 AND MIT") == (("gpl-3", "mit"), 0.35)
    assert one("MIT or GPL-2.0-only and Apache-2.0") == (("mit", "gpl-2", "apache-2"), 0.1)
    assert one("(MIT OR GPL-2.0) AND Apache-2.0 */") == (("mit", "gpl-2", "apache-2"), 0.2)
    assert one("MIT OR") == one("MIT ) x") == one("MIT, BSD") == one("MIT OR (GPL-2.0") == (("mit",), 0.1)
    assert one("MIT BSD") == (("mit",), 0.1) and one("-->") is one("OR MIT") is one("") is one("()") is None
    assert one("LicenseRef-own.") == (("licenseref-own",), 0.5) and one("CC-BY-NC-4.0") == (("cc-by-nc",), 0.9)
    assert one("(" * 5000 + "MIT") is None
    assert one("MIT" + " OR MIT" * 5000) == (("mit",), 0.1)


@pytest.mark.parametrize("seed", range(300))
def test_expressions_against_descent(seed):
    rng = random.Random(seed)
    tokens = [rng.choice(["MIT", "GPL-3.0", "Apache-2.0", "x", "and", "OR", "With", "(", ")"]) for _ in range(rng.randrange(1, 12))]
    if rng.random() < 0.7:  # mostly sensible ones
        for i in range(0, len(tokens), 2):
            tokens[i] = rng.choice(["MIT", "GPL-3.0", "(MIT", "Apache-2.0)", "CC-BY-NC-4.0"])
        for i in range(1, len(tokens), 2):
            tokens[i] = rng.choice(["and", "OR", "With"])
    line = " ".join(tokens)
    e = li.expression(line)
    want = descend(re.findall(r"[()]|[^\s()]+", line))
    assert (e and (e.labels, e.demand)) == want


def brute(text):
    text = text or ""
    spans = [(m.group().translate(FOLD), m.end()) for m in WORDS.finditer(text.translate(FOLD))]
    words, found = [w for w, _ in spans], []
    for kind, phrases in (("base", li.BASE), ("notice", li.NOTICES), ("tag", [(t, "") for t in li.TAGS])):
        for phrase, label in phrases:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    if kind != "tag":
                        found.append((i, kind, label, li.terms(label)))
                        continue
                    rest = text[spans[i + len(p) - 1][1] :].split("\n")[0]
                    rest = rest[1:] if rest[:1] == ":" else rest
                    tokens, at = [], 0
                    while m := re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)").match(rest, at):
                        tokens.append(m.group(1).rstrip("-.:") or m.group(1))
                        at = m.end()
                    for lab in (descend(tokens) or ((), 0))[0]:
                        found.append((i, kind, lab, descend(tokens)[1]))
    base = [f for f in found if f[1] == "base"]
    told = lambda fs: ",".join(sorted({f[2] for f in fs}))
    starts = [f[0] for f in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), told(base), told(found), max((f[3] for f in found), default=0.0)
    )


ODD = [
    "Under the MIT License under the mit-license; UNDER\nTHE  MIT LICENSE", "under the mit license under the mit license under the mit licenses",
    "under the mit license version 2 apache license version 2 apache license version 2.0", "cc-by-nc cc by nc by nc cc\x7fby\x80nc cc by nc",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-NC-4.0\nSPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note -->",
    "spdx license identifier", "// SPDX-License-Identifier:MIT", "spdx-license-identifier: \nMIT", "É under the mit licenseé", "   ", "  ", "\x85",
    "under the mit license" * 3, "gnu general public license version 3 gnu general public license", "all rights reserved. creative commons attribution noncommercial",
    "a" * 5000 + " cc by nc " + "b " * 5000, "x under under the mit license", "cc by nc", "SPDX-License-Identifier: " + "(" * 50 + "MIT" + ")" * 50,
]


def test_digest(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(300 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    given = table(spark, SF, "documents").select("doc_id", "text")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True).unionByName(given, allowMissingColumns=True)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in li.licence_digest(docs.repartition(3)).collect()) == Counter((d, *brute(t)) for d, t in rows)
    assert li.licence_digest(no_docs).count() == 0


def test_other_phrases(spark):
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "b")], "doc_id long, text string")
    out = {r[0]: (r[2], r[5]) for r in li.licence_digest(docs, [("a b a", "p"), ("b", "q")], [], []).collect()}
    assert out == {1: (4, "p,q"), 2: (1, "q")}
    assert [r[2] for r in li.licence_digest(docs, [], [], []).orderBy("doc_id").collect()] == [0, 0]
