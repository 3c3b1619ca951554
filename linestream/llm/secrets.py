"""Secrets in texts: fixed rules, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestream.llm.spans import find, none, told

# The rules of the base.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}+"  # a run is taken whole, so a shorter one can be passed over at once
VALUE_LENGTH, ACCESS_LENGTH = 12, 18

#: What the models judge: runs of key characters of this length, as short as the shortest value a rule takes.
SHORTEST = 12
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates made of plain words, the samples of ordinary identifiers.
ORDINARY = "^[+/_=-]*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]{1,4}+)[+/_=-]*+)++$"
#: Added to each count of a character, weight of the single characters behind a pair; the log-likelihood ratio a secret needs, in all and per character.
SMOOTH, BACK, RATIO, MEAN_RATIO = 0.5, 5.0, 12.0, 0.35
_WIDE = len(CHARACTERS)


def base_spans(text: Column) -> dict[str, Column]:
    """assign, access, hex: arrays of (s, e, v) that pass the rules."""
    value = lambda v: F.regexp_extract(v, ASSIGN, 1)
    return {
        "assign": F.filter(find(text, ASSIGN), lambda x: F.length(value(x["v"])) >= VALUE_LENGTH),
        "access": F.filter(find(text, ACCESS, "AKIA"), lambda x: F.length(x["v"]) >= ACCESS_LENGTH),
        "hex": find(text, HEX),
    }


def outside(spans: Column, taken: Column) -> Column:
    """The parts of ``spans`` that lie outside of all spans ``taken`` (s, e), those of ``SHORTEST`` characters or more: (s, e, v)."""

    def met(x: Column) -> Column:
        near = F.filter(taken, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), near.alias("near"))

    def parts(x: Column) -> Column:
        covered = lambda p: F.exists(x["near"], lambda b: (b["s"] <= p) & (p < b["e"]))
        places = F.array_distinct(F.concat(F.array(x["s"]), F.transform(x["near"], lambda b: b["e"])))
        begins = F.filter(places, lambda p: (p < x["e"]) & ~covered(p))

        def part(p: Column) -> Column:
            later = F.transform(F.filter(x["near"], lambda b: b["s"] >= p), lambda b: b["s"])
            end = F.least(x["e"], F.array_min(later))  # without a later one: null, which least passes over
            return F.struct(p.alias("s"), end.alias("e"), F.substring(x["v"], p - x["s"] + 1, end - p).alias("v"))

        return F.transform(begins, part)

    return F.filter(F.flatten(F.transform(F.transform(spans, met), parts)), lambda x: x["e"] - x["s"] >= SHORTEST)


def _log_next(pairs: dict[str, int]) -> list[list[float]]:
    """Log-probability of each character after each: pair counts, backed by the counts of single characters."""
    single = {c: SMOOTH + sum(n for p, n in pairs.items() if p[1] == c) for c in CHARACTERS}
    total = sum(single.values())
    after = {c: BACK + sum(n for p, n in pairs.items() if p[0] == c) for c in CHARACTERS}
    prob = lambda a, b: (pairs.get(a + b, 0) + BACK * single[b] / total) / after[a]
    return [[math.log(prob(a, b)) for b in CHARACTERS] for a in CHARACTERS]


def train(found: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each pair of characters, row by row; empty without samples of both.

    Labelled samples: the values the rules found are random strings; what candidates hold outside of them and is made of plain
    words are ordinary identifiers.  Pairs are counted over all of them, map-side first; at most one row for each
    pair of the key characters and label reaches the driver.
    """
    values = F.transform("assign", lambda x: F.regexp_extract(x["v"], ASSIGN, 1))
    plain = lambda c: F.transform(c, lambda x: x["v"])
    ordinary = F.filter(plain("others"), lambda v: v.rlike(ORDINARY))
    mark = lambda a, y: F.transform(a, lambda v: F.struct(v.alias("v"), F.lit(y).alias("y")))
    samples = found.select(F.explode(F.concat(mark(F.concat(values, plain("access"), plain("hex")), 1), mark(ordinary, 0))).alias("m"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("m.v") - 1), lambda i: F.substring(F.col("m.v"), i, 2))
    counted = samples.select("m.y", F.explode(F.when(F.length("m.v") > 1, pairs)).alias("p")).groupBy("y", "p").count()
    got: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in counted.where(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect():
        got[r["y"]][r["p"]] = r["count"]
    if not got[0] or not got[1]:
        return []
    random, plain_words = _log_next(got[1]), _log_next(got[0])
    return [r - o for row, other in zip(random, plain_words, strict=True) for r, o in zip(row, other, strict=True)]


def ratio(value: Column, ratios: list[float]) -> Column:
    """Sum of the ratios of the neighbouring characters of ``value``."""
    place = [CHARACTERS.find(chr(i)) for i in range(128)]
    places = F.from_json(F.lit(json.dumps(place)), "array<int>")
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    at = lambda i: F.element_at(places, F.ascii(F.substring(value, i, 1)) + 1)
    pairs = F.sequence(F.lit(1), F.length(value) - 1)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.element_at(table, at(i) * _WIDE + at(i + 1) + 1))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The rules' spans stay; the models add what candidates hold outside of them, as kind ``random``, where the characters follow
    each other as in random strings.  Both passes are plain scans: no shuffle but of the pair counts.

    Null texts count as empty: no spans, the hash of nothing; null ids and repeated rows are rows like others; without any
    rule match the models know nothing and add nothing; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = ["assign", "access", "hex"]
    found = docs.select("doc_id", text.alias("text"))
    # Columns of their own, used more than once: so they are worked out once a row, not again inside the lambdas.
    found = found.select("doc_id", *[a.alias(k) for k, a in base_spans(F.col("text")).items()], find(F.col("text"), CANDIDATE).alias("cand"))
    bare = lambda k: F.transform(k, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))
    found = found.select("doc_id", *kinds, "cand", F.concat(*map(bare, kinds)).alias("taken"))
    found = found.select("doc_id", *kinds, outside(F.col("cand"), F.col("taken")).alias("others"))
    ratios = train(found)
    if ratios:

        def random(x: Column) -> Column:
            llr = ratio(x["v"], ratios)
            return (llr >= RATIO) & (llr >= F.length(x["v"]) * MEAN_RATIO)

        added = F.filter("others", random)
    else:
        added = none()
    base = {k: F.col(k) for k in kinds}
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(told(base), 256).alias("base_sha256"),
        told({**base, "random": added}).alias("spans"),
    )
