"""Spans of pattern matches in texts, by SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters before a match that are kept as its context.
CONTEXT = 16
_SPANS = "array<struct<s:int,e:int,v:string,c:string>>"


def none() -> Column:
    return F.array().cast(_SPANS)


def find(text: Column, pattern: str, needs: str | None = None, context: bool = False) -> Column:
    """Leftmost non-overlapping matches of a Java ``pattern``: (s, e, v, c), code points, end exclusive.

    c is, if asked for, the end of the text between the last match and this one.

    The text between the matches and the matches, taken in turn, tell where each begins.
    ``needs``: a string without which there is no match; texts without it skip the search.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(F.coalesce(x["h"], F.lit("")))
        before = F.right(x["p"], F.lit(CONTEXT)) if context else F.lit(None).cast("string")
        one = F.struct(begin.alias("s"), end.alias("e"), x["h"].alias("v"), before.alias("c"))
        return F.struct(end.alias("at"), F.when(x["h"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none().alias("out"))
    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    there = text.rlike(pattern) if needs is None else F.contains(text, F.lit(needs))
    return F.when(there, found).otherwise(none())


def told(spans: dict[str, Column]) -> Column:
    """All spans as ``kind:start:end``, by start, then kind in the order given, comma-joined."""

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))

    names = F.array(*[F.lit(k) for k in spans])
    every = F.array_sort(F.concat(*[tagged(a, i) for i, a in enumerate(spans.values())]))
    return F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def overlaps(x: Column, others: list[Column]) -> Column:
    """Whether ``x`` overlaps a span of one of the arrays ``others``."""
    out = F.lit(False)
    for spans in others:
        out = out | F.exists(spans, lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"]))
    return out


def trees_column(trees, features: list[Column]) -> Column:
    """The margin of boosted trees (see ``quality.Trees``) as one expression of CASE WHENs."""

    def node(i: int) -> Column:
        left = int(trees.left[i])
        if left < 0:
            return F.lit(float(trees.value[i]))
        return F.when(features[int(trees.feature[i])] <= F.lit(float(trees.cut[i])), node(left)).otherwise(node(left + 1))

    total = F.lit(float(trees.base))
    for root in trees.roots:
        total = total + node(int(root))
    return total
