"""Licence terms in texts: notice phrases and identifier tags, and what their expressions ask of a user."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases: (words, label).  Fixed values of the contract.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Further notices: (words, label).
NOTICES = [
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license", "apache-2"),
    ("apache 2 0 license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("creativecommons org licenses by nc", "cc-by-nc"),
    ("creativecommons org licenses by sa", "cc-by-sa"),
    ("creativecommons org licenses by", "cc-by"),
    ("creativecommons org publicdomain zero", "cc0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("dedicated to the public domain", "public-domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]

#: Words of a tag; the rest of its line is an expression.
TAGS = ["spdx license identifier"]

#: How much a licence asks of whoever uses the text: 0 nothing, 1 not to be used.  Longest name that begins the label counts.
TERMS = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0, "wtfpl": 0.0,
    "mit": 0.1, "isc": 0.1, "bsd": 0.1, "zlib": 0.1, "boost": 0.1, "bsl-1": 0.1, "apache": 0.2, "cc-by": 0.2,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8,
    "cc-by-nd": 0.8, "cc-by-nc": 0.9, "all-rights-reserved": 1.0, "proprietary": 1.0,
}
#: A licence that is not listed.
UNKNOWN = 0.5
#: What an exception leaves of its licence's terms.
EXCEPTION = 0.5

#: A-Z lower-cased, every other character below 0x80 that is no digit and no letter becomes a space.
_FOLD = {c: " " for c in range(0x80) if not chr(c).isalnum()} | {c: chr(c + 32) for c in range(0x41, 0x5B)}
_TOKEN = re.compile(r"[\x20\t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Operators that may wait: deeper expressions than this are cut off as broken.
MOST_DEPTH = 1000


def label_of(name: str) -> str:
    """A licence's label: lower case, without a version's zeros and suffixes (``GPL-3.0-or-later``: ``gpl-3``)."""
    name = re.sub(r"-(only|or-later)$|\+$", "", name.translate(_LOWER))
    while name.endswith(".0"):
        name = name[:-2]
    return re.sub(r"^(cc-by(?:-[a-z]+)*|cc0)-[0-9.]+$", r"\1", name)


_LOWER = {c: chr(c + 32) for c in range(0x41, 0x5B)}


@functools.lru_cache(1 << 14)
def terms(label: str) -> float:
    known = [k for k in TERMS if label == k or label.startswith((k + "-", k + "."))]
    return TERMS[max(known, key=len)] if known else UNKNOWN


@dataclass(frozen=True)
class Expression:
    """``labels`` named, in order; ``demand``: or takes the milder side, and the stricter, with halves; ``postfix`` form."""

    labels: tuple[str, ...]
    demand: float
    postfix: str


def expression(line: str) -> Expression | None:
    """The longest licence expression that a line begins with, by shunting-yard; None if there is none.

    ``with`` binds tightest, then ``and``, then ``or``; operators in any letter case, operators of one rank from the
    left.  The line is read up to the first character or word that cannot go on; an operator or bracket left
    open there is taken back.
    """
    out: list[str] = []
    wait: list[str] = []
    done: tuple[int, tuple[str, ...]] | None = None
    at, wants, depth = 0, True, 0  # wants: a licence or an opening bracket must come
    best: list[str] = []
    while m := _TOKEN.match(line, at):
        bracket, word = m.group(1), m.group(2)
        word = word.translate(_LOWER) if word else ""
        if wants:
            if bracket == "(" and len(wait) < MOST_DEPTH:
                wait.append("(")
                depth += 1
            elif word and word not in _RANK:
                out.append(m.group(2).rstrip("-.:") or m.group(2))
                wants = False
            else:
                break
        elif bracket == ")" and depth:
            while wait[-1] != "(":
                out.append(wait.pop())
            wait.pop()
            depth -= 1
        elif word in _RANK and len(wait) < MOST_DEPTH:
            while wait and wait[-1] != "(" and _RANK[wait[-1]] >= _RANK[word]:
                out.append(wait.pop())
            wait.append(word)
            wants = True
        else:
            break
        at = m.end()
        if not wants and not depth:
            done, best = (at, tuple(wait)), out.copy() if wait else out
            best = [*best, *reversed(wait)] if wait else list(out)
    if done is None:
        return None
    stack: list[tuple[float, tuple[str, ...]]] = []
    for item in best:
        if item not in _RANK:
            label = label_of(item)
            stack.append((terms(label), (label,)))
            continue
        (y, right), (x, left) = stack.pop(), stack.pop()
        if item == "with":  # an exception is no licence of its own
            stack.append((x * EXCEPTION, left))
        else:
            stack.append((min(x, y) if item == "or" else max(x, y), left + right))
    demand, labels = stack.pop()
    return Expression(tuple(dict.fromkeys(labels)), demand, " ".join(best))


class Scanner:
    """One automaton for base phrases, notices and tags, over the words of a text."""

    def __init__(self, base=None, notices=None, tags=None):
        given = {}
        for kind, phrases in (("base", BASE if base is None else base), ("notice", NOTICES if notices is None else notices)):
            for words, label in phrases:
                given.setdefault(" ".join(words.split()), []).append((kind, label))
        for words in TAGS if tags is None else tags:
            given.setdefault(" ".join(words.split()), []).append(("tag", ""))
        self.automaton = ahocorasick.Automaton()
        for words, found in given.items():
            self.automaton.add_word(f" {words} ", (len(words) + 2, words.count(" ") + 1, found))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple]]:
        """Number of words, and the findings: (first word, words, kind, label, demand, expression)."""
        flat = (text or "").translate(_FOLD)
        if not flat or flat.isspace() and not flat.strip(" "):
            return 0, []
        words = " ".join(filter(None, flat.split(" ")))
        n = words.count(" ") + 1
        out, last, at = [], 0, 0
        if not len(self.automaton):
            return n, out
        line = f" {words} "
        tagged = []
        hits = sorted((end - size + 1, count, found) for end, (size, count, found) in self.automaton.iter(line))
        for begin, count, found in hits:
            at += line.count(" ", last, begin)  # words before: one space ahead of each
            last = begin
            for kind, label in found:
                if kind == "tag":
                    tagged.append((at, count))
                else:
                    out.append((at, count, kind, label, terms(label), None))
        out += self._expressions(text or "", flat, tagged)
        return n, sorted(out, key=lambda f: (f[0], f[2], f[3]))

    @staticmethod
    def _expressions(text: str, flat: str, tagged: list[tuple[int, int]]) -> Iterator[tuple]:
        """Findings of the expressions behind tags, which begin at the words ``tagged``."""
        if not tagged:
            return
        waiting = dict.fromkeys(first + count - 1 for first, count in tagged)
        ends = {}
        for i, m in enumerate(re.finditer("[^ ]+", flat)):
            if i in waiting:
                ends[i] = m.end()
                if len(ends) == len(waiting):
                    break
        for first, count in tagged:
            end = ends[first + count - 1]
            stop = text.find("\n", end)
            rest = text[end : len(text) if stop < 0 else stop]
            found = expression(rest[1:] if rest[:1] == ":" else rest)
            if found is not None:
                for label in found.labels:
                    yield first, count, "tag", label, found.demand, found.postfix


_FINDING = pa.struct(
    [("word", pa.int64()), ("words", pa.int64()), ("kind", pa.string()), ("label", pa.string()), ("demand", pa.float64()), ("expression", pa.string())]
)


def scan_licences(docs: DataFrame, base=None, notices=None, tags=None) -> DataFrame:
    """doc_id, n_words and ``findings`` of each row of ``docs`` (doc_id, text).

    A finding is a place where a phrase's words stand consecutively, with its first word (from 0), number of words, kind
    (``base``, ``notice`` or ``tag``), label and demand (0 to 1); a tag gives one finding per licence that its
    expression names, with the demand of the whole expression and its postfix form.

    One pass over each text in the task that read it; nothing is shuffled.  Null and empty texts have no words; texts of
    any length are read whole; repeated rows and null ids are rows of their own; an empty table gives an empty
    result; other columns are ignored.
    """
    given = (base, notices, tags)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*given)
        for b in batches:
            n, found = [], []
            for text in b.column("text").to_pylist():
                words, findings = scanner.scan(text)
                n.append(words)
                found.append([dict(zip(("word", "words", "kind", "label", "demand", "expression"), f, strict=True)) for f in findings])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(_FINDING))], names=["doc_id", "n_words", "findings"]
            )

    schema = "doc_id long, n_words long, findings array<struct<word:long,words:long,kind:string,label:string,demand:double,expression:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


def licence_digest(docs: DataFrame, base=None, notices=None, tags=None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is what the document's licences ask together, 0 (nothing, or no licence found) to 1: the strictest
    finding, where an expression counts as one.  Odd rows as in ``scan_licences``; without findings the labels are ''.
    """
    found = scan_licences(docs, base, notices, tags)
    own = F.filter("findings", lambda f: f["kind"] == "base")
    told = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["label"]))), ",")
    starts = F.transform(own, lambda f: f["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(own).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        told(own).alias("base_labels"),
        told("findings").alias("labels"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["demand"])), F.lit(0.0)).alias("score"),
    )
