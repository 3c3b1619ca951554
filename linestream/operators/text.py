"""Cleaning lines, joining them back into texts, word-by-word translation."""

from __future__ import annotations

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linestream import scale
from linestream.functions.text import trim_unicode
from linestream.scale import fits, is_read, lookup_join, materialize
from linestream.schema import FRAME


def clean_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Trim Unicode white space; drop lines with nothing left."""
    return lines.withColumn(text, trim_unicode(F.col(text))).where(F.col(text) != "")


def _ordered_join(order: str, value: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), "\n")


def assemble_original(
    lines: DataFrame, keys: list[str] | None = None, order: str = "line_no", text: str = "text"
) -> DataFrame:
    """Source text of each frame in reading order; no row where it would be empty."""
    out = lines.groupBy(*(keys or FRAME)).agg(_ordered_join(order, F.col(text)).alias("original"))
    return out.where(F.col("original") != "")


def assemble_translation(
    lines: DataFrame,
    policy: str,
    keys: list[str] | None = None,
    order: str = "line_no",
    text: str = "text",
    translated: str = "translated",
) -> DataFrame:
    """Translated text of each frame.

    ``region`` joins translations only; ``live`` puts the source text where there is none yet.
    """
    if policy == "region":
        shown = F.col(translated)
    elif policy == "live":
        shown = F.coalesce(translated, F.nullif(F.col(text), F.lit("")))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    out = (
        lines.where(shown.isNotNull())
        .groupBy(*(keys or FRAME))
        .agg(_ordered_join(order, shown).alias("translation"))
    )
    return out.where(F.col("translation") != "")


def lexicon_translate(
    requests: DataFrame,
    lexicon: DataFrame,
    ids: list[str],
    target: str = "en",
    source: str = "source",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Answers of the built-in word-by-word backend: one row ``ids + (translated)`` per request.

    Tokens are split on one space; a token without an entry stays as it is.  The lexicon holds
    ``(source, target, token, out)`` with one row per key.  ``keep`` names columns of the requests that come along, so that
    the answers need not be joined back to them.

    With a lexicon small enough to broadcast nothing is shuffled: a request is translated in its task.  With a larger one
    the entries of the commonest tokens go to every task, and only the other tokens are joined to the lexicon, by
    shuffle.  Which tokens are common is read off a part of the texts picked by a hash; it decides the way a token
    takes, not what becomes of it.
    """
    # Looked at up to four times: a lexicon that is itself worked out must not be worked out as often.
    words = materialize(
        lexicon.where(F.col("target") == target).select(F.col("source").alias("__source"), F.col("token").alias("__token"), "out")
    )
    kept = [F.struct(*keep).alias("__keep")] if keep else []
    asked = requests.select(*ids, *kept, F.col(source).alias("__source"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    also = ["__keep.*"] if keep else []
    if fits(words):
        return asked.select(*ids, *also, _word_by_word(_sent(words))("__source", "__text", F.lit(None)).alias("translated"))
    if requests.isStreaming:
        if keep:
            raise ValueError("a stream with a large lexicon cannot keep columns")
        return _token_by_token(asked, words, ids)
    common = _sent(_common_words(asked, words))
    # Asked for by the rare tokens and by the texts they are put back into: worked out once.
    asked = asked if is_read(requests) else materialize(asked)
    rare = asked.select(*ids, "__source", F.explode(_not_in(common)("__source", "__text")).alias("__r"))
    rare = rare.select(*ids, "__source", F.col("__r.at").alias("at"), F.col("__r.token").alias("__token"))
    put = rare.join(words.where(F.col("out").isNotNull()), ["__source", "__token"])
    put = put.groupBy(*ids).agg(F.collect_list(F.struct("at", "out")).alias("__put"))
    return asked.join(put, ids, "left").select(
        *ids, *also, _word_by_word(common)("__source", "__text", "__put").alias("translated")
    )


#: Of how many texts one is looked at for the commonest tokens.
_LOOK = 16


def _common_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """The commonest tokens with their entries, ``out`` NULL where they have none: as many as may be broadcast."""
    some = asked.where(F.pmod(F.xxhash64("__text"), F.lit(_LOOK)) == 0)
    tokens = some.select("__source", F.explode(F.split("__text", " ", -1)).alias("__token"))
    n = tokens.where(F.col("__source").isNotNull()).groupBy("__source", "__token").agg(F.count(F.lit(1)).alias("__n"))
    common = n.where(F.octet_length("__token") <= 64).orderBy(F.desc("__n"), "__source", "__token").limit(scale.BROADCAST_ROWS)
    common = materialize(common.select("__source", "__token"))
    found = words.join(F.broadcast(common), ["__source", "__token"]).where(F.octet_length("out") <= 256)
    found = materialize(found.select("__source", "__token", "out"))
    # What has no entry here (none at all, or a long one) is told apart by one look at the lexicon.
    other = common.join(F.broadcast(found), ["__source", "__token"], "left_anti")
    none = other.join(words.where(F.col("out").isNotNull()).select("__source", "__token"), ["__source", "__token"], "left_anti")
    return found.unionByName(none.withColumn("out", F.lit(None).cast("string")))


def _sent(words: DataFrame) -> Broadcast:
    """Words, checked to be few, by source and token, for each task; an entry without ``out`` stands for itself."""
    known: dict[str, dict[str, str]] = {}
    for src, token, out in zip(*[c.to_pylist() for c in words.select("__source", "__token", "out").toArrow().columns], strict=True):
        known.setdefault(src, {})[token] = token if out is None else out
    return words.sparkSession.sparkContext.broadcast(known)


def _not_in(sent: Broadcast):
    """A function of a source and a text: the places and tokens that are not among the words."""

    @F.arrow_udf("array<struct<at:int,token:string>>")
    def find(source: pa.Array, text: pa.Array) -> pa.Array:
        ends, at, tokens = [0], [], []
        for src, x in zip(source.to_pylist(), text.to_pylist(), strict=True):
            by_token = sent.value.get(src, {})
            for i, t in enumerate(x.split(" ")):
                if t not in by_token:
                    at.append(i)
                    tokens.append(t)
            ends.append(len(at))
        each = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(tokens, pa.string())], ["at", "token"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return find


def _word_by_word(sent: Broadcast):
    """A function of a source, a text and what else is known for some places of it: the translated text."""

    @F.arrow_udf(T.StringType())
    def put(source: pa.Array, text: pa.Array, more: pa.Array) -> pa.Array:
        texts = []
        for src, x, some in zip(source.to_pylist(), text.to_pylist(), more.to_pylist(), strict=True):
            by_token = sent.value.get(src, {})
            out = [by_token.get(t, t) for t in x.split(" ")]
            for r in some or ():
                out[r["at"]] = r["out"]
            texts.append(" ".join(out))
        return pa.array(texts, pa.string())

    return put


def _token_by_token(asked: DataFrame, words: DataFrame, ids: list[str]) -> DataFrame:
    """Every token joined to the lexicon: for streams, whose texts cannot be looked at beforehand."""
    tokens = asked.select(*ids, "__source", F.posexplode(F.split("__text", " ", -1)).alias("__pos", "__token"))
    put = lookup_join(tokens, words, ["__source", "__token"], small=False)
    rows = F.array_sort(
        F.collect_list(F.struct(F.col("__pos").alias("o"), F.coalesce("out", "__token").alias("v")))
    )
    return put.groupBy(*ids).agg(F.array_join(F.transform(rows, lambda r: r["v"]), " ").alias("translated"))
