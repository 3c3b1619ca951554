"""Translation memory, request batches, matching answers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linestream.functions.languages import maximal_id, primary_subtag
from linestream.scale import lookup_join, materialize
from linestream.schema import FRAME, TM_KEY

#: Gives a series of answers, or yields (position, answer) as they come.
Translator = Callable[[pd.DataFrame], pd.Series | Iterator[tuple[int, str]]]

#: Distinct texts that one task asks for, at least where there are more tasks than cores can take in turn.
TASK_TEXTS = 1_000
#: Tasks per core that asking is spread over at most: the driver keeps books on each of them and on the file it writes.
TASKS_PER_CORE = 8


def with_keys(lines: DataFrame, target: str, strategy: str, source: str = "source") -> DataFrame:
    """Add what the memory is asked by: maximal source, raw target, strategy; and ``same_language``."""
    src = F.col(source)
    return lines.withColumns(
        {
            "source_max": maximal_id(src),
            "strategy": F.lit(strategy),
            "target": F.lit(target),
            # An unknown source is in no language, so such a line is asked for.
            "same_language": F.coalesce(primary_subtag(src) == primary_subtag(F.lit(target)), F.lit(False)),
        }
    )


def _memory(tm: DataFrame, target: str, strategy: str) -> DataFrame:
    """The part of the memory that can match, keyed ``(source_max, text)``; a row without a translation knows nothing."""
    useful = (F.col("target") == target) & (F.col("strategy") == strategy) & F.col("translated").isNotNull()
    return tm.where(useful).select(
        F.col("source").alias("source_max"), "text", F.col("translated").alias("cached")
    )


def tm_lookup(
    lines: DataFrame,
    tm: DataFrame,
    target: str,
    strategy: str,
    source: str = "source",
    small: bool | None = None,
) -> DataFrame:
    """Add ``translated``: the text itself where it is in the target language already, else the
    memory's answer for (maximal source, strategy, raw target, text), else NULL.

    ``tm`` holds one row per key.  ``cache_hit`` tells the memory's answers apart.
    """
    keyed = with_keys(lines, target, strategy, source)
    found = lookup_join(keyed, _memory(tm, target, strategy), ["source_max", "text"], small=small)
    hit = F.when(F.col("same_language"), F.col("text")).otherwise(F.col("cached"))
    return found.withColumn("translated", hit).withColumn(
        "cache_hit", ~F.col("same_language") & F.col("cached").isNotNull()
    ).drop("cached")


def pending_lines(
    lines: DataFrame,
    tm: DataFrame,
    target: str,
    strategy: str,
    source: str = "source",
    small: bool | None = None,
) -> DataFrame:
    """Lines that are neither in the target language nor in the memory."""
    keyed = with_keys(lines, target, strategy, source).where(~F.col("same_language"))
    known = _memory(tm, target, strategy).drop("cached")
    return lookup_join(keyed, known, ["source_max", "text"], "left_anti", small=small)


def translation_batches(pending: DataFrame, keys: list[str] | None = None, order: str = "line_no") -> DataFrame:
    """One batch per frame and maximal source: ``(keys, source_max, n, items)`` in line order.

    A batch is as large as one frame, never as large as a language: the groups are made within a
    frame.
    """
    items = F.array_sort(F.collect_list(F.struct(order, "line_id", "text")))
    return pending.groupBy(*(keys or FRAME), "source_max").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(items, lambda r: F.struct(r["line_id"].alias("line_id"), r["text"].alias("text"))).alias("items"),
    )


def match_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Pair answers with requests by ``line_id``; unknown or missing ids fall away, of repeated
    ids the last to arrive counts."""
    last = (
        responses.where(F.col("line_id").isNotNull() & F.col("text").isNotNull())
        .groupBy("line_id")
        .agg(F.max_by("text", F.struct("arrival", "text")).alias("answer"))
    )
    return requests.join(last, "line_id", "inner")


def apply_translations(
    lines: DataFrame, answers: DataFrame, policy: str, on: list[str], text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Put ``answer`` into ``translated``; ``keep`` names columns of ``answers`` that come along.

    ``answers`` holds one row per ``on`` key, ``lines`` too, so no key is hot.  Lines without an
    answer take their source text under ``region``, stay NULL (to be asked again) under ``live``.
    """
    if policy not in ("region", "live"):
        raise ValueError(f"unknown policy {policy!r}")
    value = F.coalesce("answer", "translated")
    if policy == "region":
        value = F.coalesce(value, F.col(text))
    return lines.join(answers.select(*on, "answer", *(keep or [])), on, "left").withColumn("translated", value).drop("answer")


def tm_upsert(tm: DataFrame, answers: DataFrame) -> DataFrame:
    """The memory with the answers put in: the last answer per key wins, nothing is evicted.

    ``answers``: the key columns, ``translated``, ``arrival``.  Partial aggregation
    combines copies of a hot key ahead of the shuffle.
    """
    old = tm.select(*TM_KEY, "translated", F.lit(0).alias("__new"), F.lit(None).cast("long").alias("arrival"))
    new = answers.where(F.col("translated").isNotNull()).select(
        *TM_KEY, "translated", F.lit(1).alias("__new"), F.col("arrival").cast("long").alias("arrival")
    )
    rank = F.struct("__new", "arrival", "translated")
    return old.unionByName(new).groupBy(*TM_KEY).agg(F.max_by("translated", rank).alias("translated"))


def _call_tasks(texts: int, spark: SparkSession) -> int:
    """One task per ``TASK_TEXTS`` texts, until all cores have several to take in turn; from there on tasks grow, not their number."""
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return max(1, min(math.ceil(texts / TASK_TEXTS), most))


def translate_batches(
    pending: DataFrame,
    translator: Translator,
    target: str,
    strategy: str,
    partitions: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """Ask ``translator`` once per distinct (maximal source, text).

    Gives ``source_max, text, answer, error``.  ``translator`` takes a data frame
    ``(source, target, strategy, text)`` of one source language and gives a series of answers, or
    yields ``(position, answer)`` one after another.  If it raises, the rows of that call that have no
    answer yet get ``error``; other groups go on.

    The distinct keys are spread by (source, text), so one language fills many tasks, and sorted
    by source within a task, so that each source is one run of calls.  The answers are written
    once: nothing downstream, and no lost executor after it, asks the translator again.
    """
    # Copies go within the batch that holds them, what is left of them after the one shuffle of the texts.
    asked = pending.select("source_max", "text").mapInArrow(_once, "source_max string, text string")
    if partitions is None:
        # By their number, not by bytes: a call takes long, and small texts would all fall to one task.
        asked = materialize(asked)
        texts = asked.agg(F.count_distinct(F.xxhash64("source_max", "text"))).first()[0]
        partitions = _call_tasks(texts, asked.sparkSession)
    asked = asked.repartition(partitions, "source_max", "text").dropDuplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, part in batch.groupby("source_max", sort=False):
                part = part.reset_index(drop=True)
                out = part.assign(answer=None, error=None)
                try:
                    req = part.rename(columns={"source_max": "source"}).assign(target=target, strategy=strategy)
                    said = translator(req)
                    if isinstance(said, Iterator):
                        for at, answer in said:
                            out.at[at, "answer"] = answer
                    else:
                        out["answer"] = pd.Series(said).reset_index(drop=True)
                except Exception as e:  # one group's failure is data, not the job's failure
                    out.loc[out["answer"].isna(), "error"] = f"{type(e).__name__}: {e}"
                yield out[["source_max", "text", "answer", "error"]]

    res = asked.sortWithinPartitions("source_max").mapInPandas(
        run, "source_max string, text string, answer string, error string"
    )
    return materialize(res) if checkpoint else res


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch with its repeated rows once."""
    for b in batches:
        yield from pa.Table.from_batches([b]).group_by(b.schema.names).aggregate([]).to_batches()


def answered_lines(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """``lines`` with ``answer`` and ``error`` of their (maximal source, text); every line stays.

    ``answers`` has a row for each source and text of ``lines`` that both have a value, as ``translate_batches`` gives it.
    The lines go to them by the digest of their text, which comes back with the answer; so only the distinct texts move.
    """
    key, whole = F.unhex(F.md5("text")), F.col("source_max").isNotNull() & F.col("text").isNotNull()
    said = answers.select("source_max", key.alias("__key"), "text", "answer", "error")
    found = lookup_join(lines.where(whole).withColumn("__key", key).drop("text"), said, ["source_max", "__key"])
    none = {c: F.lit(None).cast("string") for c in ("answer", "error")}
    return found.select(*lines.columns, "answer", "error").unionByName(lines.where(~whole).withColumns(none))


def join_answers(lines: DataFrame, answers: DataFrame) -> DataFrame:
    """Give every pending line the answer of its (maximal source, text)."""
    return lookup_join(lines, answers, ["source_max", "text"])
