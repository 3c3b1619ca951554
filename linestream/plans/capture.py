"""One-shot capture: lines of a frame in, the same lines translated out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestream.functions.languages import primary_subtag
from linestream.operators.language import Profile, resolve_sources
from linestream.operators.memory import Translator, answered_lines, apply_translations, translate_batches, with_keys
from linestream.operators.text import clean_lines, lexicon_translate
from linestream.scale import materialize
from linestream.schema import AUTO, LINE

# Takes the pending lines (with ``source``, ``source_max``, ``text``), gives ``LINE + (answer)``, perhaps with ``error``;
# or gives all columns of the pending lines, every line of them, with ``answer``: then they need not be brought together again.
Backend = Callable[[DataFrame], DataFrame]


def lexicon_backend(lexicon: DataFrame, target: str) -> Backend:
    def run(pending: DataFrame) -> DataFrame:
        others = [c for c in pending.columns if c not in LINE]
        asked = pending.withColumn("__lang", primary_subtag(F.col("source")))
        said = lexicon_translate(asked, lexicon, LINE, target, source="__lang", keep=others).withColumnRenamed("translated", "answer")
        silent = pending.where(F.col("text").isNull()).withColumn("answer", F.lit(None).cast("string"))
        return said.unionByName(silent)

    return run


def translator_backend(translator: Translator, target: str, strategy: str, partitions: int | None = None) -> Backend:
    def run(pending: DataFrame) -> DataFrame:
        return answered_lines(pending, translate_batches(pending, translator, target, strategy, partitions))

    return run


def translate_capture(
    lines: DataFrame,
    backend: Backend,
    source: str = AUTO,
    target: str = "en",
    strategy: str = "lowLatency",
    profile: Profile | None = None,
) -> DataFrame:
    """Clean, find each line's language, translate what is not in the target language yet.

    Every line ends with a translation: its own text where no answer came.  ``unavailable`` marks the lines whose
    translator failed, with its ``error``, if the backend tells.  This path does not read the translation memory.
    """
    resolved = resolve_sources(clean_lines(lines), source, profile)
    # Asked for by the backend and by the lines that its answers go to: the texts are worked out and brought together once.
    keyed = materialize(with_keys(resolved, target, strategy))
    answers = backend(keyed.where(~F.col("same_language")))
    ready = keyed.withColumn("translated", F.when(F.col("same_language"), F.col("text")))
    if "error" not in answers.columns:
        answers = answers.withColumn("error", F.lit(None).cast("string"))
    if set(keyed.columns) <= set(answers.columns):
        said = answers.withColumn("translated", F.coalesce("answer", "text")).drop("answer")
        done = ready.where("same_language").withColumn("error", F.lit(None).cast("string")).unionByName(said)
    else:
        done = apply_translations(ready, answers, "region", LINE, keep=["error"])
    return done.withColumn("unavailable", F.col("error").isNotNull())
