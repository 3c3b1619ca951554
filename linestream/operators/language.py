"""Which language a line is in: profile, detection, fallback over the frame; language lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linestream.functions.grams import GramScores, gram_counts
from linestream.functions.languages import display_name, filled, maximal_id, stages, subtags
from linestream.scale import fits, lookup_join, materialize
from linestream.schema import AUTO, DEFAULT_SOURCE, FRAME, LINE, LINE_CONFIDENCE

GRAM = 3


@dataclass(frozen=True)
class Profile:
    """Log-probability of each character gram, one column per language: ``g, lp_0, lp_1, ...``."""

    grams: DataFrame
    langs: list[str]
    n: int = GRAM
    small: bool = True


def _grams(x: Column, n: int) -> Column:
    """All grams of ``x``, none when it is shorter than ``n``.

    One walk over the text, by a pattern that looks ahead from each character (never from the second
    half of one).  Taking substrings by position would walk the text anew for each of them.
    """
    return F.regexp_extract_all(x, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1))


def _counted(items: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """``ids, v, n``: each distinct value of the array ``column`` of a row, and how often it is there.

    Worked out within the row: sorted, equal values stand together, and the places where they begin give
    the counts.  So a row sends each of its grams once.
    """
    items = items.select(*ids, F.array_sort(column).alias("__s"))
    begins = F.filter(F.sequence(F.lit(1), F.size("__s")), lambda i: (i == 1) | (F.get("__s", i - 1) != F.get("__s", i - 2)))
    items = items.select(*ids, "__s", F.when(F.size("__s") > 0, begins).alias("__b"))
    end = lambda j: F.coalesce(F.get("__b", j + 1), F.size("__s") + 1)
    runs = F.transform("__b", lambda i, j: F.struct(F.get("__s", i - 1).alias("v"), (end(j) - i).alias("n")))
    # The outer form keeps Spark from adding a filter that works the array out a second time.
    return items.select(*ids, F.explode_outer(runs).alias("__r")).select(*ids, "__r.v", "__r.n")


def _text_grams(x: Column, n: int) -> Column:
    """The grams of a text on its own: one shorter than a gram is its own single gram."""
    return F.when(F.length(x) >= n, _grams(x, n)).otherwise(F.array(x))


def language_profile(
    labelled: DataFrame, langs: list[str] | None = None, n: int = GRAM, text: str = "text", lang: str = "lang"
) -> Profile:
    """Character n-gram model with add-one smoothing.

    One pass: counts per gram with one column per language, made batch by batch in the tasks and combined ahead of the
    shuffle.  The counts are written once; only the totals (two numbers per language) come to the driver.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if langs is None:
        langs = sorted(r[0] for r in labelled.select(lang).distinct().collect())
    langs = list(langs)
    names = [f"c_{i}" for i in range(len(langs))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grams, table in gram_counts(b.column(0), b.column(1).to_numpy(), len(langs), n):
                yield pa.RecordBatch.from_arrays([pa.array(grams), *[pa.array(c) for c in table.T]], ["g", *names])

    place = F.array_position(F.array(*[F.lit(v) for v in langs]), F.col(lang)) - 1
    known = labelled.where(F.col(lang).isin(langs)).select(F.lower(text).alias("x"), place.cast("long").alias("l"))
    grams = known.mapInArrow(count, ", ".join(["g string", *[f"{c} long" for c in names]]))
    counts = materialize(grams.groupBy("g").agg(*[F.sum(c).alias(c) for c in names]))
    tot = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"c_{i}").alias(f"t_{i}") for i in range(len(langs))]).first()
    lps = [
        F.log((F.col(f"c_{i}") + 1) / F.lit(float((tot[f"t_{i}"] or 0) + tot["v"]))).alias(f"lp_{i}")
        for i in range(len(langs))
    ]
    model = counts.select("g", *lps)
    return Profile(model, list(langs), n, fits(model))


def _pick(df: DataFrame, langs: list[str], sums: str, k: str, out: str) -> DataFrame:
    """Add ``<out>_lang`` and ``<out>_conf`` from the summed log-probabilities ``<sums>_0, ...`` over
    ``k`` matched grams; NULL where there are none.  In steps, so that no score is worked out twice."""
    n = range(len(langs))
    df = df.withColumns({f"__{out}_{i}": F.col(f"{sums}_{i}") / F.sqrt(F.nullif(F.col(k), F.lit(0))) for i in n})
    top = F.greatest(*[F.col(f"__{out}_{i}") for i in n], F.lit(float("-inf")))
    df = df.withColumn("__top", top)
    best = F.coalesce(*[F.when(F.col(f"__{out}_{i}") == F.col("__top"), langs[i]) for i in sorted(n, key=lambda i: langs[i], reverse=True)])
    mass = sum((F.exp(F.col(f"__{out}_{i}") - F.col("__top")) for i in n), F.lit(0.0))
    return df.withColumns({f"{out}_lang": best, f"{out}_conf": 1 / mass}).drop("__top", *[f"__{out}_{i}" for i in n])


def _scored(profile: Profile, whole: bool = False):
    """A function of a lower-cased text: ``k`` known grams of it, summed log-probabilities ``s_0, ...``.

    With ``whole`` it also takes how many characters of the text are the line's own and whether the line is alone
    in its frame, and adds ``fk``, ``fs_0, ...`` over the grams of the frame that begin in the line.  The profile,
    checked to be small, goes to each task once.
    """
    names, spark = [f"lp_{i}" for i in range(len(profile.langs))], profile.grams.sparkSession
    rows = profile.grams.select("g", *names).toArrow()
    scores = np.stack([rows[c].to_numpy() for c in names], 1)
    model = spark.sparkContext.broadcast(GramScores(rows["g"].to_pylist(), scores, profile.n))
    cols = ["k", *[f"s_{i}" for i in range(len(names))]]
    cols += [f"f{c}" for c in cols] if whole else []
    schema = ", ".join(f"{c} {'long' if c in ('k', 'fk') else 'double'}" for c in cols)

    def table(found: tuple[np.ndarray, ...]) -> pa.Array:
        each = [c for k, s in zip(found[::2], found[1::2], strict=True) for c in (k, *s.T)]
        return pa.StructArray.from_arrays([pa.array(c) for c in each], cols)

    if not whole:

        @F.arrow_udf(schema)
        def score(x: pa.Array) -> pa.Array:
            return table(model.value.sums(x))

        return score

    @F.arrow_udf(schema)
    def score_in_frame(x: pa.Array, own: pa.Array, alone: pa.Array) -> pa.Array:
        return table(model.value.sums(x, own.to_numpy(), alone.to_numpy(zero_copy_only=False)))

    return score_in_frame


def detect_language(
    texts: DataFrame, profile: Profile, ids: list[str], min_conf: float = 0.0, text: str = "text"
) -> DataFrame:
    """``ids, detected, confidence``: the top language of each text.

    ``detected`` is NULL where no gram is known, and, when ``min_conf > 0``, where the confidence
    is below it.  With a profile small enough to broadcast, a text is scored in its task, so the shuffle carries one
    row of numbers per text.  With a larger one, a text sends each of its distinct grams once, with its count, to the
    profile.
    """
    n_langs = range(len(profile.langs))
    if profile.small:
        hit = texts.select(*ids, _scored(profile)(F.lower(text)).alias("__v"))
        k, each = F.col("__v.k"), [F.col(f"__v.s_{i}") for i in n_langs]
    else:
        grams = _text_grams(F.lower(text), profile.n)
        rows = _counted(texts.select(*ids, grams.alias("__g")), "__g", ids).withColumnRenamed("v", "g")
        hit = lookup_join(rows, profile.grams, ["g"], "left", small=False)
        k, each = F.when(F.col("lp_0").isNotNull(), F.col("n")), [F.col(f"lp_{i}") * F.col("n") for i in n_langs]
    sums = hit.groupBy(*ids).agg(
        F.coalesce(F.sum(k), F.lit(0)).alias("__k"), *[F.sum(each[i]).alias(f"__s_{i}") for i in n_langs]
    )
    best = _pick(sums, profile.langs, "__s", "__k", "line")
    lang = F.when(F.col("line_conf") >= min_conf, F.col("line_lang")) if min_conf > 0 else F.col("line_lang")
    return best.select(*ids, lang.alias("detected"), F.col("line_conf").alias("confidence"))


def _looked_up(x: DataFrame, profile: Profile) -> DataFrame:
    """The sums of ``resolve_sources`` with a profile that is joined: each distinct gram of a line once, with its count."""
    n, langs = profile.n, profile.langs
    # A line shorter than a gram is its own gram, put behind those of the frame; it is the frame's
    # gram too only if it is all the frame has.
    grams = F.concat(_grams(F.col("__ext"), n), F.when(F.col("__len") < n, F.array("__x")).otherwise(F.array().cast("array<string>")))
    n_ext = F.greatest(F.length("__ext") - (n - 1), F.lit(0))
    # All that is needed of the text is worked out ahead of the explode, so that no row carries it.
    x = x.select(*LINE, "__len", "__only", n_ext.alias("__n"), grams.alias("__grams"))
    own = lambda pos: (pos + n <= F.col("__len")) | (pos == F.col("__n"))
    all_ = lambda pos: (pos < F.col("__n")) | F.col("__only")
    told = F.transform("__grams", lambda g, at: F.struct(g.alias("g"), own(at).alias("own"), all_(at).alias("all")))
    rows = _counted(x.select(*LINE, told.alias("__g")), "__g", LINE).select(*LINE, "v.*", F.col("n").alias("__times"))
    times = F.col("__times")
    hit = lookup_join(rows, profile.grams, ["g"], "left", small=False)
    known = F.col("lp_0").isNotNull()
    return hit.groupBy(*LINE).agg(
        F.sum(F.when(known & F.col("own"), times).otherwise(0)).alias("__k"),
        F.sum(F.when(known & F.col("all"), times).otherwise(0)).alias("__fk"),
        *[F.sum(F.when(F.col("own"), F.col(f"lp_{i}") * times)).alias(f"__s_{i}") for i in range(len(langs))],
        *[F.sum(F.when(F.col("all"), F.col(f"lp_{i}") * times)).alias(f"__fs_{i}") for i in range(len(langs))],
    )


def frame_sources(profile: Profile, min_conf: float):
    """A function of a frame's lower-cased texts and line numbers that gives a source per text, as ``resolve_sources`` says.

    The grams of a frame are scored once, in bulk, for each line and for the frame.  Texts with one number are one line.  The
    profile, checked to be small, goes to each task once.
    """
    names, n = profile.langs, profile.n
    rows = profile.grams.select("g", *[f"lp_{i}" for i in range(len(names))]).toArrow()
    scores = np.stack([rows[f"lp_{i}"].to_numpy() for i in range(len(names))], 1)
    model = profile.grams.sparkSession.sparkContext.broadcast(GramScores(rows["g"].to_pylist(), scores, n))
    # Of equal scores the larger code wins.
    order = sorted(range(len(names)), key=lambda i: names[i], reverse=True)

    def summed(by: np.ndarray, size: int, k: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(by, k, size), np.stack([np.bincount(by, c, size) for c in sums.T], 1)

    def best(k: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``order`` of the top language, -1 where no gram is known, and how sure it is."""
        s = sums[:, order] / np.sqrt(np.maximum(k, 1))[:, None]
        top = s.argmax(axis=1)
        sure = 1 / np.exp(s - s[np.arange(len(s)), top][:, None]).sum(axis=1)
        return np.where(k > 0, top, -1), sure

    @F.arrow_udf("array<string>")
    def find(frames: pa.Array, numbers: pa.Array) -> pa.Array:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(frames), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        texts = frames.flatten().to_pylist()
        lines = list(texts)
        for first, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            tail = ""  # the first characters of what follows in the frame
            for i in range(end - 1, first - 1, -1):
                if texts[i] is not None:
                    if i < end - 1:
                        lines[i] = f"{texts[i]}\n{tail}"
                    tail = lines[i][: n - 1]
        own = np.array([len(x or "") for x in texts], np.int64)
        k, s, fk, fs = model.value.sums(pa.array(lines, pa.large_string()), own, np.repeat(sizes == 1, sizes))
        frame = np.repeat(np.arange(len(sizes)), sizes)
        number = np.asarray(pc.fill_null(numbers.flatten(), -1)).astype(np.int64)
        same = np.flatnonzero((frame[1:] == frame[:-1]) & (number[1:] == number[:-1])) + 1  # they come in order
        line = np.cumsum(~np.isin(np.arange(len(frame)), same)) - 1
        if len(same):
            k, s = (x[line] for x in summed(line, int(line[-1]) + 1, k, s))
        lang, sure = best(k, s)
        whole, _ = best(*summed(frame, len(sizes), fk, fs))
        codes = np.array([*[names[i] for i in order], DEFAULT_SOURCE], object)
        found = np.where((lang >= 0) & (sure >= min_conf), lang, whole[frame])
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes[found].tolist(), pa.string()))

    return find


def _by_frame(lines: DataFrame, profile: Profile, min_conf: float, out: str, tasks: int) -> DataFrame:
    """``resolve_sources`` with a small profile: a frame is brought together as one row, and its lines go on from there."""
    others = [c for c in lines.columns if c not in LINE]
    row = F.struct(F.col("line_no").alias("n"), F.struct(*others).alias("v"))
    whole = lines.repartition(tasks, *FRAME).groupBy(*FRAME).agg(F.collect_list(row).alias("__r"))
    by_number = lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).when(a["n"].isNull() == b["n"].isNull(), 0).when(a["n"].isNull(), -1).otherwise(1)
    whole = whole.select(*FRAME, F.array_sort("__r", by_number).alias("__r"))
    texts, numbers = F.transform("__r", lambda r: F.lower(r["v"]["text"])), F.transform("__r", lambda r: r["n"].cast("long"))
    found = whole.select(*FRAME, "__r", frame_sources(profile, min_conf)(texts, numbers).alias("__s"))
    each = found.select(*FRAME, F.explode(F.arrays_zip("__r", "__s")).alias("__l"))
    source = F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in (*FRAME, "__l.__r.n")]), lambda x: x), F.col("__l.__s"))
    return each.select(
        *FRAME, F.col("__l.__r.n").alias("line_no"), "__l.__r.v.*", F.coalesce(source, F.lit(DEFAULT_SOURCE)).alias(out)
    ).select(*LINE, *others, out)


def resolve_sources(
    lines: DataFrame,
    configured: str = AUTO,
    profile: Profile | None = None,
    min_conf: float = LINE_CONFIDENCE,
    out: str = "source",
    checkpoint: bool = False,
) -> DataFrame:
    """Add each line's source language.

    A configured language holds for all lines.  Under ``auto`` it is the line's own language where
    that is sure enough, else the language of the whole frame, else the default.

    Line and frame are scored in one pass: every gram of the joined frame text belongs to the line
    it starts in, and counts for the line too when it ends there.  So the grams are made and
    looked up once, in the task that holds the frame.  With a profile small enough to broadcast a frame's lines come together as one
    row, with all that they have, so they are shuffled once and nothing is joined back to them.  A profile too large to broadcast gets each distinct gram of a line once, with its
    count, and what is found is joined to the lines.  ``checkpoint`` does that too and writes the found languages (no
    texts) once, for plans that use the result more than once.
    """
    if configured != AUTO:
        return lines.withColumn(out, F.lit(configured))
    if profile is None:
        raise ValueError("auto needs a language profile")
    n, langs = profile.n, profile.langs
    by_frame = Window.partitionBy(*FRAME).orderBy("line_no")
    whole = Window.partitionBy(*FRAME)

    # The shuffle of the texts.  Its width is set: making grams costs far more than its bytes let on, so it
    # must not be merged into fewer tasks.
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if profile.small and not checkpoint:
        return _by_frame(lines, profile, min_conf, out, tasks)
    x = lines.select(*LINE, F.lower("text").alias("__x")).repartition(tasks, *FRAME)
    head = F.substring("__x", 1, n - 1)
    x = x.select(
        "*",
        F.lead(F.lit(1)).over(by_frame).isNotNull().alias("__more"),
        F.lag(F.lit(1)).over(by_frame).isNull().alias("__first"),
        F.substring(F.concat_ws("\n", *[F.lead(head, j).over(by_frame) for j in range(1, n + 1)]), 1, n - 1).alias("__tail"),
    )
    size = F.length("__x")
    ext = F.when(F.col("__more"), F.concat("__x", F.lit("\n"), "__tail")).otherwise(F.col("__x"))
    only = F.col("__first") & ~F.col("__more")
    x = x.select(*LINE, only.alias("__only"), size.alias("__len"), ext.alias("__ext"), F.col("__x"))
    if profile.small:
        found = _scored(profile, whole=True)(F.col("__ext"), F.coalesce("__len", F.lit(0)), F.col("__only"))
        hit = x.select(*LINE, found.alias("__v")).select(*LINE, "__v.*")
        sums = hit.groupBy(*LINE).agg(
            F.sum("k").alias("__k"),
            F.sum("fk").alias("__fk"),
            *[F.sum(f"s_{i}").alias(f"__s_{i}") for i in range(len(langs))],
            *[F.sum(f"fs_{i}").alias(f"__fs_{i}") for i in range(len(langs))],
        )
    else:
        sums = _looked_up(x, profile)
    whole_sums = {f"__fs_{i}": F.sum(f"__fs_{i}").over(whole) for i in range(len(langs))}
    sums = sums.withColumns({**whole_sums, "__fk": F.sum("__fk").over(whole)})
    best = _pick(_pick(sums, langs, "__s", "__k", "line"), langs, "__fs", "__fk", "frame")
    own = F.when(F.col("line_conf") >= min_conf, F.col("line_lang")) if min_conf > 0 else F.col("line_lang")
    found = best.select(*LINE, F.coalesce(own, F.col("frame_lang"), F.lit(DEFAULT_SOURCE)).alias(out))
    if checkpoint:
        found = materialize(found)
    return lines.join(found, LINE, "left").withColumn(out, F.coalesce(out, F.lit(DEFAULT_SOURCE)))


def maximal_ids(df: DataFrame, likely: DataFrame, code: str = "code", out: str = "maximal") -> DataFrame:
    """Add ``out``: ``maximal_id`` of ``code`` by a table ``likely`` (``tag, full``) of any size, as the whole CLDR data.

    Each distinct code is looked up once per stage; the stage that finds something first counts.  Codes that no stage
    finds, empty and NULL ones stay as they are.
    """
    lang, script, region = subtags(F.col("__code"))
    asked = df.select(F.col(code).alias("__code")).where(F.col(code).isNotNull()).distinct()
    keys = asked.select("__code", F.posexplode(F.array(*stages(lang, script, region))).alias("__stage", "tag"))
    known = lookup_join(keys.where(F.col("tag").isNotNull()), likely.select("tag", "full"), ["tag"], "inner")
    first = known.groupBy("__code").agg(F.min_by("full", "__stage").alias("__full"))
    found = first.select(F.col("__code").alias(code), filled(F.col("__code"), lang, script, region, F.col("__full")).alias(out))
    return lookup_join(df.drop(out), found, [code]).withColumn(out, F.coalesce(out, code))


def language_display_name(df: DataFrame, names: DataFrame, code: str = "code") -> DataFrame:
    """Add ``display``: the name of the language, or ``Auto (detect)``, or the code itself."""
    n = names.select(F.col("code").alias(code), F.col("name").alias("__name"))
    found = lookup_join(df, n, [code])
    return found.withColumn("display", display_name(F.col(code), F.col("__name"))).drop("__name")


def language_catalog(
    translatable: DataFrame, recognisable: DataFrame, names: DataFrame, for_source: bool, code: str = "code"
) -> DataFrame:
    """The languages to choose from: ``pos, code, display``, sorted by name.

    As a source list only those that can be recognised too, with ``auto`` in front.  The sets are
    distinct language ids, a bounded number, before anything is sorted.
    """

    def ids(df: DataFrame) -> DataFrame:
        return df.select(maximal_id(F.col(code)).alias("code")).where((F.col("code") != "") & (F.col("code") != AUTO))

    codes = ids(translatable)
    codes = codes.intersect(ids(recognisable)) if for_source else codes.distinct()
    if for_source:
        codes = codes.unionByName(df_of_auto(codes))
    named = language_display_name(codes, names)
    w = Window.orderBy((F.col("code") != AUTO), F.collate("display", "UNICODE"), "code")
    return named.select(F.row_number().over(w).alias("pos"), "code", "display")


def df_of_auto(like: DataFrame) -> DataFrame:
    return like.sparkSession.range(1).select(F.lit(AUTO).alias("code"))
