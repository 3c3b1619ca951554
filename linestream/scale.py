"""Size checks and ordered scans over hot keys, shared by every operator.

Rules kept here so that the operators can stay declarative:

* a side is broadcast only after its row and byte count was checked (``fits``);
* joins (``lookup_join``) leave hot keys to adaptive execution, which splits skewed partitions;
* ordered scans cannot be split by it: they cut a hot key into chunks whose results are
  chained (``Split`` with ``running``, ``runs`` and ``flag``);
* nothing is dropped or sampled: the hot and the cold way give the same rows.

Hot keys are found by one exact, map-side combined count.  A chunk aims at ``max(hot_rows, 1 / PARTS of
the hot rows)``, so at most about ``PARTS`` cuts exist at any size; by counting, each key left whole has
fewer rows than that or fewer than ``1 / PARTS`` of all rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000
PARTS = 20_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_CHUNK = "__chunk"
#: Rows looked at per chunk to find where to cut.
_LOOKS = 64


def fits(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """True when ``df`` is proven to have at most ``max_rows`` rows and ``max_bytes`` bytes.

    Reads at most ``max_rows + 1`` rows, and only counts them: a row goes to the count as its size alone.
    """
    if df.isStreaming:
        return False
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 16
        else:
            size = size + 16
    row = (
        df.select(size.alias("__size"))
        .limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("b"))
        .first()
    )
    return row["n"] <= max_rows and row["b"] <= max_bytes


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """Hashes and row counts of the keys to cut, and the rows a chunk of them aims at.

    The driver gets the largest ``PARTS`` keys of more than ``hot_rows`` rows at most.  Two keys with one
    hash are counted together, which at worst cuts a key that did not need it.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    found = (
        df.select(_key_hash(keys).alias("h"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > hot_rows)
        .orderBy(F.desc("n"), "h")
        .limit(PARTS)
        .collect()
    )
    aim = max(hot_rows, -(-sum(r["n"] for r in found) // PARTS))
    return [(r["h"], r["n"]) for r in found if r["n"] > aim], aim


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", *, small: bool | None = None) -> DataFrame:
    """Join to a table with at most one row per key.

    ``right`` is broadcast when its checked size allows it.  Else it is a shuffle join; adaptive execution splits
    the partitions of hot left keys, and the left side is worked out once.
    """
    if small is None:
        small = fits(right)
    return left.join(F.broadcast(right) if small else right, on, how)


@dataclass(frozen=True)
class Split:
    """How the rows of one key are ordered, and where its hot keys are cut.

    ``cuts``: a row ``(__h, __cuts)`` per hot key, its cuts being rows of it in the whole order, so that a key whose
    rows share their first order column is cut too.  ``most`` is the largest number of cuts of a key.
    """

    keys: list[str]
    order: list[str]
    cuts: DataFrame | None = None
    most: int = 0

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[str], hot_rows: int | None = None) -> "Split":
        """Count the keys; where some are hot, cut them at every so many rows picked by a hash.

        About ``_LOOKS`` rows are picked per chunk, by their values alone, so every run cuts alike.  The picked
        rows of a key are put in order in one task: at most ``PARTS * _LOOKS`` of them, at any size.
        """
        hot, aim = hot_keys(df, keys, hot_rows)
        if not hot:
            return Split(keys, order)
        step = max(1, aim // _LOOKS)
        names = df.sparkSession.createDataFrame([(h,) for h, _ in hot], "__h long")
        at = F.struct(*[F.col(c) for c in order])
        rows = df.select(_key_hash(keys).alias("__h"), at.alias("__at")).where(
            F.pmod(F.xxhash64(F.lit(step), "__h", "__at"), F.lit(step)) == 0
        )
        place = F.row_number().over(Window.partitionBy("__h").orderBy("__at"))
        picked = rows.join(F.broadcast(names), "__h").withColumn("__n", place).where(F.col("__n") % max(1, aim // step) == 0)
        cuts = materialize(picked.groupBy("__h").agg(F.sort_array(F.collect_list("__at")).alias("__cuts")))
        most = cuts.agg(F.max(F.size("__cuts"))).first()[0]
        return Split(keys, order, cuts, most) if most else Split(keys, order)

    def chunked(self, df: DataFrame) -> DataFrame:
        """``df`` with the chunk number of each row: 0 and up within hot keys, -1 for the rows of all others.

        The cuts (at most about ``PARTS``, however large the table) are broadcast; a row finds its place among those of
        its key by halving.
        """
        at = F.struct(*[F.col(c) for c in self.order])
        halves = F.array(*[F.lit(1 << i) for i in reversed(range(self.most.bit_length()))])
        below = lambda low, half: F.when(F.try_element_at("__cuts", low + half) <= at, low + half).otherwise(low)
        chunk = F.when(F.col("__cuts").isNull(), -1).otherwise(F.aggregate(halves, F.lit(0), below))
        found = df.withColumn("__h", _key_hash(self.keys)).join(F.broadcast(self.cuts), "__h", "left")
        return found.select(*[F.col(c) for c in df.columns], chunk.alias(_CHUNK))


def running(
    df: DataFrame,
    split: Split,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
) -> DataFrame:
    """Ordered scans per key that survive a key with a third of all rows.

    ``sums``: running sum with the current row.  ``lasts``: last non-null value up to
    the current row.  ``lags`` / ``leads``: the value one row back / ahead.  The order
    must be total within a key.

    Without hot keys this is one window.  With them, rows of a hot key are scanned chunk
    by chunk in parallel, one summary row per (hot key, chunk) is scanned in turn,
    and its result is joined back as the start value of the chunk.
    """
    sums, lasts, lags, leads = sums or {}, lasts or {}, lags or {}, leads or {}
    cut, src, part, w, upto = _windows(df, split)
    # A struct keeps "there is a row, its value is NULL" apart from "there is no row".
    cols = {n: F.sum(e).over(upto) for n, e in sums.items()}
    cols |= {n: F.last(e, ignorenulls=True).over(upto) for n, e in lasts.items()}
    if not cut:
        cols |= {n: F.lag(e).over(w) for n, e in lags.items()}
        cols |= {n: F.lead(e).over(w) for n, e in leads.items()}
        return src.withColumns(cols)
    cols |= {n: F.lag(F.struct(e.alias("v"))).over(w) for n, e in lags.items()}
    cols |= {n: F.lead(F.struct(e.alias("v"))).over(w) for n, e in leads.items()}

    pos = F.struct(*split.order)
    aggs = [F.sum(e).alias(n) for n, e in sums.items()]
    aggs += [F.max_by(F.when(e.isNotNull(), F.struct(e.alias("v"))), F.when(e.isNotNull(), pos)).alias(n) for n, e in lasts.items()]
    aggs += [F.max_by(F.struct(e.alias("v")), pos).alias(n) for n, e in lags.items()]
    aggs += [F.min_by(F.struct(e.alias("v")), pos).alias(n) for n, e in leads.items()]
    per_chunk = src.where(_is_hot()).groupBy(*part).agg(*aggs)
    ws, before = _chunk_windows(split)
    carry = per_chunk.select(
        *_chunk_keys(part),
        *[F.sum(n).over(before).alias(f"__c_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts],
        *[F.lag(n).over(ws).alias(f"__c_{n}") for n in lags],
        *[F.lead(n).over(ws).alias(f"__c_{n}") for n in leads],
    )
    local = src.withColumns(cols)
    out = {}
    for n in sums:
        out[n] = F.when(F.col(f"__c_{n}").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"__c_{n}")).otherwise(
            F.col(n) + F.col(f"__c_{n}")
        )
    for n in lasts:
        out[n] = F.coalesce(F.col(n), F.col(f"__c_{n}")["v"])
    for n in [*lags, *leads]:
        out[n] = F.coalesce(F.col(n), F.col(f"__c_{n}"))["v"]
    return _with_carry(local, carry, part, out)


def _with_carry(local: DataFrame, carry: DataFrame, part: list[str], out: dict[str, Column]) -> DataFrame:
    """Join each chunk's start values (keyed ``__key0, ...``) to its rows; ``out`` says what they make of them.

    There is one row per chunk of a hot key, so adaptive execution broadcasts it by its true size.
    """
    cond = None
    for i, c in enumerate(part):
        eq = F.col(c).eqNullSafe(F.col(f"__key{i}"))
        cond = eq if cond is None else cond & eq
    joined = local.join(carry, cond, "left")
    keep = [F.col(c) for c in local.columns if c != _CHUNK and c not in out and not c.startswith("__l_")]
    return joined.select(*keep, *[e.alias(n) for n, e in out.items()])


def _is_hot() -> Column:
    return F.col(_CHUNK) >= 0


def _windows(df: DataFrame, split: Split):
    """The table with its chunk numbers, the window columns, and the two windows of an ordered scan."""
    cut = split.cuts is not None
    src = split.chunked(df) if cut else df
    part = split.keys + ([_CHUNK] if cut else [])
    w = Window.partitionBy(*part).orderBy(*split.order)
    return cut, src, part, w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _chunk_windows(split: Split):
    ws = Window.partitionBy(*split.keys).orderBy(_CHUNK)
    return ws, ws.rowsBetween(Window.unboundedPreceding, -1)


def _chunk_keys(part: list[str]) -> list[Column]:
    return [F.col(c).alias(f"__key{i}") for i, c in enumerate(part)]


def runs(df: DataFrame, split: Split, out: str, look: Column, opens: Callable[[Column, Column], Column], value: Column) -> DataFrame:
    """Add ``out``: ``value`` of the row that opened the run a row is in.

    ``opens(before, here)`` says from ``look`` of the row before and of this row whether a run opens; the
    first row of a key always opens one.  ``value`` must not be NULL.  One scan: in a chunk of a hot key only
    the leading run is open to what came before, and that is settled between the chunks.
    """
    cut, src, part, w, upto = _windows(df, split)
    src = src.withColumns({"__l_before": F.lag(F.struct(look.alias("v"))).over(w)})
    begins = opens(F.col("__l_before")["v"], look)
    if not cut:
        begins = F.col("__l_before").isNull() | begins
        return src.withColumn(out, F.last(F.when(begins, value), ignorenulls=True).over(upto)).drop("__l_before")
    is_hot = _is_hot()
    # The first row of a chunk waits for what came before it; the first row of a cold key opens.
    begins = F.when(F.col("__l_before").isNull(), ~is_hot).otherwise(begins)
    local = src.withColumns(
        {
            "__l_run": F.last(F.when(begins, value), ignorenulls=True).over(upto),
            "__l_look": look,
            "__l_value": value,
        }
    )
    pos = F.struct(*split.order)
    per_chunk = local.where(is_hot).groupBy(*part).agg(
        F.min_by(F.struct("__l_look", "__l_value"), pos).alias("__first"),
        F.max_by(F.struct("__l_look", "__l_run"), pos).alias("__last"),
    )
    ws, before = _chunk_windows(split)
    per_chunk = per_chunk.withColumn("__was", F.lag("__last").over(ws))
    opened = F.col("__was").isNull() | opens(F.col("__was.__l_look"), F.col("__first.__l_look"))
    per_chunk = per_chunk.withColumn("__opened", F.when(opened, F.col("__first.__l_value")))
    carry = per_chunk.select(
        *_chunk_keys(part),
        F.coalesce(
            "__opened", F.last(F.coalesce("__last.__l_run", "__opened"), ignorenulls=True).over(before)
        ).alias("__c_run"),
    )
    return _with_carry(local, carry, part, {out: F.coalesce("__l_run", "__c_run")})


def flag(df: DataFrame, split: Split, out: str, set_to: Column, flips: Column) -> DataFrame:
    """Add ``out`` (0 / 1, at first 0): some rows set it (``set_to`` not NULL), others flip it.

    The value last set, turned by the parity of the flips since.  One scan, also over chunks: the
    flips since the last set are counted within the chunk, and a chunk without a set turns the
    value it starts with.
    """
    cut, src, part, w, upto = _windows(df, split)
    local = src.withColumn("__l_flips", F.sum(F.coalesce(flips.cast("int"), F.lit(0))).over(upto))
    local = local.withColumn(
        "__l_base", F.last(F.when(set_to.isNotNull(), (set_to + F.col("__l_flips")) % 2), ignorenulls=True).over(upto)
    )
    value = lambda base: ((base + F.col("__l_flips")) % 2).cast("int")
    if not cut:
        return local.withColumn(out, value(F.coalesce("__l_base", F.lit(0)))).drop("__l_flips", "__l_base")
    per_chunk = local.where(_is_hot()).groupBy(*part).agg(
        F.max_by(F.struct("__l_flips", "__l_base"), F.struct(*split.order)).alias("__end")
    )
    _, before = _chunk_windows(split)
    # Over the chunks: one that sets leaves its own end value, one that does not turns what it got.
    per_chunk = per_chunk.withColumns(
        {
            "__turns": F.coalesce(F.sum("__end.__l_flips").over(before), F.lit(0)),
            "__upto": F.sum("__end.__l_flips").over(before.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    left = F.when(
        F.col("__end.__l_base").isNotNull(), (F.col("__end.__l_base") + F.col("__end.__l_flips") + F.col("__upto")) % 2
    )
    per_chunk = per_chunk.withColumn("__left", left)
    start = (F.coalesce(F.last("__left", ignorenulls=True).over(before), F.lit(0)) + F.col("__turns")) % 2
    carry = per_chunk.select(*_chunk_keys(part), start.alias("__c_start"))
    return _with_carry(
        local, carry, part, {out: value(F.coalesce("__l_base", "__c_start", F.lit(0)))}
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path that all executors share, under the cluster's ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="linestream-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once, compressed by columns, to the shared checkpoint folder, and go on from what was written.

    Cuts the lineage.  Used where a plan would otherwise run twice an expensive or non-repeatable step.
    """
    path = shared_dir(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_read(df: DataFrame) -> bool:
    """True when ``df`` is rows of a table as they are read, picked and worked on one by one: nothing is gained by writing it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        if "python" in str(plan.simpleString(1000)).lower():
            return False
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")
