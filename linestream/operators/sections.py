"""Sections of a text under its headings, and their anchor names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestream.functions.text import SCRIPT_SPACE, slug, trim_script_space
from linestream.scale import Split, running

HEADING = rf"^##{SCRIPT_SPACE}+(.+?){SCRIPT_SPACE}*$"
DATED = rf"^(.+?){SCRIPT_SPACE}+\(([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\)$"


def split_sections(
    lines: DataFrame,
    heading_re: str = HEADING,
    key: str = "doc_id",
    order: str = "line_no",
    text: str = "text",
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per heading line: ``key, section_no, title, date, body``.

    Lines ahead of the first heading are left out; a head without a date has the date ``''``.
    """
    src = lines.select(key, order, text).withColumn("__head", F.regexp_extract(text, heading_re, 1))
    src = src.withColumn("__is", F.col("__head") != "")
    split = Split.of(src, [key], [order], hot_rows)
    num = running(src, split, sums={"section_no": F.col("__is").cast("int")}).where(F.col("section_no") > 0)
    body = F.array_sort(
        F.collect_list(F.when(~F.col("__is"), F.struct(F.col(order).alias("o"), F.col(text).alias("v"))))
    )
    out = num.groupBy(key, "section_no").agg(
        F.max(F.when(F.col("__is"), F.col("__head"))).alias("__head"),
        F.array_join(F.transform(body, lambda r: r["v"]), "\n").alias("__body"),
    )
    dated = F.col("__head").rlike(DATED)
    return out.select(
        key,
        "section_no",
        trim_script_space(F.when(dated, F.regexp_extract("__head", DATED, 1)).otherwise(F.col("__head"))).alias("title"),
        F.when(dated, F.regexp_extract("__head", DATED, 2)).otherwise("").alias("date"),
        trim_script_space(F.col("__body")).alias("body"),
    )


def unique_slugs(
    sections: DataFrame,
    key: str = "doc_id",
    order: str = "section_no",
    title: str = "title",
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``slug``: the anchor name, with ``-1``, ``-2`` ... for repeats in one document."""
    src = sections.withColumn("__slug", slug(F.col(title)))
    split = Split.of(src, [key, "__slug"], [order], hot_rows)
    num = running(src, split, sums={"__k": F.lit(1)})
    again = F.concat(F.col("__slug"), F.lit("-"), (F.col("__k") - 1).cast("string"))
    return num.withColumn("slug", F.when(F.col("__k") == 1, F.col("__slug")).otherwise(again)).drop("__slug", "__k")
