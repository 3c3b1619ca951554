"""Exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_stamped(df: DataFrame, now: str, prefix: str, out_col: str = "name") -> DataFrame:
    """Add the export name ``prefix-yyyy-MM-dd-HHmmss`` of the time in column ``now``."""
    return df.withColumn(out_col, F.concat(F.lit(prefix + "-"), F.date_format(now, "yyyy-MM-dd-HHmmss")))


def write_stamped(df: DataFrame, path: str, now: str, prefix: str, day_col: str = "day") -> None:
    """Write the stamped rows, one folder per day.

    Partitioned by day and not by name: a name per second would make a file per second.
    """
    (
        export_stamped(df, now, prefix)
        .withColumn(day_col, F.to_date(now))
        .write.mode("append")
        .partitionBy(day_col)
        .parquet(path)
    )
