"""Line tables from storage and from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linestream.schema import LINES


def read_lines(spark: SparkSession, path: str, streaming: bool = False, schema=LINES) -> DataFrame:
    """The line table, as a batch or as a stream of new files.

    A stream watches a folder; given a single file, it watches its folder for files of that name.
    """
    if not streaming:
        return spark.read.schema(schema).parquet(path)
    reader = spark.readStream.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where) and not fs.getFileStatus(where).isDirectory():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table over all cores when it is too small for its scan to do so.

    A scan makes one task per ``spark.sql.files.maxPartitionBytes``.  A table with fewer bytes
    than that per core would leave cores idle through all of its text work, and moving it costs
    little.  A larger one is left as it is: its texts never move for this.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    told = spark.conf.get("spark.sql.files.maxPartitionBytes")  # with or without a unit
    per_task = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told)
    return df.repartition(cores, *keys) if size < cores * per_task else df


def lines_from_text(
    df: DataFrame, id_cols: list[str], text_col: str = "text", line_col: str = "line_no", out_col: str = "text"
) -> DataFrame:
    """One row per line of ``text_col``, empty lines kept, numbered from 0.

    The inverse of ``assemble_original`` on texts without blank lines at the ends.
    """
    return df.select(*id_cols, F.posexplode(F.split(text_col, "\n", -1)).alias(line_col, out_col))
