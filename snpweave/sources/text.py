"""Text files as numbered lines, and blocks of lines, without gathering a file anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, ord, value)``: lines numbered from 1 in each file's order.

    Splits of a file are put in order by their first byte; a split's lines keep theirs.
    One count a split reaches the driver.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    read = read.withColumn("_id", F.monotonically_increasing_id())
    counts = read.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).orderBy("file", "_start").collect()
    base, at, last = [], 0, None
    for r in counts:
        at = 0 if r.file != last else at
        base.append((r.file, r["_start"], at - r["first"] + 1))
        at, last = at + r.n, r.file
    if not base:
        return read.select("file", F.lit(0).cast("long").alias("ord"), "value")
    offsets = F.broadcast(spark.createDataFrame(base, "file string, _start long, _shift long"))  # one row a split
    return read.join(offsets, ["file", "_start"]).select("file", (F.col("_id") + F.col("_shift")).alias("ord"), "value")


def blocks(numbered: DataFrame, starts: Column, *, name: str = "block") -> DataFrame:
    """``block``: how many lines that start a block lie at or before a line of its file.

    Starts are counted in stretches of lines first, so no task orders a whole file.
    """
    size = 100_000
    marked = numbered.withColumn("_new", starts.cast("long")).withColumn("_stretch", F.floor((F.col("ord") - 1) / size))
    per = marked.groupBy("file", "_stretch").agg(F.sum("_new").alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum("_new").over(Window.partitionBy("file", "_stretch").orderBy("ord"))
    return marked.withColumn("_in", inside).join(before, ["file", "_stretch"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_new", "_stretch", "_in", "_before")


def fields(value: Column, sep: str = r"\s+") -> Column:
    return F.split(F.trim(value), sep)


def write_lines(rows: DataFrame, line: Column, order: list[str], path: str, *, single: bool = True) -> None:
    """Lines in order, as one file or as files whose names are in order."""
    ordered = rows.select(line.alias("value"), *order).orderBy(*order).select("value")
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").text(path)
