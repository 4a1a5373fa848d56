"""Renaming files by barcodes: a plan as a table, and its execution on the driver, opt-in."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Units of sizes by powers of 1024.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def human_size(n: Column, last: str = "TiB") -> Column:
    """Bytes with one decimal (half to even) and a power-of-1024 unit; all that is larger is given in the ``last`` unit."""
    top = UNITS.index(last)
    out = F.format_string("%3.1f%s", F.bround(n / F.lit(1024.0**top), 1), F.lit(last))
    for k, unit in reversed([*enumerate(UNITS[:top])]):
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), F.format_string("%3.1f%s", F.bround(n / F.lit(1024.0**k), 1), F.lit(unit))).otherwise(out)
    return out


def rename_plan(spark: SparkSession, folder: str, barcodes: DataFrame) -> DataFrame:
    """``(path, new_path, size)`` of files whose name contains a barcode of ``(barcode, name)``."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:", "").alias("path"), "length")
    base = F.element_at(F.split("path", "/"), -1)
    met = files.join(F.broadcast(barcodes), F.contains(base, F.col("barcode")))  # the barcode list is one sequencing lane's
    return met.select("path", F.concat(F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/'), -1)))"), F.replace(base, F.col("barcode"), F.col("name"))).alias("new_path"), human_size(F.col("length")).alias("size"))


def rename_files(plan: DataFrame, *, really: bool = False) -> list[tuple[str, str]]:
    """The renames; they happen only if ``really``."""
    todo = [(r.path, r.new_path) for r in plan.collect()]  # a folder's files
    if really:
        for old, new in todo:
            os.rename(old, new)
    return todo
