"""List-driven operators: rows in or not in a list, renames, first matches, numbered look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def include(rows: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(listed, on, "left_semi")


def exclude(rows: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(listed, on, "left_anti")


def not_found(listed: DataFrame, rows: DataFrame, on: str | list[str]) -> DataFrame:
    """Listed values that no row has."""
    return listed.join(rows, on, "left_anti").distinct()


def rename_inner(rows: DataFrame, names: DataFrame, on: str, new: str) -> DataFrame:
    """Values replaced by the list's new names; rows without one are dropped."""
    return rows.join(names, on).drop(on).withColumnRenamed(new, on)


def rename_left(rows: DataFrame, names: DataFrame, on: str, new: str) -> DataFrame:
    """Values replaced where the list has a new name."""
    return rows.join(names, on, "left").withColumn(on, F.coalesce(F.col(new), F.col(on))).drop(new)


def label_or(rows: DataFrame, labels: DataFrame, on: str, label: str, default: str) -> DataFrame:
    """Rows with their label, or the default."""
    return rows.join(labels, on, "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def include_with_least(rows: DataFrame, listed: DataFrame, on: str, group: str, least: int) -> DataFrame:
    """Listed rows of the groups that keep ``least`` of them."""
    kept = include(rows, listed, on)
    enough = kept.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(group)
    return kept.join(enough, group, "left_semi")


def first_per(rows: DataFrame, group: str | list[str], order: str) -> DataFrame:
    """The first row of each group in file order."""
    keys = [group] if isinstance(group, str) else group
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_first"))
    return first.select(*keys, "_first.*")


def single_hits(rows: DataFrame, query: str) -> DataFrame:
    """Rows of queries that hit once."""
    once = rows.groupBy(query).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(query)
    return rows.join(once, query, "left_semi")


def runs(rows: DataFrame, value: str, order: str, within: str) -> DataFrame:
    """Contiguous runs of equal values in file order, numbered from 1 in each ``within``."""
    w = Window.partitionBy(within).orderBy(order)
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).drop("_new")
