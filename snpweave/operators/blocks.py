"""Operators that depend on order: blocks of neighbouring sites, picks, spacing, orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_chrom():
    return Window.partitionBy("chrom").orderBy("pos")


def snp_blocks(sites: DataFrame, distance: int, *, inclusive: bool = True) -> DataFrame:
    """``block``: sites of a chromosome, numbered from 1, a new one where the gap to the site before reaches ``distance``
    (exceeds it if not ``inclusive``)."""
    gap = F.col("pos") - F.lag("pos").over(by_chrom())
    new = F.coalesce(((gap >= distance) if inclusive else (gap > distance)).cast("int"), F.lit(1))
    return sites.withColumn("_new", new).withColumn("block", F.sum("_new").over(by_chrom()).cast("long")).drop("_new")


def random_order(seed: Column | int) -> Column:
    """A reproducible order of sites: the md5 of place and seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string"), seed.cast("string")))


def single_snp(sites: DataFrame, distance: int, seed: int) -> DataFrame:
    """One site of each block, by chance that the seed fixes."""
    blocks = snp_blocks(sites, distance)
    return blocks.groupBy("chrom", "block").agg(F.min_by("pos", random_order(seed)).alias("pos"))


def replicate_snps(sites: DataFrame, distance: int, replicates: int) -> DataFrame:
    """One site of each block for each replicate from 0; a block begins where the gap exceeds the distance."""
    blocks = snp_blocks(sites, distance, inclusive=False)
    many = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return many.groupBy("replicate", "chrom", "block").agg(F.min_by("pos", random_order(F.col("replicate"))).alias("pos"))


def greedy_spacing(sites: DataFrame, spacing: int) -> DataFrame:
    """``included``: in order of position, a site that lies ``spacing`` or more behind the last included one (the first: behind 0).

    A fold over a chromosome's positions; only positions are gathered.
    """
    begin = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<struct<pos:bigint,included:boolean>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        take = p - acc["last"] >= spacing
        return F.struct(F.when(take, p).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.struct(p.alias("pos"), take.alias("included")))).alias("out"))

    folded = sites.groupBy("chrom").agg(F.array_sort(F.collect_list("pos")).alias("all"))
    return folded.select("chrom", F.inline(F.aggregate("all", begin, step, lambda acc: acc["out"])))


def oriented_order(rows: DataFrame, scaffold: str, order: str, forward: Column) -> DataFrame:
    """``place`` of a scaffold's rows: counted up on the forward strand, down on the reverse."""
    w = Window.partitionBy(scaffold)
    up = F.row_number().over(w.orderBy(order))
    down = F.row_number().over(w.orderBy(F.desc(order)))
    return rows.withColumn("place", F.when(forward, up).otherwise(down).cast("long"))


def letters(rows: DataFrame, locus: str, order: str) -> DataFrame:
    """``letter`` a, b, c ... of a locus' rows in order; an error beyond 26."""
    n = F.row_number().over(Window.partitionBy(locus).orderBy(order))
    return rows.withColumn("letter", F.when(n <= 26, F.char(96 + n)).otherwise(F.raise_error(F.lit("more than 26 in a locus"))))
