"""A genotype table, and tables that go with it, derived from the shared star schema by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of sites, and of chromosomes they lie on.
SITES, CHROMOSOMES = 200, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """``(ind, pop, grp)``: suppliers, their nation as population and its region as group."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pop"), F.col("n_regionkey").cast("long").alias("grp"))
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ind"), F.col("s_nationkey").cast("long").alias("pop"))
    return suppliers.join(F.broadcast(nations), "pop").select("ind", "pop", "grp")  # nation has a fixed number of rows


def place(m):
    """Chromosome and position of the m-th site."""
    return (m % CHROMOSOMES).alias("chrom"), (1 + 1500 * F.floor(m / CHROMOSOMES) + 13 * ((m * m) % 97)).cast("long").alias("pos")


def sites(spark: SparkSession) -> DataFrame:
    """``(m, chrom, pos)``."""
    m = F.col("id")
    return spark.range(SITES).select(m.alias("m"), *place(m))


def genotypes(spark: SparkSession, d: str) -> DataFrame:
    """``(ind, pop, grp, m, chrom, pos, a1, a2)``: one row a call; an absent row is a missing call."""
    site = (F.col("l_partkey") % SITES).alias("m")
    cell = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ind"), site).agg(
        (F.sum(F.col("l_orderkey") + 7 * F.col("l_linenumber")) % 100).alias("h1"), (F.sum(3 * F.col("l_orderkey") + F.col("l_linenumber")) % 100).alias("h2")
    )
    cut = (F.col("m") * 37 + F.col("grp") * 29) % 101
    m = F.col("m")
    called = cell.join(samples(spark, d), "ind")
    return called.select("ind", "pop", "grp", "m", *place(m), (F.col("h1") < cut).cast("int").alias("a1"), (F.col("h2") < cut).cast("int").alias("a2"))


def with_clones(g: DataFrame) -> DataFrame:
    """``g`` with a copy of every tenth sample, which lacks every 25th site."""
    copies = g.where("ind % 10 = 0 AND m % 25 <> 0").withColumn("ind", F.col("ind") + 100000)
    return g.unionByName(copies)
