"""Genotypes in the layouts of downstream programs, one text row a sample or site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import coded, dosage, structure_code


def dose_of() -> Column:
    return dosage(F.col("a1"), F.col("a2"))


def dense(g: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """Every sample at every site, with NULL alleles where there is no call: the size of what is written."""
    return samples.crossJoin(sites).join(g.select("ind", "chrom", "pos", "a1", "a2"), ["ind", "chrom", "pos"], "left")


def joined(order: list[str], value: Column, sep: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return F.array_join(F.transform(ordered, lambda x: x.v), sep)


def sample_rows(full: DataFrame, missing: str, sep: str = " ") -> DataFrame:
    """``(ind, line)``: a sample's dosages in order of the sites."""
    return full.groupBy("ind").agg(joined(["chrom", "pos"], coded(dose_of(), missing), sep).alias("line"))


def site_rows(full: DataFrame, cell: Column, sep: str = " ") -> DataFrame:
    """``(chrom, pos, line)``: a site's cells in order of the samples."""
    return full.groupBy("chrom", "pos").agg(joined(["ind"], cell, sep).alias("line"))


def introgress_cell() -> Column:
    """``a/b``, NA/NA for a missing call."""
    return F.when(F.col("a1").isNull() | F.col("a2").isNull(), "NA/NA").otherwise(F.concat_ws("/", F.col("a1").cast("string"), F.col("a2").cast("string")))


def structure_rows(full: DataFrame, ref: Column, alt: Column) -> DataFrame:
    """``(ind, hap, line)``: two rows a sample of base codes, -9 for missing."""
    code = lambda a: structure_code(F.when(F.col(a) == 0, ref).when(F.col(a) == 1, alt))
    two = full.select("ind", "chrom", "pos", F.inline(F.array(*[F.struct(F.lit(h).alias("hap"), code(a).cast("string").alias("c")) for h, a in ((1, "a1"), (2, "a2"))])))
    return two.groupBy("ind", "hap").agg(joined(["chrom", "pos"], F.col("c"), " ").alias("line"))


def haplotypes(g: DataFrame, samples: DataFrame, sites: DataFrame, ref: Column, alt: Column) -> DataFrame:
    """``(ind, chrom, tag)`` for every sample and chromosome: the bases of all the chromosome's sites on both sides, as
    ``left/right``; empty where a call is missing."""
    base = lambda a: F.when(F.col(a) == 0, ref).otherwise(alt)
    sides = g.where("a1 IS NOT NULL AND a2 IS NOT NULL").groupBy("ind", "chrom").agg(F.count(F.lit(1)).alias("called"), joined(["pos"], base("a1"), "").alias("l"), joined(["pos"], base("a2"), "").alias("r"))
    spine = samples.select("ind").crossJoin(sites.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")))  # samples x chromosomes: the size of the result
    whole = F.col("called") == F.col("n")
    return spine.join(sides, ["ind", "chrom"], "left").select("ind", "chrom", F.when(whole, F.concat_ws("/", "l", "r")).otherwise("").alias("tag"))


def ancestry(full: DataFrame, differences: DataFrame, flips: DataFrame, least: float) -> DataFrame:
    """``(marker, ind, dose)`` of the sites whose frequency difference reaches ``least``; doses of flipped sites are turned, missing is -9."""
    chosen = full.join(differences.where(F.col("diff") >= least), ["chrom", "pos"]).join(flips, ["chrom", "pos"], "left")
    dose = F.coalesce(F.when(F.coalesce("flip", F.lit(False)), 2 - dose_of()).otherwise(dose_of()), F.lit(-9))
    return chosen.select(F.concat_ws("_", "chrom", "pos").alias("marker"), "ind", dose.cast("long").alias("dose"))


def ref_alt_flips(g: DataFrame, in_second: Column) -> DataFrame:
    """``(chrom, pos, flip)``: whether the second parent has more homozygous reference than alternative calls."""
    return g.where(in_second).groupBy("chrom", "pos").agg((F.count_if(dose_of() == 0) > F.count_if(dose_of() == 2)).alias("flip"))
