"""Missing data and allele frequencies over a genotype table ``(ind, pop, grp, chrom, pos, a1, a2)``.

A missing call is an absent row or a NULL allele; denominators come from the numbers of
samples and sites, so the full sample-by-site matrix is never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import allele_class, is_called

SITE = ["chrom", "pos"]


def called():
    return is_called(F.col("a1"), F.col("a2"))


def missing_data(g: DataFrame, samples: DataFrame, n_sites: int) -> DataFrame:
    """``(ind, genotyped, missing, total)`` for every sample."""
    counted = g.where(called()).groupBy("ind").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return samples.select("ind").join(counted, "ind", "left").select("ind", n.alias("genotyped"), (F.lit(n_sites) - n).cast("long").alias("missing"), F.lit(n_sites).cast("long").alias("total"))


def genotyped_by_pop(g: DataFrame, samples: DataFrame, sites: DataFrame) -> DataFrame:
    """``(chrom, pos, pop, n_genotyped, pop_size, prop)`` for every site and population, calls or not."""
    sizes = samples.groupBy("pop").agg(F.count(F.lit(1)).alias("pop_size"))
    counted = g.where(called()).groupBy(*SITE, "pop").agg(F.count(F.lit(1)).alias("n"))
    spine = sites.select(*SITE).crossJoin(F.broadcast(sizes))  # sites x populations: the size of the result
    n = F.coalesce("n", F.lit(0)).cast("long")
    out = spine.join(counted, [*SITE, "pop"], "left")
    return out.select(*SITE, "pop", n.alias("n_genotyped"), "pop_size", (n / F.col("pop_size")).alias("prop"))


def minrep(by_pop: DataFrame, *, least_prop: float | None = None, least_count: float | None = None) -> DataFrame:
    """Sites at which every population reaches the proportion or the count."""
    ok = F.col("prop") >= least_prop if least_prop is not None else F.col("n_genotyped") >= least_count
    return by_pop.groupBy(*SITE).agg(F.bool_and(ok).alias("ok"), F.sum("n_genotyped").alias("n_genotyped")).where("ok").select(*SITE, "n_genotyped")


def minrep_summary(by_pop: DataFrame, least_prop: float) -> DataFrame:
    """``(n_failing, n_total, min_prop)``: the smallest overall proportion of a site that stays, 1 if none does."""
    per_site = by_pop.groupBy(*SITE).agg(F.bool_and(F.col("prop") >= least_prop).alias("ok"), (F.sum("n_genotyped") / F.sum("pop_size")).alias("overall"))
    return per_site.agg(F.count_if(~F.col("ok")).alias("n_failing"), F.count(F.lit(1)).alias("n_total"), F.coalesce(F.min(F.when(F.col("ok"), F.col("overall"))), F.lit(1.0)).alias("min_prop"))


def allele_freq(g: DataFrame, group: list[str]) -> DataFrame:
    """Alternative alleles of each site and group: ``alt``, ``n``, ``aaf`` (NULL without a call) and ``x of n``."""
    alt, n = F.sum(F.coalesce("a1", F.lit(0)) + F.coalesce("a2", F.lit(0))), F.count("a1") + F.count("a2")
    sums = g.groupBy(*SITE, *group).agg(alt.cast("long").alias("alt"), n.cast("long").alias("n"))
    aaf = F.when(F.col("n") > 0, F.col("alt") / F.col("n"))
    return sums.select(*SITE, *group, "alt", "n", aaf.alias("aaf"), F.format_string("%d of %d", "alt", "n").alias("said"))


def freq_diff(g: DataFrame, cluster: str, first: object, second: object) -> DataFrame:
    """Absolute difference of two clusters' frequencies at each site, in one pass."""
    def freq(of: object):
        mine = F.col(cluster) == F.lit(of)
        return F.try_divide(F.sum(F.when(mine, F.col("a1") + F.col("a2"))), 2 * F.count_if(mine))

    both = g.where(called() & F.col(cluster).isin(first, second)).groupBy(*SITE).agg(freq(first).alias("p1"), freq(second).alias("p2"))
    return both.where("p1 IS NOT NULL AND p2 IS NOT NULL").select(*SITE, F.abs(F.col("p1") - F.col("p2")).alias("diff"))


def group_differences(g: DataFrame, threshold: float, group: str = "grp", subgroup: str = "pop") -> DataFrame:
    """For each site and pair of groups: the mean difference over all pairs of their subgroups, and whether all reach the threshold."""
    aaf = allele_freq(g, [group, subgroup]).where("aaf IS NOT NULL")
    a = aaf.select(*SITE, F.col(group).alias("g1"), F.col("aaf").alias("p1"))
    b = aaf.select(*SITE, F.col(group).alias("g2"), F.col("aaf").alias("p2"))
    diff = F.abs(F.col("p1") - F.col("p2"))
    pairs = a.join(b, SITE).where("g1 < g2")  # within a site: subgroups squared, fixed by the design
    return pairs.groupBy(*SITE, "g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_afd"), F.bool_and(diff >= threshold).alias("all_above"))


def afd_outliers(differences: DataFrame, n_groups: int) -> DataFrame:
    """``(chrom, pos, label)``: the groups that differ from every other group, as ``AFD_OUTLIER:g1/g2``."""
    flagged = differences.where("all_above").select(*SITE, F.explode(F.array("g1", "g2")).alias("g"))
    against_all = flagged.groupBy(*SITE, "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_groups - 1)
    names = F.array_join(F.array_sort(F.collect_list(F.col("g").cast("string"))), "/")
    return against_all.groupBy(*SITE).agg(F.concat(F.lit("AFD_OUTLIER:"), names).alias("label"))


def classify_groups(g: DataFrame, near: float, group: str = "grp", subgroup: str = "pop") -> DataFrame:
    """Class of each site and group by its subgroups' frequencies."""
    aaf = allele_freq(g, [group, subgroup]).where("aaf IS NOT NULL")
    return aaf.groupBy(*SITE, group).agg(allele_class(F.min("aaf"), F.max("aaf"), near).alias("class"))


def site_labels(classes: DataFrame, group: str = "grp") -> DataFrame:
    """One group (near-)fixed for one allele and all others for the other: ``g: REF_FIXED`` or ``g: ALT_FIXED``, else a dot."""
    ref = F.col("class").isin("REF_FIXED", "REF_NEARFIXED")
    alt = F.col("class").isin("ALT_FIXED", "ALT_NEARFIXED")
    per = classes.groupBy(*SITE).agg(F.count_if(ref).alias("n_ref"), F.count_if(alt).alias("n_alt"), F.count(F.lit(1)).alias("n"), F.max(F.when(ref, F.col(group))).alias("the_ref"), F.max(F.when(alt, F.col(group))).alias("the_alt"))
    said = (
        F.when((F.col("n_ref") == 1) & (F.col("n_alt") == F.col("n") - 1) & (F.col("n") > 1), F.concat(F.col("the_ref").cast("string"), F.lit(": REF_FIXED")))
        .when((F.col("n_alt") == 1) & (F.col("n_ref") == F.col("n") - 1) & (F.col("n") > 1), F.concat(F.col("the_alt").cast("string"), F.lit(": ALT_FIXED"))).otherwise(".")
    )
    return per.select(*SITE, said.alias("label"))


def genotype_counts(g: DataFrame, group: list[str]) -> DataFrame:
    """Three rows a site and group: homozygous reference, heterozygous and homozygous alternative calls."""
    dose = F.col("a1") + F.col("a2")
    counted = g.where(called()).groupBy(*SITE, *group).agg(*[F.count_if(dose == k).alias(n) for k, n in enumerate(("hom_ref", "het", "hom_alt"))])
    return counted.unpivot([*SITE, *group], ["hom_ref", "het", "hom_alt"], "genotype", "n")


def contrast(g: DataFrame, is_reference) -> DataFrame:
    """How many sites are monomorphic in the reference samples, in the others, in both for different alleles, in both for the same."""
    sides = g.where(called()).groupBy(*SITE).agg(*[f(F.when(side, v)).alias(n) for side, s in ((is_reference, "r"), (~is_reference, "o")) for f, v, n in ((F.min, F.least("a1", "a2"), f"{s}_lo"), (F.max, F.greatest("a1", "a2"), f"{s}_hi"))])
    mono_r, mono_o = F.col("r_lo") == F.col("r_hi"), F.col("o_lo") == F.col("o_hi")
    return sides.agg(
        F.count_if(mono_r & ~mono_o).alias("reference_only"), F.count_if(mono_o & ~mono_r).alias("others_only"),
        F.count_if(mono_r & mono_o & (F.col("r_lo") != F.col("o_lo"))).alias("fixed_difference"), F.count_if(mono_r & mono_o & (F.col("r_lo") == F.col("o_lo"))).alias("same"),
    )


def biallelic(g: DataFrame) -> DataFrame:
    """``(chrom, pos, n, n_alleles)`` of sites with at most two different alleles over both places of all calls (and at least one)."""
    each = g.select(*SITE, F.explode(F.array("a1", "a2")).alias("a")).where("a IS NOT NULL")
    return each.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("n_alleles")).where("n_alleles <= 2")
