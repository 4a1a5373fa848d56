"""Sites of locus alignments placed on a genome by base-by-base alignments of the loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import complement, expand, without_gaps


def read_place(seq: Column, pos: Column, flag: Column) -> Column:
    """Place (from 0) in the gapless read of place ``pos`` (from 1) of an aligned sequence, on the strand that the flag tells."""
    before = F.substring(seq, F.lit(1), pos - 1)
    after = F.substring(seq, pos + 1, F.length(seq))
    gaps = lambda s: F.length(s) - F.length(without_gaps(s))
    return F.when(flag == 16, F.length(seq) - pos - gaps(after)).otherwise(pos - gaps(before) - 1)


def fits(base: Column, ref: Column, alt: Column) -> Column:
    """Whether all bases of a code are one of the alleles; N and gaps always fit."""
    return base.isin("N", "-") | F.forall(F.split(expand(base), "(?!^)(?!$)"), lambda x: (x == ref) | (x == alt))


def remap_case(genome: Column, ref: Column, alt: Column, flag: Column) -> Column:
    """``same`` or ``swapped`` as the genome has the reference or alternative allele (on its strand), ``deleted`` if neither."""
    strand = F.when(flag == 16, "reverse").otherwise("forward")
    one, two = (F.when(flag == 16, complement(x)).otherwise(x) for x in (ref, alt))
    return F.when(genome == one, F.concat(strand, F.lit("_same"))).when(genome == two, F.concat(strand, F.lit("_swapped"))).otherwise("deleted")


def flipped(call: Column) -> Column:
    """A call with its alleles 0 and 1 exchanged and in order; separator and further fields stay."""
    a, b = (1 - F.substring(call, n, 1).try_cast("int") for n in (1, 3))
    return F.when(a.isNull() | b.isNull(), call).otherwise(F.concat(F.least(a, b).cast("string"), F.substring(call, 2, 1), F.greatest(a, b).cast("string"), F.substring(call, F.lit(4), F.length(call))))


def identity(bars: Column, query: Column) -> Column:
    """Percent of a query that its alignment line marks as equal."""
    return F.try_divide(100.0 * F.regexp_count(bars, F.lit(r"\|")), F.length(query))


def remap_to_genome(sites: DataFrame, fasta: DataFrame, mapped: DataFrame, bases: DataFrame) -> DataFrame:
    """``(chrom, pos, genome_chrom, genome_pos, genome_base, ref, alt, case)``.

    ``sites (chrom, pos, ref, alt)`` meet ``fasta (name, seq)`` by name, ``mapped (qname, flag)`` by
    name and ``bases (qname, qpos, genome_chrom, rpos, rbase)`` by a computed place: three
    equi-joins.  An allele that the sequence contradicts is an error; sites whose genome base
    is neither allele are marked deleted; swapped sites have their alleles exchanged, reverse
    ones complemented.
    """
    placed = sites.join(fasta, sites.chrom == fasta.name).join(mapped, F.col("chrom") == F.col("qname"))
    base = F.substring("seq", F.col("pos"), F.lit(1))
    checked = placed.withColumn("qpos", F.when(fits(base, F.col("ref"), F.col("alt")), read_place(F.col("seq"), F.col("pos"), F.col("flag"))).otherwise(F.raise_error(F.lit("a sequence and its alleles disagree"))))
    met = checked.join(bases, ["qname", "qpos"]).withColumn("case", remap_case(F.col("rbase"), F.col("ref"), F.col("alt"), F.col("flag")))
    on_strand = lambda x: F.when(F.col("flag") == 16, complement(F.col(x))).otherwise(F.col(x))
    swapped = F.col("case").endswith("_swapped")
    return met.select(
        "chrom", "pos", "genome_chrom", F.col("rpos").alias("genome_pos"), F.col("rbase").alias("genome_base"),
        F.when(swapped, on_strand("alt")).otherwise(on_strand("ref")).alias("ref"), F.when(swapped, on_strand("ref")).otherwise(on_strand("alt")).alias("alt"), "case",
    )
