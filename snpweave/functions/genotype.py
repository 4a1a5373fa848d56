"""Column expressions over genotype calls: two alleles, NULL where the call is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_called(a1: Column, a2: Column) -> Column:
    """A call counts if both alleles are there."""
    return a1.isNotNull() & a2.isNotNull()


def call_of(text: Column) -> tuple[Column, Column]:
    """Alleles of ``a/b`` or ``a|b``, with or without further fields; NULL for a dot or anything else."""
    call = F.regexp_extract(text, r"^([0-9])[/|]([0-9])", 0)
    at = lambda n: F.when(call != "", F.substring(call, n, 1).cast("int"))
    return at(1), at(3)


def dosage(a1: Column, a2: Column) -> Column:
    """Number of alternative alleles: 0, 1 or 2, NULL for a missing call."""
    return (a1 != 0).cast("int") + (a2 != 0).cast("int")


def match_twice(a1: Column, a2: Column, b1: Column, b2: Column, crosswise: bool = True) -> Column:
    """Twice the match of two calls: 2 if equal, 1 if an allele is shared (with ``crosswise`` at either place), else 0."""
    shared = (a1 == b1) | (a2 == b2)
    if crosswise:
        shared = shared | (a1 == b2) | (a2 == b1)
    return F.when((a1 == b1) & (a2 == b2), 2).when(shared, 1).otherwise(0)


def coded(dose: Column, missing: str) -> Column:
    """Dosage as text with a sentinel for missing calls (the sinks' codes)."""
    return F.coalesce(dose.cast("string"), F.lit(missing))


def base_of(allele: Column, ref: Column, alt: Column) -> Column:
    return F.when(allele == 0, ref).when(allele == 1, alt)


def structure_code(base: Column) -> Column:
    """A, T, G, C as 10 to 13, anything else as -9."""
    return F.when(base == "A", 10).when(base == "T", 11).when(base == "G", 12).when(base == "C", 13).otherwise(-9)


def pair_label(pop1: Column, pop2: Column) -> Column:
    """One name for a pair of populations, whatever their order; NA where one is unknown."""
    joined = F.concat_ws("-", F.array_sort(F.array(pop1, pop2)))
    return F.when(pop1.isNull() | pop2.isNull(), F.lit("NA")).when(pop1 == pop2, pop1).otherwise(joined)


def allele_class(low: Column, high: Column, near: float) -> Column:
    """Class of a group by its subgroups' smallest and largest alternative frequency; the first that holds."""
    return (
        F.when(high == 0, "REF_FIXED").when(high <= near, "REF_NEARFIXED").when(low == 1, "ALT_FIXED")
        .when(low >= 1 - near, "ALT_NEARFIXED").when(low > 0, "ALT_ALWAYS_PRESENT").otherwise("OTHER")
    )


def dart_call(text: Column) -> Column:
    """Scores ``-``, 0, 1, 2 of a marker table as calls."""
    return F.when(text == "-", "./.").when(text == "0", "0/0").when(text == "1", "1/1").when(text == "2", "0/1").otherwise("err")


def phred(average: Column) -> Column:
    """Reproducibility as a phred-like text: 100 from 1 on, 0 up to 0, a dot if it is no number."""
    r = F.expr("1").cast("double") * average.try_cast("double")
    return F.when(r.isNull(), ".").when(r >= 1, "100").when(r <= 0, "0").otherwise(F.format_string("%.1f", -10 * F.log10(1 - r)))
