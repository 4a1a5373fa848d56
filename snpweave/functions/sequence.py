"""Column expressions over nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases with their complements, ambiguity codes included, and the codes' two bases.
BASES, COMPLEMENTS = "ATGCYRSWMKN", "TACGRYSWKMN"
AMBIGUITY = {"Y": "CT", "R": "AG", "S": "CG", "W": "AT", "M": "AC", "K": "GT"}


def complement(seq: Column) -> Column:
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def expand(code: Column) -> Column:
    """The bases of a code: both of an ambiguity code, else the base itself."""
    pairs = F.create_map(*[F.lit(x) for k, v in AMBIGUITY.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, code), code)


def without_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def sites_of(seq: Column, motif: Column) -> Column:
    """Start places (from 1) of a motif's non-overlapping occurrences, as an array."""
    pieces = F.split(seq, motif, -1)
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, piece: F.struct((acc["at"] + F.length(piece) + F.length(motif)).alias("at"), F.concat(acc["out"], F.array((acc["at"] + F.length(piece)).cast("int"))).alias("out"))
    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), state, step, lambda acc: acc["out"])


def remapped(start: Column, length: Column, pos: Column, flag: Column) -> Column:
    """Place on the reference of a place on a mapped locus: forward (flag 0) or reverse (flag 16); an error for other flags."""
    bad = F.raise_error(F.concat(F.lit("no placing for flag "), flag.cast("string"))).cast("long")
    return F.when(flag == 0, start + pos - 1).when(flag == 16, start + length - pos - 1).otherwise(bad)
