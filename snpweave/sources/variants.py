"""Variant files: header, sites and tidy calls; and marker tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.genotype import call_of, dart_call, phred
from .text import fields, lines, write_lines

# The columns before the samples.
SITE_COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


class Variants:
    """``header (ord, value)``, ``sites (ord, chrom, pos, ...)``, ``samples`` in file order and ``calls`` of one file."""

    def __init__(self, spark: SparkSession, path: str):
        self.lines = lines(spark, path)
        self.header = self.lines.where(F.col("value").startswith("#")).select("ord", "value")
        names = self.header.where(F.col("value").startswith("#CHROM")).select(fields(F.col("value")).alias("f")).first()
        self.samples: list[str] = list(names.f[len(SITE_COLUMNS):]) if names else []
        cut = self.lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("ord", fields(F.col("value")).alias("f"))
        self._cut = cut
        self.sites = cut.select("ord", *[F.col("f")[i].cast("long" if c == "pos" else "string").alias(c) for i, c in enumerate(SITE_COLUMNS)])

    @property
    def calls(self) -> DataFrame:
        """``(ord, chrom, pos, sample, gt, a1, a2)``: one row a site and sample; alleles are NULL for a missing call."""
        names = F.array(*map(F.lit, self.samples)) if self.samples else F.array().cast("array<string>")
        each = self._cut.select("ord", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.posexplode(F.slice("f", len(SITE_COLUMNS) + 1, 1 << 30)).alias("i", "gt"))
        a1, a2 = call_of(F.col("gt"))
        return each.select("ord", "chrom", "pos", F.get(names, F.col("i")).alias("sample"), "gt", a1.alias("a1"), a2.alias("a2"))


def write_vcf(header: DataFrame, kept: DataFrame, source: Variants, path: str) -> None:
    """The header lines and the lines of the kept sites (by ``ord``), in order and unchanged."""
    body = source.lines.join(kept.select("ord"), "ord", "left_semi").select("ord", "value")
    write_lines(header.select("ord", "value").unionByName(body), F.col("value"), ["ord"], path)


def popfile(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, sample, pop)``: two columns parted by blanks, tabs or commas; a sample's last line counts."""
    f = fields(F.replace(F.col("value"), F.lit(","), F.lit(" ")))
    rows = lines(spark, path).where(F.trim("value") != "").select("ord", f[0].alias("sample"), F.get(f, F.lit(1)).alias("pop"))
    return rows.groupBy("sample").agg(F.max_by("pop", "ord").alias("pop"), F.min("ord").alias("ord")).select("ord", "sample", "pop")


def factor_file(spark: SparkSession, path: str, names: tuple[str, str] = ("pop", "grp")) -> DataFrame:
    """``(ord, sample, pop, grp)``: three columns parted by any blanks."""
    f = fields(F.col("value"))
    return lines(spark, path).where(F.trim("value") != "").select("ord", f[0].alias("sample"), F.get(f, F.lit(1)).alias(names[0]), F.get(f, F.lit(2)).alias(names[1]))


def order_file(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, sample)``: the first column in the file's order."""
    return lines(spark, path).where(F.trim("value") != "").select("ord", fields(F.col("value"))[0].alias("sample"))


def id_list(spark: SparkSession, path: str, name: str = "id", kind: str = "string") -> DataFrame:
    """Distinct trimmed lines."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").select(F.col(name).cast(kind)).distinct()


def rename_map(spark: SparkSession, path: str) -> DataFrame:
    """``(old, new)``; the last line of an old name counts."""
    f = fields(F.col("value"))
    rows = lines(spark, path).where(F.trim("value") != "").select("ord", f[0].alias("old"), F.get(f, F.lit(1)).alias("new"))
    return rows.groupBy("old").agg(F.max_by("new", "ord").alias("new"))


def snp_list(spark: SparkSession, path: str) -> DataFrame:
    f = fields(F.col("value"))
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos")).distinct()


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, sample, pop, q)``: shares as an array, parted by commas or tabs."""
    f = F.split(F.replace(F.col("value"), F.lit("\t"), F.lit(",")), ",")
    return lines(spark, path).where(F.trim("value") != "").select("ord", f[0].alias("sample"), F.get(f, F.lit(1)).alias("pop"), F.transform(F.slice(f, 3, 1 << 30), lambda x: x.cast("double")).alias("q"))


def fst_table(spark: SparkSession, path: str) -> DataFrame:
    """``(locus_no, fst)`` of ``SNP_n het Fst`` rows; the header and missing values (-100) are left out."""
    f = fields(F.col("value"))
    rows = spark.read.text(path).where(~F.col("value").startswith("Locus") & (F.trim("value") != "")).select(F.regexp_replace(f[0], "^SNP_", "").cast("long").alias("locus_no"), F.element_at(f, -1).alias("said"))
    return rows.where("said <> '-100'").select("locus_no", F.col("said").cast("double").alias("fst"))


def distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(ind1, ind2, d)`` of a square or lower-triangular matrix with a header of names."""
    all_lines = lines(spark, path).where(F.trim("value") != "").select("ord", fields(F.col("value")).alias("f"))
    names = all_lines.orderBy("ord").first()
    if names is None:
        return spark.createDataFrame([], "ind1 string, ind2 string, d double")
    head = F.array(*map(F.lit, names.f))
    cells = all_lines.where(F.col("ord") > names.ord).select(F.col("f")[0].alias("ind1"), F.posexplode(F.slice("f", 2, 1 << 30)).alias("i", "d"))
    return cells.select("ind1", F.get(head, F.col("i")).alias("ind2"), F.col("d").cast("double").alias("d"))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    f = fields(F.col("value"))
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("pop"), F.get(f, F.lit(1)).cast("double").alias("lon"), F.get(f, F.lit(2)).cast("double").alias("lat"))


#: Columns of a marker table that must be there; sample columns are those after the last known one.
DART_REQUIRED = ("AlleleID", "CloneID", "AlleleSequence", "SNP", "SnpPosition")
DART_KNOWN = (*DART_REQUIRED, "TrimmedSequence", "CallRate", "OneRatioRef", "OneRatioSnp", "FreqHomRef", "FreqHomSnp", "FreqHets", "PICRef", "PICSnp", "AvgPIC", "AvgCountRef", "AvgCountSnp", "RepAvg")


def dart_table(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, chrom, pos, ref, alt, qual, info, sample, gt)`` of a marker CSV; lines that begin with ``*`` are comments."""
    body = lines(spark, path).where(~F.col("value").startswith("*") & (F.trim("value") != "")).select("ord", F.split("value", ",").alias("f"))
    head = body.orderBy("ord").first()
    if head is None or any(c not in head.f for c in DART_REQUIRED):
        raise ValueError(f"a marker table needs the columns {', '.join(DART_REQUIRED)}")
    at = {c: i for i, c in enumerate(head.f)}
    begin = 1 + max(i for c, i in at.items() if c in DART_KNOWN)
    cell = lambda c: F.get("f", F.lit(at[c])) if c in at else F.lit(None).cast("string")
    alleles = F.split_part(cell("SNP"), F.lit(":"), F.lit(2))
    frequency = cell("FreqHomSnp").try_cast("double") + F.lit(0.5) * cell("FreqHets").try_cast("double")
    depth = cell("AvgCountRef").try_cast("double") + cell("AvgCountSnp").try_cast("double")
    said = lambda c, label: F.when(cell(c).isNotNull(), F.concat(F.lit(label), F.trim(cell(c))))
    parts = (
        F.when(depth.isNotNull(), F.format_string("DP=%.1f", depth)), said("CallRate", "CR="), F.when(frequency.isNotNull(), F.format_string("AF=%.4f", frequency)),
        said("FreqHets", "HET="), said("AvgPIC", "PIC="), said("RepAvg", "REP="),
    )
    info = F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit("."))
    names = F.array(*map(F.lit, head.f[begin:])) if head.f[begin:] else F.array().cast("array<string>")
    each = body.where(F.col("ord") > head.ord).select("ord", cell("CloneID").alias("chrom"), cell("SnpPosition").cast("long").alias("pos"), F.substring(alleles, 1, 1).alias("ref"), F.substring(alleles, 3, 1).alias("alt"), phred(cell("RepAvg")).alias("qual"), info.alias("info"), F.posexplode(F.slice("f", begin + 1, 1 << 30)).alias("i", "score"))
    return each.select("ord", "chrom", "pos", "ref", "alt", "qual", "info", F.get(names, F.col("i")).alias("sample"), dart_call(F.trim("score")).alias("gt"))


def spid_template(extension: str) -> str:
    """Parameter text of a format conversion for an output file's extension; an error for others."""
    # Extensions and the formats they stand for.
    kinds = {".structure": "STRUCTURE", ".str": "STRUCTURE", ".bayescan": "GESTE_BAYE_SCAN", ".genepop": "GENEPOP", ".lositan": "GENEPOP", ".arlequin": "ARLEQUIN", ".arp": "ARLEQUIN", ".plink": "PED", ".ped": "PED"}
    if extension not in kinds:
        raise ValueError(f"no conversion to {extension}")
    return f"PARSER_FORMAT=VCF\nWRITER_FORMAT={kinds[extension]}\n"


def join_line(*columns: Column) -> Column:
    return F.concat_ws("\t", *columns)
