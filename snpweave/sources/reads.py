"""Sequences, alignments, hits and annotations as tables, and the text sinks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import blocks, fields, lines, write_lines


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, name, seq)``; sequences may run over several lines."""
    cut = blocks(lines(spark, path), F.col("value").startswith(">"), name="rec").where("rec > 0")
    head = F.col("value").startswith(">")
    return cut.groupBy("file", "rec").agg(
        F.min("ord").alias("ord"), F.max(F.when(head, F.substring("value", F.lit(2), F.length("value")))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("ord", F.trim("value").alias("v"))))), lambda x: x.v), "").alias("seq"),
    ).select("ord", "name", "seq")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """``(file, rec, name, seq, plus, quality)``: four lines a record."""
    n = (F.col("ord") - 1) % 4
    take = lambda k: F.max(F.when(n == k, F.col("value")))
    return lines(spark, path).groupBy("file", F.floor((F.col("ord") - 1) / 4).alias("rec")).agg(take(0).alias("name"), take(1).alias("seq"), take(2).alias("plus"), take(3).alias("quality"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(rec, name, seq1, seq2, quality2)``: records of both files by number; an error where the names differ."""
    name = lambda c: F.split_part(F.split_part(c, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1))
    both = first.select("rec", name(F.col("name")).alias("name"), F.col("seq").alias("seq1")).join(second.select("rec", name(F.col("name")).alias("name2"), F.col("seq").alias("seq2"), F.col("quality").alias("quality2")), "rec")
    return both.withColumn("name", F.when(F.col("name") == F.col("name2"), F.col("name")).otherwise(F.raise_error(F.lit("read pairs are out of step")))).drop("name2")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n)``: records of each file, compressed or not."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.floor(F.count(F.lit(1)) / 4).alias("n"))


def write_per_reference(rows: DataFrame, reference: str, line: Column, path: str) -> None:
    """Lines appended to a folder for each reference."""
    rows.select(F.col(reference).alias("ref"), line.alias("value")).write.mode("append").partitionBy("ref").text(path)


def sam(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, qname, flag, rname, pos, mapq, cigar, seq)``."""
    f = F.split("value", "\t")
    return lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select("ord", f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), f[3].cast("int").alias("pos"), f[4].cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"), F.get(f, F.lit(9)).alias("seq"))


def sam_bases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Base-by-base alignments ``(ord, qname, flag, chrom, qpos, base, rpos, rbase)`` and their text lines ``(ord, value)``."""
    all_lines = lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    number = lambda i: f[i].try_cast("int")
    rows = all_lines.where(~F.col("value").startswith(":")).select("ord", f[0].alias("qname"), number(1).alias("flag"), f[2].alias("chrom"), number(3).alias("qpos"), f[4].alias("base"), number(6).alias("rpos"), F.get(f, F.lit(7)).alias("rbase"))
    return rows, all_lines.where(F.col("value").startswith(":")).select("ord", "value")


def blast(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, block, qseqid, sseqid, length, nident, pident, evalue, bitscore, taxids, title)``: hits with their query's block."""
    marked = lines(spark, path).withColumn("value", F.rtrim("value")).where("value <> ''")
    comment = F.col("value").startswith("#")
    begins = comment & F.col("value").startswith("# Query")
    f = F.split("value", "\t")
    hits = blocks(marked, begins).where(~comment)
    return hits.select("ord", "block", f[0].alias("qseqid"), f[1].alias("sseqid"), f[2].cast("int").alias("length"), f[3].cast("int").alias("nident"), f[4].cast("double").alias("pident"), f[5].cast("double").alias("evalue"), F.get(f, F.lit(6)).cast("double").alias("bitscore"), F.get(f, F.lit(7)).alias("taxids"), F.get(f, F.lit(8)).alias("title"))


def loci(spark: SparkSession, path: str) -> DataFrame:
    """``(locus_ord, locus, info, seq_ord, sample, seq)`` of alignment blocks that end on a line with ``//``; a leading ``>`` is dropped."""
    all_lines = lines(spark, path).where(F.trim("value") != "")
    end = F.col("value").startswith("/")
    cut = blocks(all_lines, end, name="seen").withColumn("locus_ord", F.col("seen") - end.cast("long"))
    heads = cut.where(end).select("file", "locus_ord", F.get(F.split("value", r"\|"), F.lit(1)).alias("locus"), F.col("value").alias("info"))
    f = fields(F.regexp_replace("value", "^>", ""))
    seqs = cut.where(~end).select("file", "locus_ord", F.col("ord").alias("seq_ord"), f[0].alias("sample"), F.get(f, F.lit(1)).alias("seq"))
    return seqs.join(heads, ["file", "locus_ord"]).select("locus_ord", "locus", "info", "seq_ord", "sample", "seq")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``(file, cluster, ord, name, size, seq)`` of ``name;size=n;`` headers, each with a sequence, in blocks that end on ``//``."""
    all_lines = lines(spark, path).where(F.trim("value") != "")
    end = F.col("value").startswith("//")
    cut = blocks(all_lines, end, name="seen").where(~end)
    head = F.col("value").contains(";size=")
    w = Window.partitionBy("file", "seen").orderBy("ord")
    with_seq = cut.withColumn("next", F.lead("value").over(w))
    return with_seq.where(head).select("file", F.col("seen").alias("cluster"), "ord", F.regexp_extract("value", "^>?([^;]*);", 1).alias("name"), F.regexp_extract("value", "size=([0-9]+)", 1).cast("long").alias("size"), F.col("next").alias("seq"))


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """``(locus, scaffold, pos, flag)``."""
    f = fields(F.col("value"))
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("locus"), f[1].alias("scaffold"), f[2].try_cast("int").alias("pos"), f[3].try_cast("int").alias("flag")).where("pos IS NOT NULL")


def go_table(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, gene, said)``: a gene and its terms, parted by a tab."""
    f = F.split("value", "\t")
    return lines(spark, path).where(F.size(f) > 1).select("ord", f[0].alias("gene"), f[1].alias("said"))


def orderings(spark: SparkSession, folder: str) -> DataFrame:
    """``(chrom, ord, scaffold, strand)`` of a folder of files, one a chromosome, named for it."""
    f = fields(F.col("value"))
    return lines(spark, f"{folder.rstrip('/')}/*.txt").where(F.trim("value") != "").select(F.regexp_extract("file", r"([^/]*?)(_orderings)?\.txt$", 1).alias("chrom"), "ord", f[0].alias("scaffold"), F.get(f, F.lit(1)).alias("strand"))


def csv_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, row, col, value)`` of equally shaped CSV files."""
    return lines(spark, f"{folder.rstrip('/')}/*.csv").select("file", F.col("ord").alias("row"), F.posexplode(F.split("value", ",")).alias("col", "value"))


def enzymes(spark: SparkSession, path: str) -> DataFrame:
    f = fields(F.col("value"))
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("enzyme"), F.get(f, F.lit(1)).alias("site"))


def tree_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, label)`` of a tree file's block of labels, on one line or many."""
    all_lines = lines(spark, path)
    opens = F.lower(F.trim("value")).startswith("taxlabels")
    inside = blocks(blocks(all_lines, opens, name="opened"), F.contains("value", F.lit(";")), name="closed")
    at_open = inside.where(opens).select("file", F.col("closed").alias("closed_before"), F.contains("value", F.lit(";")).cast("long").alias("own"))
    rows = inside.join(at_open, "file").where((F.col("opened") > 0) & (F.col("closed") - F.contains("value", F.lit(";")).cast("long") <= F.col("closed_before") - F.col("own")))
    labels = F.filter(fields(F.regexp_replace(F.regexp_replace("value", "(?i)^\\s*taxlabels", ""), ";", " ")), lambda x: x != "")
    return rows.select("ord", F.explode(labels).alias("label"))


def inferred_ancestry(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, value)``: the rows between ``Inferred ancestry of individuals:`` and the next blank line."""
    all_lines = lines(spark, path)
    head = F.contains("value", F.lit("Inferred ancestry of individuals:"))
    opened = blocks(all_lines, head, name="opened")
    start = opened.where(head).groupBy("file").agg(F.min("ord").alias("start"))
    stop = opened.where((F.col("opened") > 0) & (F.trim("value") == "")).groupBy("file").agg(F.min("ord").alias("stop"))
    return all_lines.join(start, "file").join(stop, "file", "left").where("ord > start AND (stop IS NULL OR ord < stop)").select("ord", "value")


def cluster_shares(spark: SparkSession, path: str) -> DataFrame:
    """``(ind, q)``: the individual's number and its shares, which begin in the sixth column."""
    f = fields(F.col("value"))
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].cast("int").alias("ind"), F.transform(F.slice(f, 6, 1 << 30), lambda x: x.cast("double")).alias("q"))


def write_fasta(rows: DataFrame, path: str, order: list[str]) -> None:
    """``name, seq`` rows as two lines each."""
    write_lines(rows, F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")), order, path)
