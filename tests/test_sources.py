"""Readers and sinks on files written here."""

import gzip

import pytest
from pyspark.sql import functions as F

from snpweave.sources import reads, rename, text, variants

VCF = """##fileformat=VCFv4.1
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
c1\t10\t.\tA\tT\t.\tPASS\t.\tGT:DP\t0/0:3\t0/1:4\t./.
c1\t25\t.\tG\tC\t.\tPASS\t.\tGT\t1|1\t.\t0/1
c2\t7\t.\tA\tG\t.\tPASS\t.\tGT\t0/1\t0/0\t1/1
"""


def put(folder, name, content):
    path = folder / name
    path.write_text(content)
    return str(path)


def test_vcf_round_trip(spark, tmp_path):
    v = variants.Variants(spark, put(tmp_path, "a.vcf", VCF))
    assert v.samples == ["s1", "s2", "s3"]
    calls = {(r["chrom"], r["pos"], r["sample"]): (r.a1, r.a2) for r in v.calls.collect()}
    assert calls[("c1", 10, "s2")] == (0, 1) and calls[("c1", 10, "s3")] == (None, None) and calls[("c1", 25, "s1")] == (1, 1) and calls[("c1", 25, "s2")] == (None, None)
    variants.write_vcf(v.header, v.sites, v, str(tmp_path / "out"))
    assert "".join(r.value + "\n" for r in text.lines(spark, str(tmp_path / "out")).orderBy("ord").collect()) == VCF
    variants.write_vcf(v.header, v.sites.where("chrom = 'c2'"), v, str(tmp_path / "some"))
    assert spark.read.text(str(tmp_path / "some")).count() == 3


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = put(tmp_path, "big.txt", "\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = text.lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.value == f"line {r.ord - 1}" for r in rows) and len(rows) == 5000


def test_fasta_fastq_counts(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">one x\nACGT\nAC\n>two\nGG\n")
    assert [(r.name, r.seq) for r in reads.fasta(spark, path).orderBy("ord").collect()] == [("one x", "ACGTAC"), ("two", "GG")]
    for n, seq in (("1", "AAAA"), ("2", "CCCC")):
        put(tmp_path, f"r{n}.fastq", f"@HWI:1 {n}\n{seq}\n+\nIIII\n@HWI:2 {n}\n{seq}\n+\nIIII\n")
    pair = reads.paired(reads.fastq(spark, str(tmp_path / "r1.fastq")), reads.fastq(spark, str(tmp_path / "r2.fastq")))
    assert [(r.name, r.seq1, r.seq2) for r in pair.orderBy("rec").collect()] == [("@HWI:1", "AAAA", "CCCC"), ("@HWI:2", "AAAA", "CCCC")]
    with gzip.open(tmp_path / "z.fastq.gz", "wt") as f:
        f.write("@a\nA\n+\nI\n" * 3)
    assert reads.read_counts(spark, str(tmp_path / "*.fastq.gz")).first().n == 3
    put(tmp_path, "bad.fastq", "@HWI:9 2\nC\n+\nI\n@HWI:2 2\nC\n+\nI\n")
    with pytest.raises(Exception, match="out of step"):
        reads.paired(reads.fastq(spark, str(tmp_path / "r1.fastq")), reads.fastq(spark, str(tmp_path / "bad.fastq"))).collect()


def test_loci_and_clusters(spark, tmp_path):
    path = put(tmp_path, "a.loci", "s1   ACGT\ns2   ACGA\n//     *|0|\n>s1   GG\n>s3   GA\n>s4   GG\n//    -|1|\n")
    rows = reads.loci(spark, path).orderBy("seq_ord").collect()
    assert [(r.locus, r["sample"], r.seq) for r in rows] == [("0", "s1", "ACGT"), ("0", "s2", "ACGA"), ("1", "s1", "GG"), ("1", "s3", "GA"), ("1", "s4", "GG")]
    path = put(tmp_path, "a.clustS", ">a;size=5;\nAC\n>b;size=2;\nAG\n//\n//\n>c;size=1;\nTT\n//\n//\n")
    got = reads.read_clusters(spark, path).orderBy("ord").collect()
    assert [(r.name, r["size"], r.seq) for r in got] == [("a", 5, "AC"), ("b", 2, "AG"), ("c", 1, "TT")] and got[0].cluster == got[1].cluster != got[2].cluster


def test_sam_blast_and_tables(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@SQ\tSN:c\nq1\t0\tc\t1\t30\t4M\t*\t0\t0\tACGT\tIIII\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    assert [(r.qname, r.flag, r.pos) for r in reads.sam(spark, path).orderBy("ord").collect()] == [("q1", 0, 1), ("q2", 4, 0)]
    head = "# BLASTN\n# Query: {}\n# Fields\n"
    path = put(tmp_path, "b.txt", head.format("x") + "x\ts1\t50\t49\t98\t1e-9\t80\t9606;1\tt\nx\ts2\t40\t39\t97\t1e-5\t70\t1\tt\n" + head.format("y") + "# 0 hits\n" + head.format("z") + "z\ts3\t30\t30\t100\t1e-3\t60\t7\tt\n")
    hits = reads.blast(spark, path).orderBy("ord").collect()
    assert [(r.qseqid, r.block, r.nident) for r in hits] == [("x", 1, 49), ("x", 1, 39), ("z", 3, 30)]
    pops = variants.popfile(spark, put(tmp_path, "p.txt", "a\tp1\nb,p2\na p3\n"))
    assert {(r["sample"], r["pop"]) for r in pops.collect()} == {("a", "p3"), ("b", "p2")}
    fst = variants.fst_table(spark, put(tmp_path, "f.txt", "Locus Het Fst\nSNP_1 0.1 0.5\nSNP_2 0.1 -100\n"))
    assert [(r.locus_no, r.fst) for r in fst.collect()] == [(1, 0.5)]
    m = variants.distance_matrix(spark, put(tmp_path, "m.txt", "a b\na 0 0.3\nb 0.3 0\n"))
    assert {(r.ind1, r.ind2, r.d) for r in m.collect()} == {("a", "a", 0.0), ("a", "b", 0.3), ("b", "a", 0.3), ("b", "b", 0.0)}


def test_marker_table(spark, tmp_path):
    head = "AlleleID,CloneID,AlleleSequence,SNP,SnpPosition,CallRate,FreqHomSnp,FreqHets,RepAvg,i1,i2,i3,i4\n"
    path = put(tmp_path, "d.csv", "*,*,*\n" + head + "a1,c1,ACGT,5:A>G,5,0.9,0.2,0.4,0.9,0,1,2,-\n")
    rows = variants.dart_table(spark, path).orderBy("sample").collect()
    assert [r.gt for r in rows] == ["0/0", "1/1", "0/1", "./."] and (rows[0].ref, rows[0].alt, rows[0].qual) == ("A", "G", "10.0")
    assert rows[0].info == "CR=0.9;AF=0.4000;HET=0.4;REP=0.9"
    deep = head.replace("RepAvg", "AvgCountRef,AvgCountSnp")
    assert variants.dart_table(spark, put(tmp_path, "f.csv", deep + "a1,c1,ACGT,5:A>G,5, 0.90,x,0.4,10.25,4.5,0,1,2,-\n")).first().info == "DP=14.8;CR=0.90;HET=0.4"
    bare = "AlleleID,CloneID,AlleleSequence,SNP,SnpPosition,i1\na1,c1,ACGT,5:A>G,5,0\n"
    assert variants.dart_table(spark, put(tmp_path, "g.csv", bare)).first().info == "."
    assert [r["sample"] for r in variants.order_file(spark, put(tmp_path, "o.txt", "b x\n\na y\nb z\n")).orderBy("ord").collect()] == ["b", "a", "b"]
    with pytest.raises(ValueError, match="needs the columns"):
        variants.dart_table(spark, put(tmp_path, "e.csv", "x,y\n1,2\n"))


def test_tree_labels_and_ancestry(spark, tmp_path):
    path = put(tmp_path, "t.nex", "#NEXUS\nbegin taxa;\ntaxlabels\n a\n b\n;\nend;\ntree x;\n")
    assert [r.label for r in reads.tree_labels(spark, path).orderBy("ord").collect()] == ["a", "b"]
    path = put(tmp_path, "s.txt", "x\nInferred ancestry of individuals:\n 1 a\n 2 b\n\nmore\n")
    assert [r.value.strip() for r in reads.inferred_ancestry(spark, path).orderBy("ord").collect()] == ["1 a", "2 b"]
    with pytest.raises(ValueError):
        variants.spid_template(".xyz")
    assert "GENEPOP" in variants.spid_template(".lositan")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "GG", 2), ("a", "AC", 1)], "name string, seq string, ord int")
    reads.write_fasta(rows, str(tmp_path / "fa"), ["ord"])
    assert [r.value for r in text.lines(spark, str(tmp_path / "fa")).orderBy("ord").collect()] == [">a", "AC", ">b", "GG"]
    reads.write_per_reference(rows, "name", F.col("seq"), str(tmp_path / "refs"))
    reads.write_per_reference(rows, "name", F.col("seq"), str(tmp_path / "refs"))
    assert {(r.ref, r["count"]) for r in spark.read.text(str(tmp_path / "refs")).groupBy("ref").count().collect()} == {("a", 2), ("b", 2)}


def test_renames(spark, tmp_path):
    for name in ("x_AACC_1.fq", "y_GGTT.fq", "z.fq"):
        put(tmp_path, name, "abc")
    codes = spark.createDataFrame([("AACC", "s1"), ("GGTT", "s2")], "barcode string, name string")
    plan = rename.rename_plan(spark, str(tmp_path), codes)
    assert {r.size for r in plan.collect()} == {"3.0B"}
    assert len(rename.rename_files(plan)) == 2 and (tmp_path / "x_AACC_1.fq").exists()
    rename.rename_files(plan, really=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x_s1_1.fq", "y_s2.fq", "z.fq"]
