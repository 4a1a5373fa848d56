"""Operators on small tables, with results worked out by hand; rules on random tables."""

import random

from pyspark.sql import functions as F

from snpweave.functions import genotype as gt
from snpweave.functions import sequence as sq
from snpweave.operators import annotate, blocks, convert, frequencies, graph, lists, pairwise, remap, sequences

CALLS = "ind long, pop long, grp long, m long, chrom long, pos long, a1 int, a2 int"


def calls(spark, rows):
    return spark.createDataFrame([(i, p, g, m, 1, 10 * m + 1, a, b) for i, p, g, m, a, b in rows], CALLS)


def test_match_scores_agree_with_row_comparison(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, m, rng.randint(0, 1), rng.randint(0, 1)) for i in range(9) for m in range(150) if rng.random() < 0.8]
    g = calls(spark, rows)
    for crosswise in (True, False):
        x, y = g.alias("x"), g.alias("y")
        score = gt.match_twice(F.col("x.a1"), F.col("x.a2"), F.col("y.a1"), F.col("y.a2"), crosswise)
        plain = x.join(y, (F.col("x.m") == F.col("y.m")) & (F.col("x.ind") < F.col("y.ind"))).groupBy(F.col("x.ind").alias("ind1"), F.col("y.ind").alias("ind2")).agg(F.count(F.lit(1)).alias("both"), F.sum(score).alias("match2"))
        assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in pairwise.matches(g, crosswise=crosswise).collect()}
        assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in pairwise.matches(g, crosswise=crosswise, blocks=5).collect()}


def test_missing_alleles_are_missing_calls(spark):
    g = calls(spark, [(1, 0, 0, 0, 0, 1), (1, 0, 0, 1, None, None), (2, 0, 0, 0, 1, 1)])
    samples = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0)], "ind long, pop long, grp long")
    assert {(r.ind, r.genotyped, r.missing) for r in frequencies.missing_data(g, samples, 2).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 2)}
    freq = {(r.pos, r.aaf, r.said) for r in frequencies.allele_freq(g, ["grp"]).collect()}
    assert freq == {(1, 0.75, "3 of 4"), (11, None, "0 of 0")}
    sites = spark.createDataFrame([(0, 1, 1), (1, 1, 11)], "m long, chrom long, pos long")
    kept = frequencies.minrep(frequencies.genotyped_by_pop(g, samples.where("pop = 0"), sites), least_prop=0.5)
    assert [r.pos for r in kept.collect()] == [1]


def test_blocks_and_spacing(spark):
    s = spark.createDataFrame([(1, p) for p in (5, 100, 2600, 5100, 5101)], "chrom long, pos long")
    assert [r.block for r in blocks.snp_blocks(s, 2500).orderBy("pos").collect()] == [1, 1, 2, 3, 3]
    assert [r.block for r in blocks.snp_blocks(s, 2500, inclusive=False).orderBy("pos").collect()] == [1, 1, 1, 1, 1]
    picked = blocks.single_snp(s, 2500, 3).collect()
    assert len(picked) == 3 and {r.pos for r in picked} <= {5, 100, 2600, 5100, 5101}
    assert [r.included for r in blocks.greedy_spacing(s, 2500).orderBy("pos").collect()] == [False, False, True, True, False]
    order = blocks.oriented_order(s.where("pos < 3000"), "chrom", "pos", F.lit(False)).orderBy("pos").collect()
    assert [r.place for r in order] == [3, 2, 1]


def test_components_and_best_clone(spark):
    pairs = spark.createDataFrame([(1, 2, 99.5), (2, 3, 99.1), (5, 6, 99.9), (1, 6, 20.0)], "ind1 long, ind2 long, match_perc double")
    called = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (5, 4), (6, 3)], "ind long, genotyped long")
    got = {(r.comp, r.ind, r.best) for r in graph.clone_groups(pairs, called, 99.0).collect()}
    assert got == {(1, 1, 3), (1, 2, 3), (1, 3, 3), (5, 5, 5), (5, 6, 5)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.comp for r in graph.connected_components(chain).collect()} == {0}


def test_neighbour_joining_finds_a_known_tree(spark):
    d = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 9.0), ("a", "d", 9.0), ("b", "c", 10.0), ("b", "d", 10.0), ("c", "d", 8.0)], "ind1 string, ind2 string, d double")
    lengths = {r.child: r.length for r in graph.neighbour_joining(d).collect()}
    assert (lengths["a"], lengths["b"], lengths["c"], lengths["d"]) == (2.0, 3.0, 4.0, 4.0)


def test_lists(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "ord long, k string")
    listed = spark.createDataFrame([("a",), ("z",)], "k string")
    kept, gone = lists.include(rows, listed, "k"), lists.exclude(rows, listed, "k")
    assert {r.ord for r in kept.union(gone).collect()} == {1, 2, 3, 4} and kept.count() == 2
    assert [r.k for r in lists.not_found(listed, rows, "k").collect()] == ["z"]
    assert {(r.k, r.ord) for r in lists.first_per(rows, "k", "ord").collect()} == {("a", 1), ("b", 2), ("c", 4)}
    assert {r.k for r in lists.single_hits(rows, "k").collect()} == {"b", "c"}
    names = spark.createDataFrame([("a", "n")], "k string, new string")
    assert {r.k for r in lists.rename_inner(rows, names, "k", "new").collect()} == {"n"}
    assert {r.k for r in lists.rename_left(rows, names, "k", "new").collect()} == {"n", "b", "c"}
    runs = lists.runs(spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y"), (1, 4, "x")], "f int, ord int, v string"), "v", "ord", "f")
    assert [r.run for r in runs.orderBy("ord").collect()] == [1, 1, 2, 3]


def test_sequences(spark):
    seqs = spark.createDataFrame([("ATGCY",), ("NKR",)], "s string").select("s", sq.reverse_complement(F.col("s")).alias("r"), sq.reverse_complement(sq.reverse_complement(F.col("s"))).alias("rr")).collect()
    assert seqs[0].r == "RGCAT" and all(r.s == r.rr for r in seqs)
    loci = spark.createDataFrame([(1, 1, "a", "ACGT"), (1, 2, "a", "ACGA"), (1, 3, "b", "AC-T"), (2, 1, "b", "GG")], "locus long, seq_ord long, sample string, seq string")
    assert {(r.locus, r.grp, r.seq) for r in sequences.consensus(loci.withColumnRenamed("sample", "grp")).collect()} == {(1, "a", "ACGN"), (1, "b", "AC-T"), (2, "b", "GG")}
    assert {(r["sample"], r.n_seqs, r.seq) for r in sequences.concatenated(loci).collect()} == {("a", 1, "ACGTNN"), ("b", 2, "AC-TGG")}
    assert {(r.locus, r.seq) for r in sequences.reference_sequences(loci, F.col("sample") == "a").collect()} == {(1, "ACGT")}
    two = spark.createDataFrame([(1, "GAATTCGAATTC", "GAATTCGAACTC")], "locus long, seq1 string, seq2 string")
    enzymes = spark.createDataFrame([("EcoRI", "GAATTC")], "enzyme string, site string")
    assert [r["at"] for r in sequences.caps_sites(two, enzymes).collect()] == [7]
    assert spark.range(1).select(sq.remapped(F.lit(100), F.lit(50), F.lit(5), F.lit(0)).alias("f"), sq.remapped(F.lit(100), F.lit(50), F.lit(5), F.lit(16)).alias("r")).first() == (104, 144)


def test_small_expressions(spark):
    one = spark.range(1)
    assert one.select(*[gt.phred(F.lit(x)) for x in ("1.2", "0", "x", "0.9")]).first() == ("100", "0", ".", "10.0")
    assert one.select(gt.pair_label(F.lit("b"), F.lit("a")), gt.pair_label(F.lit("a"), F.lit("a")), gt.pair_label(F.lit(None), F.lit("a"))).first() == ("a-b", "a", "NA")
    assert one.select(*[gt.structure_code(F.lit(x)) for x in "ATGC."]).first() == (10, 11, 12, 13, -9)
    assert one.select(annotate.cluster_label(F.array(F.lit(0.9), F.lit(0.1)), 0.8), annotate.cluster_label(F.array(F.lit(0.5), F.lit(0.5)), 0.5), annotate.cluster_label(F.array(F.lit(0.4), F.lit(0.6)), 0.8)).first() == ("CLUSTER_1", "AMBIGUOUS", "UNASSIGNED")
    assert one.select(annotate.parental_side(F.lit(0.98), 0.98), annotate.parental_side(F.lit(0.99), 0.98), annotate.parental_side(F.lit(0.01), 0.98)).first() == ("admix", "par1", "par2")


def test_converters_round_trip(spark):
    g = calls(spark, [(1, 0, 0, 0, 0, 1), (2, 0, 0, 1, 1, 1)])
    samples = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "ind long, pop long, grp long")
    sites = spark.createDataFrame([(0, 1, 1), (1, 1, 11)], "m long, chrom long, pos long")
    full = convert.dense(g, samples, sites)
    assert {(r.ind, r.line) for r in convert.sample_rows(full, "NA").collect()} == {(1, "1 NA"), (2, "NA 2")}
    assert {(r.pos, r.line) for r in convert.site_rows(full, gt.coded(convert.dose_of(), "NA")).collect()} == {(1, "1 NA"), (11, "NA 2")}
    assert {(r.pos, r.line) for r in convert.site_rows(full, convert.introgress_cell(), ",").collect()} == {(1, "0/1,NA/NA"), (11, "NA/NA,1/1")}
    assert {(r.ind, r.hap, r.line) for r in convert.structure_rows(full, F.lit("A"), F.lit("T")).collect()} == {(1, 1, "10 -9"), (1, 2, "11 -9"), (2, 1, "-9 11"), (2, 2, "-9 11")}


def test_remapping(spark):
    sites = spark.createDataFrame([("l1", 3, "A", "G"), ("l2", 3, "A", "G")], "chrom string, pos int, ref string, alt string")
    fasta = spark.createDataFrame([("l1", "C-ATT"), ("l2", "CCATT")], "name string, seq string")
    mapped = spark.createDataFrame([("l1", 0), ("l2", 16)], "qname string, flag int")
    bases = spark.createDataFrame([("l1", 1, "g", 101, "G"), ("l2", 2, "g", 202, "T")], "qname string, qpos int, genome_chrom string, rpos int, rbase string")
    got = {tuple(r) for r in remap.remap_to_genome(sites, fasta, mapped, bases).collect()}
    assert got == {("l1", 3, "g", 101, "G", "G", "A", "forward_swapped"), ("l2", 3, "g", 202, "T", "T", "C", "reverse_same")}
    assert [r[0] for r in spark.createDataFrame([("0/1:9",), ("0|0",), ("./.",)], "c string").select(remap.flipped(F.col("c"))).collect()] == ["0/1:9", "1|1", "./."]
