"""Samples, mappings, hits and annotations: assignments, clusters, best hits, terms, crosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parental_side(q: Column, cut: float) -> Column:
    """``par1`` above the cut, ``par2`` below one minus it, else ``admix``; both strict."""
    return F.when(q > cut, "par1").when(q < F.lit(1.0) - F.lit(cut), "par2").otherwise("admix")


def cluster_label(qs: Column, cut: float, prefix: Column | str = "CLUSTER") -> Column:
    """``prefix_k`` if exactly one share reaches the cut, AMBIGUOUS for more, UNASSIGNED for none."""
    hits = F.filter(F.transform(qs, lambda q, i: F.struct((i + 1).alias("k"), q.alias("q"))), lambda x: x["q"] >= cut)
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(F.size(hits) == 1, F.concat(head, F.lit("_"), hits[0]["k"].cast("string"))).when(F.size(hits) > 1, "AMBIGUOUS").otherwise("UNASSIGNED")


def toggled(samples: DataFrame, order: str, pops: list[str]) -> DataFrame:
    """The i-th sample gets the (i mod k)-th population in order."""
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))  # a sample list
    return samples.withColumn("new_pop", F.element_at(F.array(*map(F.lit, sorted(pops))), ((n - 1) % len(pops) + 1).cast("int")))


def chance_pop(sample: Column, pops: list[str], seed: int) -> Column:
    """A population by chance that the seed and the sample fix."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", sample.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, sorted(pops))), (draw % len(pops) + 1).cast("int"))


def parental_pairs(samples: DataFrame, first: Column, second: Column, n: int, seed: int) -> DataFrame:
    """``(cross_id, par1, par2)``: the first ``n`` samples of both parents in an order by chance that the seed fixes."""
    def drawn(side: Column, name: str) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.col("ind").cast("string"), F.lit(str(seed))))
        top = samples.where(side).select("ind", order.alias("o")).orderBy("o", "ind").limit(n)  # n samples are what is asked for
        return top.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("o", "ind")).cast("long").alias("cross_id"), F.col("ind").alias(name))

    return drawn(first, "par1").join(drawn(second, "par2"), "cross_id").select("cross_id", "par1", "par2")


def crossed(g: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """``(cross_id, chrom, pos, call)``: for each pair of parents one allele of each by chance, sorted; ./. where one lacks the call."""
    first = pairs.join(g.select(F.col("ind").alias("par1"), "chrom", "pos", F.col("a1").alias("x1"), F.col("a2").alias("x2")), "par1")
    both = first.join(g.select(F.col("ind").alias("par2"), "chrom", "pos", F.col("a1").alias("y1"), F.col("a2").alias("y2")), ["par2", "chrom", "pos"], "left")

    def pick(side: str, a: str, b: str) -> Column:
        draw = F.substring(F.md5(F.concat_ws(":", F.col("cross_id").cast("string"), F.col("chrom").cast("string"), F.col("pos").cast("string"), F.lit(side), F.lit(str(seed)))), 1, 1)
        return F.when(draw < "8", F.col(a)).otherwise(F.col(b))

    one, two = pick("1", "x1", "x2"), pick("2", "y1", "y2")
    call = F.coalesce(F.when(one.isNotNull() & two.isNotNull(), F.concat_ws("/", F.least(one, two).cast("string"), F.greatest(one, two).cast("string"))), F.lit("./."))
    return both.select("cross_id", "chrom", "pos", call.alias("call"))


def best_k(q: DataFrame, cut: float = 0.5) -> DataFrame:
    """Per replicate the clusters in which some population's mean (median) share exceeds the cut, then median and maximum over replicates.

    ``q`` has ``replicate, cluster, pop, q``.
    """
    per_pop = q.groupBy("replicate", "cluster", "pop").agg(F.avg("q").alias("m"), F.percentile("q", F.lit(0.5)).alias("md"))
    most = per_pop.groupBy("replicate", "cluster").agg(F.max("m").alias("m"), F.max("md").alias("md"))
    used = most.groupBy("replicate").agg(F.count_if(F.col("m") > cut).alias("k"), F.count_if(F.col("md") > cut).alias("kd"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    return used.agg(half("k").alias("med_mea_k"), F.max("k").alias("max_mea_k"), half("kd").alias("med_med_k"), F.max("kd").alias("max_med_k"))


def terms(genes: DataFrame) -> DataFrame:
    """``(go_id, description, genes)``: terms of ``desc [GO:id]; ...`` with their genes in file order (``ord, gene, said``)."""
    each = genes.select("ord", "gene", F.explode(F.split("said", ";")).alias("part"))
    parsed = each.select("ord", "gene", F.regexp_extract("part", r"\[(GO:[0-9]+)\]", 1).alias("go_id"), F.trim(F.regexp_extract("part", r"^(.*?)\[GO:", 1)).alias("description")).where("go_id <> ''")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "gene"))), lambda x: x.gene), " ")
    return parsed.groupBy("go_id").agg(F.min_by("description", "ord").alias("description"), names.alias("genes"))


def hit_summary(hits: DataFrame) -> DataFrame:
    """Number of hits, smallest length, identities and percent identity (0 without hits)."""
    least = [F.coalesce(F.min(c), F.lit(0)).alias(f"min_{c}") for c in ("length", "nident", "pident")]
    return hits.agg(F.count(F.lit(1)).alias("n_hits"), *least)


def percentile_bin(fst: DataFrame, low: float, high: float) -> DataFrame:
    """Loci whose Fst lies in the exact percentile range, the lower bound included."""
    bounds = fst.agg(F.percentile("fst", F.lit(low / 100)).alias("lo"), F.percentile("fst", F.lit(high / 100)).alias("hi"))
    return fst.crossJoin(F.broadcast(bounds)).where("fst >= lo AND fst < hi").drop("lo", "hi")


def cluster_sizes(members: DataFrame, least: int) -> DataFrame:
    """Clusters ``(cluster, ord, name, size, seq)`` of at least ``least`` reads: their sum, first name and last sequence."""
    return members.groupBy("cluster").agg(F.sum("size").alias("size"), F.min_by("name", "ord").alias("name"), F.max_by("seq", "ord").alias("seq")).where(F.col("size") >= least)
