"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Two collections of ``m`` half keys of ``k`` minhashes each are computed (``2*m*k``
minhashes).  Every pair of a half key of the first and one of the second collection
is the key of a table, so ``m*m`` tables of ``2*k`` minhashes each come from about the
square root of the minhashes that as many independent tables would need.  A pair of
similarity ``s`` meets in some table with probability ``(1 - (1 - s**k)**m)**2``: 0.9991
at 0.75 and 0.9999 at 0.8 with the values here.

Tables are made only for half keys that two texts share: a document none of whose
first half keys recurs costs ``m`` rows.  Documents with the same shingle set are one
class from the start.  In each table bucket every member is compared with the
bucket's least member, first only with the least of all its buckets, then with the
others from which it is still separate; last, members of one bucket that are neither
in one component nor compared yet are paired where a bound on their sets' difference
allows a link, and compared.  The bound is exact: a set's shingles are folded into
``SKETCH`` parity bits, and the bits in which two sketches differ cannot outnumber the
shingles in which the sets differ.  So any two that share a bucket end in one component,
or have been compared on full sets, or cannot be linked, while a bucket of n like texts
costs n comparisons and texts that merely share a passage make no pairs.

Comparisons run where the smaller number of rows meets: the sets of the documents that share
a bucket are worked out in a second pass over their texts (all sets, written with the signatures,
would take more disk than the texts) and join the pairs by their larger end; the pairs of a
much-linked member are dealt over several tasks, each with one copy of its set.  Up to
``common.BROADCAST_IDS`` such documents the second pass moves no text.  What is left of one bucket is
held against itself inside one join task, by the bound; only pairs that pass it become rows.

Documents are rows here, told apart by a row number; ids are only reported.

Defined results: words are cut at the ASCII blanks; fewer words than a shingle make
the whole sequence the only one; null, empty and blank texts have the empty set and
are linked with nothing; a null ``doc_id`` stays alone, with a null component;
rows that repeat an id are documents of their own, so each has the component of its own text, and ``kept`` is
true for all of a component's rows with its smallest id (``first`` for one of them); an empty table gives no rows; extra columns
are ignored; whole texts are read, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import discard, materialize
from .common import WordTable, bounded_broadcast, map_arrow, numbered_rows, text_pieces, text_slices, worker_state

WORDS = 5
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
HALF_KEYS, HALF_SIZE = 14, 3
#: 64-bit words of a set's parity sketch.
SKETCH = 32
#: Pairs of one member compared in one task, about.
HUB = 256

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (multiply and shift)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (64 bits), A-Z lower-cased, words cut at ASCII blanks."""
    table = worker_state("minhash", None, lambda: WordTable(_hash_words))
    odd = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & _MASK) for j in range(words)]
    out = []
    for text in texts:
        parts = []
        for piece in text_pieces(text or b""):
            ids = table.rows(piece.lower().split())
            if len(ids):
                parts.append(table.values[ids])
        h = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if not len(h):
            out.append(h)
            continue
        k, n = min(len(h), words), max(1, len(h) - words + 1)
        made = np.empty(n, np.uint64)
        for at in range(0, n, 1 << 20):
            some = min(1 << 20, n - at)
            total = np.full(some, k, np.uint64)
            for j in range(k):
                total = _mix(total + h[at + j : at + j + some] * odd[j])
            made[at : at + some] = total
        out.append(np.unique(made))
    return out


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def half_keys(shingles: np.ndarray, m: int = HALF_KEYS, k: int = HALF_SIZE) -> np.ndarray:
    """``2*m`` half keys of ``k`` minhashes each: the first collection, then the second."""
    a, b = _coefficients(2 * m * k)
    least = np.full(2 * m * k, _MASK, np.uint64)
    for start in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[start : start + 4096, None] * a + b).min(axis=0))
    groups = least.reshape(2 * m, k)
    key = np.arange(2 * m, dtype=np.uint64)
    for j in range(k):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + groups[:, j])
    return key


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """The set folded into ``64 * SKETCH`` bits, each the parity of the shingles that fall on it."""
    bits = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def may_link(threshold: int) -> Column:
    """Whether the sketches and sizes of the sides ``x`` and ``y`` of a join allow a link: with difference ``d`` it needs
    ``d * (100 + threshold) <= (|x| + |y|) * (100 - threshold)``, and the sketches' difference is at most ``d``."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH)])
    return differ * (100 + threshold) <= (F.col("x.n_shingles") + F.col("y.n_shingles")) * (100 - threshold)


def signatures(texts: DataFrame, *, words: int = WORDS, m: int = HALF_KEYS, k: int = HALF_SIZE) -> DataFrame:
    """``(doc_id, row, n_shingles, set1, set2, first, second, sketch)`` of ``texts (doc_id, row, text)``, written: a 128-bit
    digest of the set, both half-key collections and the parity sketch."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "text"):
            sets = shingle_sets(texts, words)
            keys = [half_keys(s, m, k).view(np.int64) if len(s) else None for s in sets]
            digest = np.array([[_mix(s).sum(dtype=np.uint64), _mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
            lists = [pa.array([None if x is None else x[part] for x in keys], pa.list_(pa.int64())) for part in (slice(0, m), slice(m, None))]
            sketches = pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), *lists, sketches],
                names=["doc_id", "row", "n_shingles", "set1", "set2", "first", "second", "sketch"],
            )

    schema = f"doc_id {id_type}, row long, n_shingles long, set1 long, set2 long, first array<long>, second array<long>, sketch array<long>"
    return map_arrow(texts, run, schema, "signatures")


def full_sets(texts: DataFrame, needed: DataFrame, words: int = WORDS) -> DataFrame:
    """``(row, shingles)``, written: the sorted sets of the rows that ``needed (row)`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, whole in text_slices(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(whole, words)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "shingles"])

    return map_arrow(texts.select("row", "text").join(bounded_broadcast(needed), "row", "left_semi"), run, "row long, shingles array<long>", "sets")


def bucket_members(reps: DataFrame) -> DataFrame:
    """``(key, row, n_shingles, rep)`` of all tables' buckets that at least two classes share."""
    first = reps.select("row", F.posexplode("first").alias("i", "half"))
    shared = first.groupBy("i", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "half")
    live = first.join(shared, ["i", "half"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("i", "half")).alias("halves"))
    second = reps.select("row", "n_shingles", "second").join(live, "row")
    crossed = second.select("row", "n_shingles", "second", F.explode("halves").alias("f")).select("row", "n_shingles", "f", F.posexplode("second").alias("j", "s"))
    keys = crossed.select(F.xxhash64("f.i", "f.half", "j", "s").alias("key"), "row", "n_shingles")
    keys = materialize(keys, "tables")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("rep")).where("n > 1").select("key", "rep")
    return keys.join(buckets, "key")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets meet the threshold, with their intersection.

    The pairs of one ``a`` are dealt over tasks, at most some ``HUB`` to each, which have a copy of its set each.
    """
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / HUB).cast("int").alias("parts"))
    dealt = pairs.join(hubs.where("parts > 1"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    left = hubs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = dealt.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(left, ["a", "part"])
    common = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return common.where(100 * F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "common")


def bucket_pairs(rest: DataFrame, threshold: int) -> DataFrame:
    """``(a, b)``: members of one bucket in unlike components whose sketches allow a link; the bound is part of the join, which makes no other rows."""
    x, y = rest.alias("x"), rest.alias("y")
    apart_yet = (F.col("x.key") == F.col("y.key")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.comp") != F.col("y.comp"))
    return x.join(y, apart_yet & may_link(threshold)).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()


def minhash_components(docs: DataFrame, *, words: int = WORDS, threshold: int = THRESHOLD, m: int = HALF_KEYS, k: int = HALF_SIZE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, n_shingles, component_id, kept, first)``, one row a document.  ``kept`` marks the component's smallest
    id, ``first`` the one row of the component with the smallest id and row number (a row that is linked with nothing is its own)."""
    marked, number = (docs, row_col) if row_col else numbered_rows(docs)
    texts = marked.select(F.col(id_col).alias("doc_id"), F.col(number).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))
    sig = signatures(texts, words=words, m=m, k=k)
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("set1", "set2").agg(F.min("row").alias("rep"), F.min(F.struct("doc_id", "row")).alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    members = materialize(bucket_members(reps), "buckets")

    fits = 100 * F.least("n_shingles", "n_rep") >= threshold * F.greatest("n_shingles", "n_rep")
    stars = members.where("rep <> row").select(F.col("rep").alias("a"), F.col("row").alias("b"), "n_shingles").distinct()
    stars = stars.join(reps.select(F.col("row").alias("a"), F.col("n_shingles").alias("n_rep")), "a").where(fits).select("a", "b")
    stars = materialize(stars, "stars")
    needed = materialize(members.select("row").distinct(), "needed")
    sets = full_sets(texts, needed, words)

    tried = materialize(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    links = materialize(confirm(tried, sets, threshold), "links").select("a", "b")
    comps = connected_components(links)
    more = materialize(apart(stars.join(tried, ["a", "b"], "left_anti"), comps), "more")
    links2 = materialize(confirm(more, sets, threshold), "links").select("a", "b")
    links = links.union(links2)
    if not links2.isEmpty():
        comps = connected_components(links)

    # What a bucket still holds apart: members in other components that were never compared.
    labelled = members.select("key", "row", "n_shingles").join(comps.withColumnRenamed("id", "row"), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi AND n > 2").select("key")
    bits = sig.join(bounded_broadcast(needed), "row", "left_semi").select("row", *[F.element_at("sketch", i + 1).alias(f"s{i}") for i in range(SKETCH)])
    rest = labelled.join(mixed, "key", "left_semi").join(bits, "row")
    pairs = materialize(bucket_pairs(rest, threshold).join(stars, ["a", "b"], "left_anti"), "residue")
    links3 = materialize(confirm(pairs, sets, threshold), "links").select("a", "b")
    if not links3.isEmpty():
        comps = connected_components(links.union(links3))
    for used in (members, needed, sets, labelled, stars, tried, more, pairs):
        discard(used)

    # The smallest id of each component, over all rows of its classes.
    labels = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").where("n > 1 OR comp IS NOT NULL").withColumn("comp", F.coalesce("comp", "rep"))
    least = labels.groupBy("comp").agg(F.min("least").alias("least"))
    groups = labels.select("set1", "set2", "comp").join(least, "comp").select("set1", "set2", "least")
    out = sig.select("doc_id", "row", "n_shingles", "set1", "set2").join(groups, ["set1", "set2"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & F.col("least").isNotNull()
    component = F.when(linked, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.when(linked, F.col("row") == F.col("least.row")).otherwise(True).alias("first"))


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components (a row without links is its own)."""
    a = comps.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = comps.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
