"""Shared plumbing of the text operators: row numbers, folds, samples, text batches and word tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Text handed to one step of a Python operator, in characters; only a text that is longer by itself exceeds it.
SLICE_CHARS = 1_000_000
#: Characters of one sampled text at most.
SAMPLE_CHARS = 50_000

_BLANK, _BLANK_BYTES = re.compile(r"\s"), re.compile(rb"\s")


#: Row numbers that are sent to every executor at most (some 30 MB); beyond it both sides are dealt by row.
BROADCAST_IDS = 500_000
#: Bits of a row number that hold the row's place in its file; the others tell the file.
PLACE_BITS = 26


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the table is rows of Parquet files, at most projected and filtered, so that each has a place of its own in a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.simpleString(100).lower() and bool(docs.inputFiles())


def numbered_rows(docs: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``docs`` with a long column that is different in every row and the same in every reading, and that column's name
    (``name``, with more underscores where the table has such a column).

    Rows read from Parquet are told apart by their file's hash and their place in the file, so nothing is written; that
    hashes are distinct and places fit is checked first, without reading a column.  Other tables are numbered and
    written once.
    """
    while name in docs.columns:
        name = "_" + name
    if not _plain_scan(docs):
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    files = docs.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max("_metadata.row_index").alias("last"))
    files = materialize(files, "files")
    for salt in range(8) if files.where(F.col("last") >= 1 << PLACE_BITS).isEmpty() else ():
        number = lambda path: F.shiftleft(F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(1 << (63 - PLACE_BITS))), PLACE_BITS)  # noqa: B023, E731
        if files.groupBy(number("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            discard(files)
            return docs.select("*", (number("_metadata.file_path") + F.col("_metadata.row_index")).alias(name)), name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without_rows(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``docs`` (numbered in the column ``row``) without the rows that ``dropped (row)`` lists, and without that column.

    The list is written and counted first.  Up to ``BROADCAST_IDS`` rows it is broadcast
    and no text moves; a longer list is joined by a shuffle on the row number.
    """
    rows = materialize(dropped.select(F.col(row)), "dropped")
    return docs.join(bounded_broadcast(rows), row, "left_anti").drop(row)


def bounded_broadcast(table: DataFrame) -> DataFrame:
    """``table``, marked for broadcast if it has ``BROADCAST_IDS`` rows at most (counted; it should be a written one)."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is the held-out fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_fold(doc_id) == 1, F.lit(False))


#: Rows and bytes of one Arrow batch at most; the JVM and the worker each hold a few at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000


@contextmanager
def small_batches(spark: SparkSession):
    """Batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes inside; the session's own limits are put back after.

    Texts differ in length a thousandfold, so the default of 10,000 rows a batch would bound no memory.  Lower limits of the session stay.
    """
    conf, units, before = spark.conf, {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}, {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"(\d+)([kmg]?)b?$", conf.get(key).lower())
        if not now or not 0 < int(now[1]) * units[now[2]] <= most:
            before[key] = conf.get(key)
            conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)


def map_arrow(df: DataFrame, run, schema, name: str) -> DataFrame:
    """``mapInArrow`` over small batches, written at once: the workers' results are made once, however often they are read."""
    with small_batches(df.sparkSession):
        return materialize(df.mapInArrow(run, schema), name)


def text_pieces(text, limit: int = SLICE_CHARS) -> Iterator:
    """A text (or its bytes) in pieces of about ``limit`` characters that begin and end at blanks: what splits at blanks
    gives the same words piece by piece, while only one piece's words are held."""
    if len(text) <= limit:
        yield text
        return
    blank, at = (_BLANK_BYTES if isinstance(text, bytes) else _BLANK), 0
    while at < len(text):
        met = blank.search(text, at + limit)
        end = met.end() if met else len(text)
        yield text[at:end]
        at = end


def text_slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` characters, so memory is bounded by
    the slice and not by the number of rows in a batch.  Yields the slice and its texts as Python values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = column.nbytes / max(1, len(column))
        step = max(1, min(batch.num_rows, int(limit // max(1.0, sizes))))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, part.column(part.schema.get_field_index(text)).to_pylist()
    pa.default_memory_pool().release_unused()  # an idle worker keeps no buffers of the task before


def sample_labelled(docs: DataFrame, known: DataFrame, per_label: int, seed: int, extra: list[str] | None = None, chars: int = SAMPLE_CHARS) -> list:
    """Rows ``(doc_id, label, text, *extra)`` of at most ``per_label`` documents a label, chosen by a hash of the id.

    ``docs`` has ``doc_id, text``, ``known`` has ``doc_id, label`` with one row an id.  Labels are counted first; the ids
    under a hash bound that leaves about the wanted number are ordered and cut, all labels in one job.  Of a repeated id
    one text is taken (the least), of a text longer than ``chars`` one passage of that size at a place its id
    tells, so that the driver holds at most ``per_label * labels`` passages.
    """
    spark = docs.sparkSession
    ids = materialize(docs.select("doc_id").join(known, "doc_id").select("doc_id", "label"), "sample-ids")
    order, steps = F.xxhash64("doc_id", F.lit(seed)), 1 << 40
    counts = ids.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.2 * per_label + 50) / F.col("n"))
    near = ids.join(counts, "label").where(F.pmod(order, F.lit(steps)) < share * steps).select("doc_id", "label", order.alias("o")).distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("o", "doc_id"))  # some 1.2 * per_label ids a label are left
    chosen = [(r.doc_id, r.label) for r in near.withColumn("k", place).where(F.col("k") <= per_label).select("doc_id", "label").collect()]
    discard(ids)
    if not chosen:
        return []
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label {known.schema['label'].dataType.simpleString()}"
    small = F.broadcast(spark.createDataFrame(sorted(set(chosen)), schema))  # at most per_label ids a label
    start = F.pmod(order, F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    passage = F.when(F.length("text") > chars, F.substring("text", start, F.lit(chars))).otherwise(F.col("text"))
    one = docs.join(small, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(passage.alias("text"), *(extra or []))).alias("one"))
    return one.select("doc_id", "label", "one.*").orderBy("doc_id").collect()


_state: dict = {}


def worker_state(owner: str, key: object, make) -> dict:
    """What an operator keeps in a Python worker: made anew when ``key`` changes, and dropped when another operator
    runs in the worker (Spark reuses workers), so that the memory of several operators never adds up."""
    if _state.get("owner") != owner or _state.get("key") is not key:
        _state.clear()
        _state.update(owner=owner, key=key, value=make())
    return _state["value"]


class WordTable:
    """Ids of words, given in order of first sight, with values worked out once a word.

    ``fill(words)`` returns one row of values a word.  The table is emptied when it
    holds ``limit`` words, so a worker's memory is bounded whatever the vocabulary;
    results never depend on what is cached.
    """

    def __init__(self, fill, limit: int = 100_000):
        self.fill, self.limit = fill, limit
        self.ids: dict = {}
        self.values = None

    def rows(self, words: list):
        """Integer ids of ``words`` (valid for :attr:`values` until the next call) as an int32 array."""
        import numpy as np

        if len(self.ids) > self.limit:
            self.ids, self.values = {}, None
        fresh = [w for w in dict.fromkeys(words) if w not in self.ids]
        if fresh:
            made = self.fill(fresh)
            n = len(self.ids)
            self.ids.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            if self.values is None:
                self.values = np.empty((max(4096, 2 * len(fresh)), *made.shape[1:]), made.dtype)
            if n + len(fresh) > len(self.values):
                grown = np.empty((2 * (n + len(fresh)), *made.shape[1:]), made.dtype)
                grown[:n] = self.values[:n]
                self.values = grown
            self.values[n : n + len(fresh)] = made
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
