"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts writes some twenty numbers a document; everything after works
on those.  The features ``sqrt(2/D) cos(W z + b)`` approximate a Gaussian kernel on the
standardised statistics.  Each partition of the labelled rows sums its part of the normal
equations, the parts are added up in a tree, and the driver solves one
``D x D`` ridge system whose size does not depend on the data.  Raw scores are calibrated
by pool-adjacent-violators over bins of all labelled rows.

Defined results: every row gets a score between 0 and 1, null and empty texts too (their
statistics are zeros); rows of ``labels`` with null label count as unlabelled,
of several labels of one id the largest counts; without any
labelled row, or with one class alone, the score is that class's rate (0.5 without rows);
repeated ids are rows of their own; an empty table gives no rows; extra columns are
ignored; whole texts are read, of any length, long ones in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import held_out, map_arrow, text_pieces, text_slices

STATISTICS = (
    "log_chars", "log_words", "word_chars", "upper", "digit", "space", "sign", "exclaim", "mark", "pipe", "non_ascii", "distinct_words", "repeat_next",
    "distinct_lines", "log_lines", "line_words", "longest_word", "sign_ends", "upper_words", "sentences", "top_word",
)
#: Number of random features, kernel width in standard deviations, ridge weight a row, bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 6.0, 1e-4, 2048
SEED = 11
#: Partitions' sums that are added up in one step.
FAN = 32

_SIGNS = frozenset("#$%&*+<=>@^_~|{}[]\\/")


def statistics(text: str | None) -> list[float]:
    """The numbers of :data:`STATISTICS` for one text.  Words and lines are counted piece by piece and told apart by their
    hashes (equality inside one text alone), so a long text costs a few numbers a word."""
    t = text or ""
    n, ascii_counts = len(t), np.zeros(128, np.int64)
    word_hashes, k, chars, longest, sign_ends, upper = [], 0, 0, 0, 0, 0
    for piece in text_pieces(t):
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        ascii_counts += np.bincount(codes[codes < 128], minlength=128)
        words = piece.split()
        if words:
            sizes = list(map(len, words))
            k, chars, longest = k + len(words), chars + sum(sizes), max(longest, max(sizes))
            sign_ends += sum(w[-1] in _SIGNS or w[-1] == "!" for w in words)
            upper += sum(map(str.isupper, words))
            word_hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
    if not k:
        return [0.0] * len(STATISTICS)
    count = lambda signs: int(sum(ascii_counts[ord(c)] for c in signs))
    lines = np.array([hash(x) for x in _lines(t)], np.int64)
    hashes = np.concatenate(word_hashes)
    order = np.sort(hashes)
    runs = np.flatnonzero(np.r_[True, order[1:] != order[:-1], True])
    return [
        np.log1p(n), np.log1p(k), chars / k, ascii_counts[65:91].sum() / n, ascii_counts[48:58].sum() / n, count(" \n\t\r") / n, count(_SIGNS) / n, count("!") / n,
        count(".,;:?") / n, count("|") / n, 1 - ascii_counts.sum() / n, (len(runs) - 1) / k, float((hashes[1:] == hashes[:-1]).mean()) if k > 1 else 0.0,
        len(np.unique(lines)) / len(lines), np.log1p(len(lines)), np.log1p(k / len(lines)), np.log1p(longest), sign_ends / k,
        upper / k, count(".") / k, float(np.diff(runs).max()) / k,
    ]


def _lines(text: str) -> Iterator[str]:
    """The lines that are not blank, one at a time."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if (line := text[at:end]).strip():
            yield line
        at = end + 1


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, stats array<double>)``, one row a document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], names=["doc_id", "stats"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {id_type}, stats array<double>", "statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class FourierRidge:
    """Standardisation, random features, ridge weights and calibration; what is sent to the executors."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([phi, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares non-decreasing levels of ``y`` along ``x``, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([yi, ni, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2], last]
    return np.array([e for b in blocks for e in (b[2], b[3])]), np.array([v for b in blocks for v in (b[0], b[0])])


def tree_sum(partial: DataFrame) -> DataFrame:
    """``(part, sums)`` with at most ``FAN`` rows: matrices as bytes, added up ``FAN`` at a time, level by level; a task holds one sum."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(sums.as_buffer())
                totals[part] = totals[part] + one if part in totals else one.copy()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["part", "sums"])

    n = partial.agg(F.max("part")).first()[0]
    while n is not None and n >= FAN:
        n = n // FAN
        dealt = partial.select(F.floor(F.col("part") / FAN).alias("part"), "sums").repartition(n + 1, "part")
        partial = map_arrow(dealt, added, "part long, sums binary", "sums")
    return partial


def fit(labelled: DataFrame, *, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> FourierRidge:
    """Fit on all rows of ``(stats, label)``; the driver receives sums whose size the data do not change."""
    spark = labelled.sparkSession
    k = len(STATISTICS)
    sums = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"), *[f(F.element_at("stats", i + 1)).alias(f"{a}{i}") for i in range(k) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums.n:
        return FourierRidge(np.zeros(k), np.ones(k), features, width)
    mean = np.array([sums[f"m{i}"] for i in range(k)])
    scale = np.array([max(1e-9, sums[f"s{i}"] or 0.0) for i in range(k)])
    model = FourierRidge(mean, np.where(scale > 1e-9, scale, 1.0), features, width)
    if sums.rate in (0.0, 1.0):
        model.levels = np.array([sums.rate])
        return model
    sent = spark.sparkContext.broadcast(model)
    d = features + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            if batch.num_rows:
                phi = sent.value.features(_matrix(batch.column(0)))
                total += phi.T @ np.column_stack([phi, batch.column(1).to_numpy().astype(float)])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    partial = map_arrow(labelled.select("stats", F.col("label").cast("double").alias("label")), parts, "part long, sums binary", "sums")
    equations = np.zeros((d, d + 1))
    for r in tree_sum(partial).collect():  # FAN matrices at most
        equations += np.frombuffer(r.sums).reshape(d, d + 1)
    penalty = ridge * sums.n * np.eye(d)
    penalty[-1, -1] = 0.0
    model.weights = np.linalg.solve(equations[:, :d] + penalty, equations[:, d])
    fitted = spark.sparkContext.broadcast(model)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.clip((fitted.value.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "label"])

    binned = map_arrow(labelled.select("stats", F.col("label").cast("double").alias("label")), raw, "bin int, label double", "bins")
    rows = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y")).orderBy("bin").collect()  # at most BINS rows
    x = np.array([(r["bin"] + 0.5) / BINS * 2 - 0.5 for r in rows])
    model.edges, model.levels = isotonic(x, np.array([r.y for r in rows]), np.array([float(r.n) for r in rows]))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row a document; learnt from labelled rows that are not held out."""
    spark = docs.sparkSession
    stats = document_statistics(docs, id_col=id_col, text_col=text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = materialize(stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("stats", "label"), "labelled")
    model = spark.sparkContext.broadcast(fit(labelled))
    id_type = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    scored = map_arrow(stats, run, f"doc_id {id_type}, score double", "scores")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
