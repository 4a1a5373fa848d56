"""Toxicity scores by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings: of the word and of its beginnings, so that
inflected forms of one stem are alike.  Hash buckets that several training texts hold have an
embedding, the others share one that stays zero: single texts' words are not learnt by heart.  The first dimension starts
from how much more often toxic texts hold the bucket than clean ones (in standard errors), so that few labelled
texts are enough to begin with; everything else starts at random.  Filters of widths 1, 2 and 3 run over
the word sequence, each filter's largest response in the text is kept (max pooling after
ReLU), and a logistic layer turns the pooled responses into a score.  Training runs on the
driver over a bounded sample of labelled rows (``SAMPLE`` a class, chosen by a hash of the
id); a clean text's passages of ``CROP`` words are examples of their own, and of those at most ``CLEAN`` a sampled class, drawn anew each
pass, are seen in one pass.  Everything is plain numpy.

A document is scored over its whole text, a long one in pieces.  Because a filter is linear, its response at a
place is a sum of terms of single words, which are worked out once for each hashed word.

The score is calibrated on all labelled rows that are not held out (the share of toxic rows at a
raw output, by pooling adjacent violators), and a threshold for each language is chosen there: the score that gives the
best F1 among the language's labelled rows.  No row's output in these fits comes from a net that was trained on it:
sampled rows are scored by one of ``FOLDS`` nets trained without their part of the sample, other rows by the net that
is used in the end.  Both are fitted on counts of raw outputs in
``BINS`` steps by language and label, so their size does not grow with the rows.  The thresholds go into ``flagged`` by the language that a
separate column holds, if one is given; they never enter the score.

Every text is read and worked through once, where it lies: raw outputs are written first, and labels, calibration and thresholds
meet them without the text, which no shuffle carries.

Defined results: null and empty texts get the score of a text without words; without
labelled rows every score is 0, with one class alone it is that class's value; repeated ids are rows of
their own, of several labels of one id the largest counts; an empty table gives no rows;
extra columns are ignored; whole texts are read, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from .common import WordTable, held_out, map_arrow, sample_labelled, text_pieces, text_slices, worker_state

#: Hash buckets, embedding size, filters of each width, widths.
BUCKETS, EMBED, FILTERS, WIDTHS = 1 << 20, 12, 12, (1, 2, 3)
#: Lengths of beginnings that are hashed beside the word.
BEGINNINGS = (4, 5, 6, 7, 8)
PARTS = 1 + len(BEGINNINGS)
#: A hash bucket has an embedding of its own once this many sampled texts hold it; the others share one that stays zero.
MIN_TEXTS = 4
#: The first dimension at the start: this share of a bucket's standard errors between the classes, and the most that count.
START, MOST = 0.1, 8.0
#: Labelled texts of each class to train on at most, words of a text to train on at a time, passes, learning rate.
SAMPLE, CROP, EPOCHS, RATE = 1500, 400, 14, 0.02
#: Share of a passage's words that a pass leaves out, at random, and the embeddings' learning rate as a share of the others'.
DROP, SLOW = 0.3, 0.2
#: Clean passages in one pass at most, as a multiple of ``SAMPLE``; parts of the sample that calibration leaves out in turn.
CLEAN, FOLDS = 3, 4
#: Padded words in a training batch.
BATCH_WORDS = 24_000
SEED = 5
#: Steps of the raw output, and its bounds, in the counts that calibration and thresholds are fitted on.
BINS, LOGIT = 6000, 30.0
#: Characters of text in one step of a worker.
STEP_CHARS = 600_000


def pieces(words: list[str]) -> np.ndarray:
    """``(word, PARTS)`` hash buckets, letters and digits alone in lower case: the word, and each longer word's beginning of
    4 to 8 letters; -1 where there is none."""
    out = np.full((len(words), PARTS), -1, np.int32)
    for i, w in enumerate(words):
        plain = "".join(filter(str.isalnum, w.lower()))
        parts = [plain, *(plain[:k] + "+" for k in BEGINNINGS if len(plain) > k)]
        out[i, : len(parts)] = [xxhash.xxh64_intdigest(p) % BUCKETS for p in parts]
    return out


class ConvText:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, known: np.ndarray, seed: int = SEED):
        """``known``: the sorted hash buckets that have an embedding; row 0 is for all others."""
        rng = np.random.default_rng(seed)
        self.known = known.astype(np.int64)
        self.embed = rng.normal(0, 0.1, (len(known) + 1, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.out_bias = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.float32(0)
        self.edges, self.levels, self.constant = np.array([-LOGIT, LOGIT]), np.array([0.0, 1.0]), None
        self.tables: np.ndarray | None = None

    def begin(self, held: np.ndarray, n: np.ndarray) -> None:
        """The first dimension from the numbers of texts ``held (class, known bucket)`` of ``n (class)``; filters and the last layer look at it with one sign."""
        share, both = held / n[:, None], held.sum(axis=0) / n.sum()
        error = np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1])) + 1e-9
        self.embed[1:, 0] = START * np.clip((share[1] - share[0]) / error, -MOST, MOST)
        for f in self.filters:
            f[:, 0] = np.abs(f[:, 0])
        self.out = np.abs(self.out)

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """Embedding row of each hash bucket."""
        if not len(self.known):
            return np.zeros(buckets.shape, np.int32)
        at = np.minimum(np.searchsorted(self.known, buckets), len(self.known) - 1)
        return np.where(self.known[at] == buckets, at + 1, 0).astype(np.int32)

    # -- training: sequences padded with bucket -1 -------------------------------------------------
    def _forward(self, ids: np.ndarray):
        real = ids[..., 0] >= 0
        e = reduce(np.add, (self.embed[np.maximum(ids[..., k], 0)] for k in range(PARTS)))
        pooled, kept = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = ids.shape[1] - w + 1
            r = sum(e[:, j : j + n] @ f[j] for j in range(w)) + b
            r = np.where(real[:, w - 1 :, None], np.maximum(r, 0), 0)
            at = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            kept.append(at)
        p = np.hstack(pooled)
        return e, p, kept, 1 / (1 + np.exp(-np.clip(p @ self.out + self.out_bias, -60, 60)))

    @staticmethod
    def batches(order: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        """Batches of at most 32 texts of like length, and of bounded padded size; only a longer text alone exceeds it."""
        out = []
        for at in range(0, len(order), 512):
            some = sorted(order[at : at + 512].tolist(), key=sizes.__getitem__)
            while some:
                n = 1
                while n < min(32, len(some)) and (n + 1) * sizes[some[n]] <= BATCH_WORDS:
                    n += 1
                out.append(np.array(some[:n]))
                some = some[n:]
        return out

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Adam over mini-batches of passages."""
        rng, clean = np.random.default_rng(SEED + 1), np.flatnonzero(labels == 0)
        params = [self.embed, *self.filters, *self.bias, self.out]
        m, v, step = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean())).astype(np.float32)
        for _ in range(epochs):
            left_out = rng.permutation(clean)[CLEAN * SAMPLE :]
            order = np.setdiff1d(rng.permutation(len(texts)), left_out, assume_unique=True)
            for pick in self.batches(rng.permutation(order), [len(t) for t in texts]):
                heard = [texts[i][rng.random(len(texts[i])) >= DROP] for i in pick]
                *grads, g_bias, rows, g_rows = self.gradients(heard, labels[pick], weight[pick], True)
                step += 1
                lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for q, grad in enumerate(grads, 1):
                    m[q] = 0.9 * m[q] + 0.1 * grad
                    v[q] = 0.999 * v[q] + 0.001 * grad * grad
                    params[q] -= (lr * m[q] / (np.sqrt(v[q]) + 1e-8)).astype(np.float32)
                m[0][rows] = 0.9 * m[0][rows] + 0.1 * g_rows
                v[0][rows] = 0.999 * v[0][rows] + 0.001 * g_rows * g_rows
                self.embed[rows] -= (SLOW * lr * m[0][rows] / (np.sqrt(v[0][rows]) + 1e-8)).astype(np.float32)
                self.out_bias -= np.float32(rate * g_bias)

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, embedding: bool = False) -> list:
        """Derivatives of the weighted mean loss by the filters, their biases and the last layer; with ``embedding`` also
        the last bias's, the embedding rows that take part, and theirs."""
        ids = np.full((len(texts), max(WIDTHS) + max(map(len, texts)), PARTS), -1, np.int32)
        for r, t in enumerate(texts):
            ids[r, : len(t)] = t
        e, p, kept, score = self._forward(ids)
        g = (score - labels) * weight / len(texts)
        grads = [np.zeros_like(x) for x in (*self.filters, *self.bias, self.out)]
        grads[-1][:] = p.T @ g
        hit, value = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            gp = g[:, None] * self.out[k * FILTERS : (k + 1) * FILTERS] * (p[:, k * FILTERS : (k + 1) * FILTERS] > 0)
            grads[len(WIDTHS) + k][:] = gp.sum(axis=0)
            for j in range(w):
                at = kept[k] + j
                x = np.take_along_axis(e, at[..., None], 1)  # batch, filter, embedding
                grads[k][j] = np.einsum("bfe,bf->ef", x, gp)
                hit.append(ids[np.arange(len(texts))[:, None], at].reshape(-1, PARTS))
                value.append((gp[..., None] * f[j].T[None]).reshape(-1, EMBED))
        if not embedding:
            return grads
        flat = np.concatenate(hit).ravel()
        whose = np.flatnonzero(flat > 0)
        rows, slot = np.unique(flat[whose], return_inverse=True)
        by_row = np.zeros((len(rows), EMBED), np.float32)
        np.add.at(by_row, slot, np.concatenate(value)[whose // PARTS])
        return [*grads, g.sum(), rows, by_row]

    # -- scoring: whole texts, ragged ---------------------------------------------------------------
    def terms(self, words: list[str]) -> np.ndarray:
        """Each word's terms for every filter and place in it, side by side."""
        if self.tables is None:
            self.tables = np.hstack([self.embed @ f.transpose(1, 0, 2).reshape(EMBED, -1) for f in self.filters])
        return self.tables[self.rows(pieces(words))].sum(axis=1)

    def pooled(self, terms: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each filter's largest response in texts laid end to end, ``sizes`` words each; ``ids`` are rows of ``terms``."""
        n, filled, at = len(ids), np.flatnonzero(sizes), 0
        starts = (np.cumsum(sizes) - sizes)[filled]
        pooled = np.zeros((len(sizes), FILTERS * len(WIDTHS)), np.float32)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n) if n else np.empty(0, int)  # words from here to the text's end
        for k, (w, b) in enumerate(zip(WIDTHS, self.bias, strict=True)):
            if not n:
                continue
            r = terms[ids, at : at + FILTERS]
            for j in range(1, w):
                r[: n - j] += terms[ids[j:], at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            r = np.maximum(r + b, 0)
            r[left < w] = 0
            pooled[filled, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(r, starts, axis=0)
        return pooled

    def raw(self, texts: list[str | None], table: WordTable) -> np.ndarray:
        """Raw outputs of whole texts; ``table`` keeps words' terms."""
        if len(texts) == 1 and len(texts[0] or "") > 2 * STEP_CHARS:
            return self.raw_long(texts[0], table)
        cut = [(t or "").split() for t in texts]
        ids = table.rows([w for ws in cut for w in ws])
        return self.logits(self.pooled(table.values, ids, np.array([len(ws) for ws in cut], np.int64)))

    def raw_long(self, text: str, table: WordTable) -> np.ndarray:
        """The same for one text in pieces, each begun with the words that a filter may reach back to."""
        most, before = np.zeros((1, FILTERS * len(WIDTHS)), np.float32), []
        for piece in text_pieces(text, STEP_CHARS):
            words = before + piece.split()
            ids = table.rows(words)
            if len(ids):
                most = np.maximum(most, self.pooled(table.values, ids, np.array([len(words)])))
            before = words[1 - max(WIDTHS) :]
        return self.logits(most)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return (pooled @ self.out + self.out_bias).astype(float)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        """Shares of toxic rows at the outputs; a hundredth of the score follows the output itself, so that order is kept inside a pool."""
        return 0.99 * np.interp(logits, self.edges, self.levels) + 0.01 / (1 + np.exp(-np.clip(logits, -LOGIT, LOGIT) / 8))


def passages(ids: np.ndarray, label: int, crop: int = CROP) -> list[tuple[np.ndarray, int]]:
    """A clean text's passages are clean each; a toxic text's label holds for the whole, which is kept whole."""
    if label:
        return [(ids, 1)]
    return [(ids[s : s + crop], 0) for s in range(0, max(1, len(ids)), crop)]


def calibrate(logits: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and the share of toxic rows there, never falling: neighbouring outputs are pooled until their shares rise, and a
    pool's share is held from its first output to its last.  ``n`` rows have each output and label; half a row of unknown label is added to each pool."""
    steps, at = np.unique(logits, return_inverse=True)
    toxic, rows = np.bincount(at, n * labels, len(steps)), np.bincount(at, n, len(steps))
    pools: list[list[float]] = []  # toxic rows, rows, first and last output
    for x, k, m in zip(steps.tolist(), toxic.tolist(), rows.tolist(), strict=True):
        pools.append([k, m, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            k2, m2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + k2, pools[-1][1] + m2, pools[-1][2], last]
    level = np.maximum.accumulate([(p[0] + 0.25) / (p[1] + 0.5) for p in pools])
    return np.array([x for p in pools for x in p[2:]]), np.repeat(level, 2)


def best_threshold(logits: np.ndarray, labels: np.ndarray, n: np.ndarray) -> float | None:
    """The raw output with the largest F1, in the middle of the gap below it; None where a class is missing."""
    if not 0 < (n * labels).sum() < n.sum():
        return None
    steps = np.unique(logits)[::-1]
    at = np.searchsorted(-steps, -logits)
    hits, seen = np.cumsum(np.bincount(at, n * labels, len(steps))), np.cumsum(np.bincount(at, n, len(steps)))
    k = int((2 * hits / (seen + hits[-1])).argmax())
    return float((steps[k] + steps[k + 1]) / 2) if k + 1 < len(steps) else float(steps[k] - LOGIT / BINS)


def outputs(models: list[ConvText], rows: DataFrame) -> DataFrame:
    """``(doc_id, lang, output, bin)`` of all rows ``(doc_id, text, lang, net)``: the raw output of the first model, and the
    step that the output of the row's own model, number ``net``, falls in."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = worker_state("toxicity", sent.value, lambda: [WordTable(m.terms, 20_000 if k else 100_000) for k, m in enumerate(sent.value)])
        for part, texts in text_slices(batches, "text", STEP_CHARS):
            net, logits = part.column(3).to_numpy(), sent.value[0].raw(texts, tables[0])
            own = logits.copy()
            for q in np.unique(net[net > 0]).tolist():
                at = np.flatnonzero(net == q)
                own[at] = sent.value[q].raw([texts[i] for i in at], tables[q])
            bins = np.clip((own + LOGIT) / (2 * LOGIT) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(logits), pa.array(bins)], names=["doc_id", "lang", "output", "bin"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows.select("doc_id", "text", "lang", "net"), run, f"doc_id {id_type}, lang string, output double, bin int", "outputs")


def counted(made: DataFrame, known: DataFrame) -> list:
    """``(lang, label, bin, n)`` of the rows that :func:`outputs` made whose id has a label in ``known``."""
    binned = made.select("doc_id", "lang", "bin").join(known, "doc_id")
    return binned.groupBy("lang", "label", "bin").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * BINS rows a language


def settle(model: ConvText, counts: list) -> dict[str, float]:
    """Calibrates the model on the counts; each language's threshold, where it has both classes."""
    logits = (np.array([r["bin"] for r in counts]) + 0.5) / BINS * 2 * LOGIT - LOGIT
    labels, n = np.array([float(r.label) for r in counts]), np.array([float(r.n) for r in counts])
    model.edges, model.levels = calibrate(logits, labels, n)
    names, limits = np.array([str(r.lang) for r in counts]), {}
    for k in sorted({r.lang for r in counts} - {None}):
        at = best_threshold(logits[names == k], labels[names == k], n[names == k])
        if at is not None:
            limits[k] = float(model.calibrated(np.array([at]))[0])
    return limits


def fit(rows: list) -> ConvText:
    """A trained model of sampled rows, not yet calibrated."""
    labels = np.array([r.label for r in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        model = ConvText(np.empty(0, np.int64))
        model.constant = float(labels[0]) if len(rows) else 0.0
        return model
    table, hashed = WordTable(pieces, 60_000), []
    for r in rows:
        ids = table.rows((r.text or "").split())
        hashed.append(table.values[ids] if len(ids) else np.empty((0, PARTS), np.int32))
    held = np.zeros((2, BUCKETS), np.int32)
    for h, y in zip(hashed, labels, strict=True):
        held[int(y), np.unique(h[h >= 0])] += 1
    model = ConvText(np.flatnonzero(held.sum(axis=0) >= MIN_TEXTS))
    model.begin(held[:, model.known], np.array([(labels == 0).sum(), (labels == 1).sum()]))
    texts = [model.rows(hashed.pop(0)) for _ in rows]
    parts = [p for ids, y in zip(texts, labels, strict=True) for p in passages(ids, int(y))]
    model.train([p for p, _ in parts], np.array([y for _, y in parts], np.float32))
    return model


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED + 2)), F.lit(FOLDS)).cast("int")


def calibrated_scores(made: DataFrame, model: ConvText, limits: dict[str, float], threshold: float) -> DataFrame:
    """``(doc_id, score, flagged)`` of the rows that :func:`outputs` made."""
    sent = made.sparkSession.sparkContext.broadcast((model, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bounds = sent.value
        for part in batches:
            scores = m.calibrated(part.column(2).to_numpy())
            least = np.array([bounds.get(x, threshold) for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= least).astype(np.int32))], names=["doc_id", "score", "flagged"])

    id_type = made.schema["doc_id"].dataType.simpleString()
    return map_arrow(made.select("doc_id", "lang", "output"), run, f"doc_id {id_type}, score double, flagged int", "scores")


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", threshold: float = 0.7, lang_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, flagged)``, one row a document; ``predicted`` compares with ``threshold``,
    ``flagged`` with the threshold of the document's language (``threshold`` where there is none)."""
    spark = docs.sparkSession
    lang = [F.col(lang_col).cast("string").alias("lang")] if lang_col and lang_col in docs.columns else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(lang or [F.lit(None).cast("string").alias("lang")]))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out(F.col("doc_id")))
    sample = sample_labelled(rows, known, SAMPLE, SEED, [fold_of(F.col("doc_id")).alias("fold")])
    model = fit(sample)
    if model.constant is not None:
        scored = rows.select("doc_id", F.lit(model.constant).alias("score"), F.lit(int(model.constant >= threshold)).alias("flagged"))
    else:
        nets = [fit([r for r in sample if r.fold != q]) for q in range(FOLDS)]
        able = [q for q in range(FOLDS) if nets[q].constant is None]  # a part without which a class is missing cannot be left out
        which = spark.createDataFrame([(r.doc_id, 1 + able.index(r.fold) if r.fold in able else 0) for r in sample], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, net int")
        netted = rows.join(F.broadcast(which), "doc_id", "left").withColumn("net", F.coalesce("net", F.lit(0)))  # at most 2 * SAMPLE ids
        made = outputs([model, *[nets[q] for q in able]], netted)
        scored = calibrated_scores(made, model, settle(model, counted(made, known)), threshold)
        discard(made)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "flagged")
