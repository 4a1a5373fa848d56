"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The benchmark is read in blocks of bounded size, each against all documents.  One pass over
the texts writes the documents' words as ids of the block's vocabulary (other words are one
id that matches nothing) and counts in how many documents each gram of the block occurs.
Seeds are chosen by these counts, for grams of three words and of two: all rare grams (those that some
document has, and at most ``RARE_SHARE`` of the documents or ``RARE_LEAST`` of them), and of every ``SPAN`` consecutive grams of an item the
rarest of the others.  Grams that no document has are not weighed, and common grams only against common ones, so a
passage that keeps three words in a row within every six keeps a seed however often it was copied, exactly or edited.
Two-word seeds find copies that were edited more densely; they, and common seeds of three words, count only where two different ones of an
item lie within reach.  A second pass, over
the ids alone, joins documents to items by the seeds, leaves out pairs that share too few
words to reach the threshold (an exact bound), and aligns the others (match +2, mismatch and
gap -1).  A pair is kept if its score reaches ``threshold`` of a perfect one.

Windows are cut by the item's own length: an alignment that reaches the threshold spans at
most ``(3 - 2 * threshold)`` times the item's words.  Longer windows are cut into
overlapping ones, so a step's arrays are bounded by pairs, item and window together.

Defined results: null or empty texts and items match nothing; items shorter than ``n``
words are one gram, their whole; words are letters and digits alone, in lower case, cut
at blanks; a null ``doc_id`` is carried; repeated rows of one id give one row a pair, the best;
items of equal text each have their rows, as have rows of a repeated item id with unlike texts (the best
counts); empty tables give no rows; extra columns are ignored; whole texts are read, of any length.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import WordTable, map_arrow, text_pieces, text_slices, worker_state

#: Words of a seed, of a second seed that must be met twice, and consecutive grams of which the rarest is a seed.
N, PAIR, SPAN = 3, 2, 4
#: A gram is rare if no more than this share of the documents, or this number, have it.
RARE_SHARE, RARE_LEAST = 0.005, 10
#: Least share of a perfect alignment's score.
THRESHOLD = 0.5
MATCH, COST = 2, 1
#: Characters of benchmark text in one block; a block is what is sent to the executors.
BLOCK_CHARS = 8_000_000
#: Cells of one array in a step of the alignment.
STEP_CELLS = 400_000


def normal_word(word: str) -> str:
    word = word.lower()
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


class Block:
    """A part of the benchmark: its vocabulary, its items as word ids, and the sorted keys of its grams by their length."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            words = [w for w in map(normal_word, (text or "").split()) if w]
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32))
        self.n, self.lengths = n, np.array([len(x) for x in self.items], np.int64)
        keys = defaultdict(set)
        for words in self.items:
            for k in {min(n, len(words)), min(PAIR, len(words))}:
                keys[k].update(self.grams(words, k).tolist())
        self.keys = {k: np.array(sorted(v), np.int64) for k, v in sorted(keys.items())}
        starts = np.cumsum([0, *(len(v) for v in self.keys.values())])
        self.first, self.total = dict(zip(self.keys, starts.tolist(), strict=False)), int(starts[-1])

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """Keys of the ``k``-grams; -1 where a word is not in the vocabulary."""
        size = max(1, len(self.vocabulary))
        if len(words) < k:
            return np.empty(0, np.int64)
        total, good = np.zeros(len(words) - k + 1, np.int64), np.ones(len(words) - k + 1, bool)
        for j in range(k):
            part = words[j : len(words) - k + 1 + j]
            total, good = total * size + part, good & (part >= 0)
        return np.where(good, total, -1)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(gram number, position)`` of the block's grams in ``words``."""
        found, at = [], []
        for k, keys in self.keys.items():
            grams = self.grams(words, k)
            where = np.flatnonzero(grams >= 0)
            if len(where):
                some = grams[where]
                place = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
                met = keys[place] == some
                found.append(place[met] + self.first[k])
                at.append(where[met])
        return (np.concatenate(found), np.concatenate(at)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def numbers(self, words: np.ndarray, k: int) -> np.ndarray:
        """The numbers of an item's own ``k``-grams, in its order."""
        return np.searchsorted(self.keys[k], self.grams(words, k)) + self.first[k]


class Seeds:
    """Gram number to the items it is a seed of, as flat arrays; ``alone`` tells whether one such seed is enough."""

    def __init__(self, block: Block, counts: np.ndarray, rare: float, span: int = SPAN):
        chosen = set()
        for item, words in enumerate(block.items):
            for k in {min(block.n, len(words)), min(PAIR, len(words))}:
                numbers = block.numbers(words, k).tolist()
                enough = len(words) <= PAIR
                chosen.update((g, item, enough or k > PAIR) for g in numbers if 0 < counts[g] <= rare)
                for start in range(max(1, len(numbers) - span + 1)):
                    some = [(counts[g], g) for g in numbers[start : start + span] if counts[g] > rare]
                    if some:
                        chosen.add((min(some)[1], item, enough))
        made = np.array(sorted(chosen), np.int64).reshape(-1, 3)
        self.begin = np.searchsorted(made[:, 0], np.arange(block.total + 1))
        self.item, self.alone = made[:, 1], made[:, 2].astype(bool)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over pairs of word-id sequences, all pairs in step: best score and its last item and window word.

    A row's gaps along the window are a running maximum, so each item word costs a few vector operations.
    """
    rows, width = max(map(len, items)), max(map(len, windows))
    a, b = np.full((len(items), rows), -2, np.int32), np.full((len(items), width), -1, np.int32)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    kind = np.int16 if MATCH * rows + COST * width < 30_000 else np.int32  # scores and their sums with the ramp fit
    ramp = COST * np.arange(width, dtype=kind)
    above = np.zeros((len(items), width + 1), kind)
    best, end_i, end_j = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for i in range(rows):
        score = np.where(b == a[:, i, None], kind(MATCH), kind(-COST))
        here = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] - kind(COST)), kind(0))
        here = np.maximum.accumulate(here + ramp, axis=1) - ramp
        above[:, 1:] = here
        j = here.argmax(axis=1)
        top = here[np.arange(len(items)), j]
        better = top > best
        best[better], end_i[better], end_j[better] = top[better], i, j[better]
    return best, end_i, end_j


def _encode(docs: DataFrame, block) -> DataFrame:
    """``(doc_id, words, grams, n)``: rows of documents that have a gram of the block, their words as ids; and, with null
    words, rows of grams with the number of the task's documents that have them."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        numbers = lambda words: np.fromiter((b.vocabulary.get(x, -1) if (x := normal_word(w)) else -2 for w in words), np.int32, len(words))
        counts, id_kind = np.zeros(b.total, np.int64), None
        for rows, texts in text_slices(batches, "text"):
            table, id_kind = worker_state("decontam", b, lambda: WordTable(numbers)), rows.schema.field(0).type
            row, words = [], []
            for r, text in enumerate(texts):
                parts = []
                for piece in text_pieces(text or ""):
                    ids = table.rows(piece.split())
                    if len(ids):
                        v = table.values[ids]
                        parts.append(v[v != -2])
                v = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int32)
                found = np.unique(b.find(v)[0])
                if len(found):
                    counts[found] += 1
                    row.append(r), words.append(v)
            none = pa.nulls(len(row), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row, pa.int64())), pa.array(words, pa.list_(pa.int32())), none, none], names=["doc_id", "words", "grams", "n"])
        seen = np.flatnonzero(counts).astype(np.int32)
        for at in range(0, len(seen), 100_000):
            lists = [pa.array([x], pa.list_(pa.int32())) for x in (seen[at : at + 100_000], counts[seen[at : at + 100_000]].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), pa.nulls(1, pa.list_(pa.int32())), *lists], names=["doc_id", "words", "grams", "n"])

    return map_arrow(docs, run, f"doc_id {id_type}, words array<int>, grams array<int>, n array<int>", "words")


def windows_of(block: Block, seeds: Seeds, words: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """``(item, start, end)``: where an alignment of the item may lie in ``words``, by the seeds."""
    grams, places = block.find(words)
    n = seeds.begin[grams + 1] - seeds.begin[grams]
    hit = np.repeat(np.arange(len(grams)), n)
    if not len(hit):
        return []
    row = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + seeds.begin[grams[hit]]
    item, place, gram, alone = seeds.item[row], places[hit], grams[hit], seeds.alone[row]
    span = np.ceil((3 - 2 * threshold) * block.lengths[item]).astype(np.int64)
    order = np.argsort(item * (len(words) + 1) + place)
    item, place, gram, alone, span = (x[order] for x in (item, place, gram, alone, span))
    # Other seeds need a different one of the item within the span.
    near = (item[1:] == item[:-1]) & (place[1:] - place[:-1] <= span[1:]) & (gram[1:] != gram[:-1])
    alone[1:] |= near
    alone[:-1] |= near
    item, place, span = (x[alone] for x in (item, place, span))
    if not len(item):
        return []
    begins = np.r_[True, (item[1:] != item[:-1]) | (place[1:] - place[:-1] > 2 * span[1:])]
    first = np.flatnonzero(begins)
    last = np.r_[first[1:], len(item)] - 1
    out = []
    for i, start, end, s in zip(item[first].tolist(), (place[first] - span[first]).tolist(), (place[last] + span[last]).tolist(), span[first].tolist(), strict=True):
        start, end = max(0, start), min(len(words), end)
        while end - start > 8 * s:  # overlapping by a span, so that an alignment lies in one of them
            out.append((i, start, start + 4 * s))
            start += 3 * s
        out.append((i, start, end))
    return out


def can_reach(items: list[np.ndarray], windows: list[np.ndarray], vocabulary: int, threshold: float) -> np.ndarray:
    """Whether a window shares enough words with its item, each as often as both have it: a score needs ``threshold`` of the item in matches."""
    def counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.repeat(np.arange(len(texts)) * (vocabulary + 1), [len(x) for x in texts]) + np.concatenate(texts)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, len(keys)])

    able = np.array([math.ceil(threshold * len(x) - 1e-9) for x in items])
    known, often = counted(items)
    words = [w[w >= 0] for w in windows]
    keys, n = counted(words) if sum(map(len, words)) else (np.empty(0, np.int64), np.empty(0, np.int64))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    met = known[at] == keys
    return np.bincount(keys[met] // (vocabulary + 1), np.minimum(often[at[met]], n[met]), len(items)) >= able


def _align(encoded: DataFrame, block, seeds, threshold: float) -> DataFrame:
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def scored(b: Block, todo: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple]:
        items, windows = [b.items[i] for _, i, _, _ in todo], [w for _, _, _, w in todo]
        todo = [x for x, able in zip(todo, can_reach(items, windows, len(b.vocabulary), threshold), strict=True) if able]
        todo.sort(key=lambda x: max(len(x[3]), len(b.items[x[1]])))
        while todo:
            take, size = 1, lambda x: max(len(x[3]), len(b.items[x[1]]))
            while take < len(todo) and (take + 1) * size(todo[take]) <= STEP_CELLS:
                take += 1
            group, todo = todo[:take], todo[take:]
            items = [b.items[i] for _, i, _, _ in group]
            best, end_i, end_j = align(items, [w for *_, w in group])
            good = [k for k in range(len(group)) if best[k] >= threshold * MATCH * len(items[k])]
            if good:
                _, back_i, back_j = align([items[k][: end_i[k] + 1][::-1] for k in good], [group[k][3][: end_j[k] + 1][::-1] for k in good])
                for k, bi, bj in zip(good, back_i.tolist(), back_j.tolist(), strict=True):
                    r, item, start, _ = group[k]
                    i, j = int(end_i[k]), int(end_j[k])
                    yield r, b.ids[item], float(best[k]) / (MATCH * len(items[k])), start + j - bj, start + j + 1, i - bi, i + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, s = block.value, seeds.value
        for batch in batches:
            column, out, todo, cells = batch.column(1), [], [], 0
            for r in range(batch.num_rows):
                words = column[r].values.to_numpy()
                for item, start, end in windows_of(b, s, words, threshold):
                    todo.append((r, item, start, words[start:end]))
                    cells += end - start + len(b.items[item])
                    if cells > 2 * STEP_CELLS:
                        out += scored(b, todo)
                        todo, cells = [], 0
            if todo:
                out += scored(b, todo)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=["doc_id", "item_id", "score", "doc_from", "doc_to", "item_from", "item_to"])

    return map_arrow(encoded.where("words IS NOT NULL").select("doc_id", "words"), run, f"doc_id {id_type}, item_id long, score double, doc_from long, doc_to long, item_from long, item_to long", "leaks")


def benchmark_blocks(benchmark: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark as lists of bounded text size, streamed one partition at a time."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, n: int = N, span: int = SPAN, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, doc_from, doc_to, item_from, item_to)``: a document and an item whose best alignment
    reaches the threshold, with the aligned words of both (ends exclusive)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rare = max(RARE_LEAST, RARE_SHARE * rows.count())
    found = [spark.createDataFrame([], f"doc_id {id_type}, item_id long, score double, doc_from long, doc_to long, item_from long, item_to long")]
    for items in benchmark_blocks(benchmark, block_chars, item_col, item_text_col):
        made = Block(items, n)
        if not made.items:
            continue
        block = spark.sparkContext.broadcast(made)
        encoded = _encode(rows, block)
        each = encoded.where("grams IS NOT NULL").select(F.inline(F.arrays_zip("grams", "n"))).groupBy("grams").agg(F.sum("n").alias("n"))
        counts = np.zeros(made.total, np.int64)
        for gram, docs_with in each.toLocalIterator():  # as many as the block has grams
            counts[gram] = docs_with
        seeds = spark.sparkContext.broadcast(Seeds(made, counts, rare, span))
        found.append(_align(encoded, block, seeds, threshold))
        discard(encoded)
    best = reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "doc_from", "doc_to", "item_from", "item_to")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")
