"""Concatenate-and-cut packing.

Pass one tokenises every document once and writes its ids with the running offset
inside its partition.  One total a partition (not a document) gives, by a prefix
sum, each partition's place on one global token line.  Pass two cuts that line at
multiples of the window: a document that crosses a cut leaves one boundary record
in each window it touches.  No shuffle of ids, no group, no sort.

Defined results: null or empty text is the separator alone; a null ``doc_id`` is
carried; repeated rows are packed as often as they occur; an empty table gives no
rows; extra columns, whatever their names, are ignored; texts of any length are
tokenised whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, map_arrow, text_slices, worker_state

#: Words kept with their ids in one worker (about 50 MB).
CACHE_WORDS = 250_000
#: Longer words are encoded anew each time.
CACHE_CHARS = 64

# The split of the word tokenizer, and the same split on lower-cased ASCII and Latin-1 letters.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")

def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with, for the Latin-1 letters as they stand in UTF-8."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordEncoder:
    """Ids of whole texts.

    Where the tokenizer drops white space, a token never spans a blank, so a text's ids
    are its words' ids joined, and words are kept in a bounded table.  Only blanks and
    line feeds are taken as cuts.  A new word of ASCII signs and Latin-1 letters is
    split here and handed to the merge model at once; any other word, and any other
    tokenizer's whole text, goes through the full tokenizer.  The way by words is taken only for the very normalizer and
    split that are stated above.
    """

    def __init__(self, blob: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        self.model = self.tokenizer.model
        made = json.loads(blob)
        self.by_word = made.get("normalizer") == NORMALIZER and made.get("pre_tokenizer") == PRE_TOKENIZER
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "HI"[self.dtype.itemsize // 4]
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def full(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def plain(self, word: str) -> bytes:
        ids, known, tokens = [], self.words, self.model.tokenize
        for piece in PLAIN_SPLIT.findall(word.lower()):
            if piece in known:
                ids.append(known[piece])
            else:
                ids.append(array(self.code, [t.id for t in tokens(piece if piece.isascii() else piece.translate(self.letters))]).tobytes())
        return b"".join(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self.full([t or "" for t in texts])
        if len(texts) == 1 and len(texts[0] or "") > SLICE_CHARS:
            return [b"".join(self.encode([piece])[0] for piece in _cut(texts[0]))]
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        fresh = set(chain.from_iterable(cut)) - self.words.keys()
        known = self.words
        if fresh:
            ids = {w: self.plain(w) for w in fresh if PLAIN.fullmatch(w) and "<|" not in w}
            rest = [w for w in fresh if w not in ids]
            ids.update(zip(rest, self.full(rest), strict=True))
            self.words.update((w, b) for w, b in ids.items() if len(w) <= CACHE_CHARS)
            if any(len(w) > CACHE_CHARS for w in fresh):
                known = known | ids
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in cut]


def _cut(text: str) -> Iterator[str]:
    """A long text in pieces that end at a blank or line feed; a piece without one is as long as the word it holds."""
    at = 0
    while at < len(text):
        end = min((x for x in (text.find(c, at + SLICE_CHARS // 2) for c in " \n") if x >= 0), default=len(text) - 1) + 1
        yield text[at:end]
        at = end


def encoder(blob: str) -> WordEncoder:
    """This worker's encoder; Spark reuses workers, so the vocabulary is parsed once a worker."""
    return worker_state("packing", blob, lambda: WordEncoder(blob))


def tokenize(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, part, local_start, n_tokens, ids)``: ids as little-endian integers of 2 or 4 bytes, ``end_id`` last;
    ``local_start`` counts the ids before the row in its partition."""
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at = encoder(blob.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], tok.dtype).tobytes()
        for rows, texts in text_slices(batches, "text"):
            ids = [b + end for b in tok.encode(texts)]
            n = np.array([len(b) // tok.dtype.itemsize for b in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {id_type}, part long, local_start long, n_tokens long, ids binary", "tokens")


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` with ids as little-endian
    unsigned 32-bit integers.  Every sequence but the last is full."""
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    bases = spark.sparkContext.broadcast(base)
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, int(2e6 // max(1, batch.nbytes / max(1, batch.num_rows)))))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                part, local, n = (rows.column(i).to_numpy() for i in (1, 2, 3))
                begin = local + np.array([bases.value[p] for p in part], np.int64)
                first, last = begin // window, (begin + n - 1) // window
                pieces = last - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] + nth
                left = np.maximum(begin[row], sequence * window)
                right = np.minimum((begin + n)[row], (sequence + 1) * window)
                start, length = left - begin[row], right - left
                ids = rows.column(4).to_pylist()
                width = [len(b) // k for b, k in zip(ids, n, strict=True)]
                wide = [np.frombuffer(b, f"<u{w}").astype("<u4").tobytes() for b, w in zip(ids, width, strict=True)]
                out = [wide[r][4 * s : 4 * (s + k)] for r, s, k in zip(row, start, length, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row)), *map(pa.array, (start, length, n[row], sequence, left - sequence * window)), pa.array(out, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return tokens.mapInArrow(cut, f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
