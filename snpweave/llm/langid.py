"""Language identification by a linear-chain conditional random field over words.

States are the learnt languages.  A word's features are its beginnings and endings, its
letter n-grams and its place in the languages' lexicons (frequent words of the training
sample); a word's score for a language is the sum of its features' weights, and learnt
transitions join neighbouring words.  Training maximises the conditional likelihood by
forward-backward and Adagrad over sequences spliced from stretches of labelled documents
of different languages, so that switches are seen where they are known.

A text's words are labelled by their marginals from forward-backward over the whole text.
Long texts are cut into segments whose transition products are worked out side by side
and then chained, which gives the same marginals as one long pass.  A document's language
is the one with the largest sum of marginals over its words with letters, its score the
mean of that marginal.

A long text is worked through in pieces: a first pass chains their transition products, a
second gives each piece's marginals from what comes in at both its ends.

Every language that has labelled rows is learnt.  ``FEATURES`` is the model's size: the features that most sampled texts
have; rarer ones are not used.

Defined results: null texts and texts without a letter give ``und`` with score 0, as does
everything where no labelled row exists; rows with null language are never learnt from;
ties go to the first language in order; repeated ids are rows of their own (one of their texts may be
sampled, with the least of their labels); an empty table gives no rows; extra columns are ignored; whole texts are read, of any length.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, held_out, map_arrow, numbered_rows, sample_labelled, text_pieces, text_slices, without_rows, worker_state

UNKNOWN = "und"
#: Documents of each language to learn from at most, features kept.
SAMPLE, FEATURES = 300, 60_000
#: Frequent words of a language in its lexicon.
LEXICON = 100
#: Spliced training sequences, their words, mean stretch of one language, passes, learning rate, weight decay.
SEQUENCES, LENGTH, STRETCH, EPOCHS, RATE, DECAY = 2400, 60, 15, 4, 0.3, 1e-6
#: Words in a segment of the chained forward-backward.
SEGMENT = 64
SEED = 3

#: Characters of text in one step of a worker, with up to eight languages; fewer with more.
STEP_CHARS = 600_000


def step_chars(model: Crf | None) -> int:
    return STEP_CHARS * 8 // max(8, len(model.languages) if model is not None else 0)


_LETTER = re.compile(r"[^\W\d_]")
_SIGNS = string.punctuation + "¿¡«»„“”‚‘’…–—"
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF) for j in range(5)]


def plain(word: str) -> str:
    """The word in lower case without signs at its ends."""
    return word.lower().strip(_SIGNS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(code, word)`` of the features of plain words: letter pairs and triples of the word between two marks (those at the
    marks are its first and last letters), its first and last three letters, and the word itself, each as a 64-bit hash."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(chars)) - first[owner]
    codes, owners = [], []
    for n in (2, 3, 4):
        start = np.arange(max(0, len(chars) - n + 1))
        start = start[at[start] + n <= sizes[owner[start]]]
        if n == 4:
            start = start[(at[start] == 0) | (at[start] + n == sizes[owner[start]])]
        codes.append(_mix(sum((chars[start + j] * _ODD[j] for j in range(n)), np.uint64(n))))
        owners.append(owner[start])
    whole = np.add.reduceat(_mix(chars + at.astype(np.uint64) * _ODD[4]), first) if len(words) else np.empty(0, np.uint64)
    return np.concatenate([*codes, _mix(whole)]), np.concatenate([*owners, np.arange(len(words))])


class Crf:
    """Feature weights, transitions and start weights; what is sent to the executors.

    ``known`` are the sorted codes of the features that have weights; ``lexicon`` gives a frequent word's languages.
    """

    def __init__(self, languages: list[str], known: np.ndarray, lexicon: dict[str, list[int]]):
        k = len(languages)
        self.languages, self.known, self.lexicon = languages, known, lexicon
        self.weights = np.zeros((len(known) + k, k))  # the last k rows: a lexicon each
        self.transitions, self.start = np.zeros((k, k)), np.zeros(k)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(row, word)``: the weight rows of each word's features; none for words without letters."""
        with_letters = [i for i, w in enumerate(words) if _LETTER.search(w)]
        bare = [plain(words[i]) for i in with_letters]
        codes, owner = features(bare)
        place = np.minimum(np.searchsorted(self.known, codes), max(0, len(self.known) - 1))
        met = np.flatnonzero(self.known[place] == codes) if len(self.known) else np.empty(0, np.int64)
        lexical = [(len(self.known) + q, i) for i, w in enumerate(bare) if w in self.lexicon for q in self.lexicon[w]]
        row = np.r_[place[met], np.array([r for r, _ in lexical], np.int64)]
        return row, np.array(with_letters, np.int64)[np.r_[owner[met], np.array([i for _, i in lexical], np.int64)]]

    def emissions(self, words: list[str]) -> np.ndarray:
        """``(word, language)`` scores, and in a last column whether the word has a letter."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            row, word = self.rows(some)
            for q in range(len(self.languages)):
                out[at : at + len(some), q] = np.bincount(word, self.weights[row, q], len(some))
        out[:, -1] = [bool(_LETTER.search(w)) for w in words]
        return out

    # -- training --------------------------------------------------------------------------------
    def posteriors(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals and expected transition counts of sequences of equal length, ``e`` being ``(time, batch, language)``."""
        steps, b, k = e.shape
        x = np.exp(e - e.max(axis=2, keepdims=True))
        t, s = np.exp(self.transitions - self.transitions.max()), np.exp(self.start - self.start.max())
        alpha, beta = np.empty_like(x), np.ones_like(x)
        alpha[0] = s * x[0]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for i in range(1, steps):
            alpha[i] = (alpha[i - 1] @ t) * x[i]
            alpha[i] /= alpha[i].sum(axis=1, keepdims=True)
        for i in range(steps - 2, -1, -1):
            beta[i] = (beta[i + 1] * x[i + 1]) @ t.T
            beta[i] /= beta[i].sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        pairs = np.zeros((k, k))
        for i in range(1, steps):
            joint = alpha[i - 1][:, :, None] * t * (x[i] * beta[i])[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return p, pairs

    def train(self, words: list[str], ids: np.ndarray, labels: np.ndarray) -> None:
        """``ids`` and ``labels`` are ``(time, sequence)``; ids number ``words``."""
        rng = np.random.default_rng(SEED)
        row, word = self.rows(words)
        order = np.argsort(word, kind="stable")
        rows = np.split(row[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])
        k, n = len(self.languages), ids.shape[1]
        g2 = [np.full_like(x, 1e-8) for x in (self.weights, self.transitions, self.start)]
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, 64):
                pick = order[at : at + 64]
                some, place = np.unique(ids[:, pick], return_inverse=True)
                own = [rows[i] for i in some]
                flat, owner = np.concatenate(own), np.repeat(np.arange(len(some)), [len(r) for r in own])
                score = np.zeros((len(some), k))
                np.add.at(score, owner, self.weights[flat])
                y = labels[:, pick]
                p, pairs = self.posteriors(score[place.reshape(y.shape)])
                truth = np.eye(k)[y]
                by_word = np.zeros((len(some), k))
                np.add.at(by_word, place.ravel(), (truth - p).reshape(-1, k))
                used, slot = np.unique(flat, return_inverse=True)
                gw = np.zeros((len(used), k))
                np.add.at(gw, slot, by_word[owner])
                gw -= DECAY * len(pick) * LENGTH * self.weights[used]
                seen = np.zeros((k, k))
                np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
                g2[0][used] += gw * gw
                self.weights[used] += RATE * gw / np.sqrt(g2[0][used])
                for q, (param, g) in enumerate(((self.transitions, seen - pairs), (self.start, (truth[0] - p[0]).sum(axis=0))), 1):
                    g2[q] += g * g
                    param += RATE * g / np.sqrt(g2[q])

    # -- labelling -------------------------------------------------------------------------------
    def marginals(self, e: np.ndarray, sizes: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
        """Marginals of texts laid end to end, ``sizes`` words each: exact forward-backward, in segments side by side.

        ``enter (text, language)`` and ``leave`` are the messages into a text's first word and its last, where texts are
        parts of longer ones; a row of ``enter`` that is NaN is a beginning.
        """
        return self._segments(e, sizes, enter, leave)

    def product(self, e: np.ndarray, opening: bool) -> np.ndarray:
        """The transition product over one text part, normalised."""
        return self._segments(e, np.array([len(e)]), np.full((1, len(self.languages)), np.nan if opening else 1.0), None, product_only=True)

    def _segments(self, e: np.ndarray, sizes: np.ndarray, enter: np.ndarray | None, leave: np.ndarray | None, product_only: bool = False) -> np.ndarray:
        k, total = len(self.languages), len(e)
        if not total:
            return np.zeros((0, k))
        t, s = np.exp(self.transitions - self.transitions.max()), np.exp(self.start - self.start.max())
        segments = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(sizes)), segments)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)
        begin = np.repeat(np.cumsum(sizes) - sizes, segments) + nth * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(sizes, segments) - nth * SEGMENT)
        m, at = len(doc), np.arange(SEGMENT)
        where = np.minimum(begin[:, None] + at, total - 1)
        x = np.exp(e - e.max(axis=1, keepdims=True))[where]  # segment, time, language
        live = at < length[:, None]
        opens = nth == 0
        if enter is not None:
            opens &= np.isnan(enter[:, 0])[doc]
        first = np.where(opens[:, None, None], np.broadcast_to(s, (k, k)), t)  # into a segment's first word
        # Products of each segment, then the chain of segments inside each document.
        product = first * x[:, 0][:, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
        for i in range(1, SEGMENT):
            on = np.flatnonzero(live[:, i])
            if not len(on):
                break
            step = (product[on] @ t) * x[on, i][:, None, :]
            product[on] = step / step.sum(axis=(1, 2), keepdims=True)
        into, out = np.full((m, k), 1.0 / k), np.ones((m, k))
        if enter is not None:
            into[nth == 0] = np.where(np.isnan(enter), 1.0 / k, enter)[doc[nth == 0]]
        if leave is not None:
            final = nth == segments[doc] - 1
            out[final] = leave[doc[final]]
        last = segments.max()
        if product_only:
            whole = np.eye(k)
            for p in product:
                whole = whole @ p
                whole /= whole.sum()
            return whole
        for j in range(1, last):
            on = np.flatnonzero(nth == j)
            step = np.einsum("mi,mij->mj", into[on - 1], product[on - 1])
            into[on] = step / step.sum(axis=1, keepdims=True)
        for j in range(last - 1, 0, -1):
            on = np.flatnonzero(nth == j)
            step = np.einsum("mij,mj->mi", product[on], out[on])
            out[on - 1] = step / step.sum(axis=1, keepdims=True)
        # Forward and backward inside the segments, from what comes in at both ends.
        alpha, beta = np.empty((SEGMENT, m, k)), np.empty((SEGMENT, m, k))
        here = np.einsum("mi,mij->mj", into, first)
        for i in range(SEGMENT):
            step = (here if i == 0 else here @ t) * x[:, i]
            here = np.where(live[:, i, None], step / step.sum(axis=1, keepdims=True), here)
            alpha[i] = here
        here = out
        for i in range(SEGMENT - 1, -1, -1):
            beta[i] = here
            step = (here * x[:, i]) @ t.T
            here = np.where(live[:, i, None], step / step.sum(axis=1, keepdims=True), here)
        p = (alpha * beta).transpose(1, 0, 2)[live]
        return p / p.sum(axis=1, keepdims=True)


def splice(texts: list[tuple[list[str], int]], count: int = SEQUENCES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Training sequences of stretches from random documents: the distinct words, and ``(time, sequence)`` ids and labels."""
    rng = np.random.default_rng(SEED)
    numbers: dict[str, int] = {}
    by_label = {y: [t for t, z in texts if z == y and t] for y in {y for _, y in texts}}
    by_label = {y: ts for y, ts in by_label.items() if ts}
    ids, labels, choices = np.zeros((LENGTH, count), np.int64), np.zeros((LENGTH, count), np.int64), sorted(by_label)
    for c in range(count):
        at = 0
        while at < LENGTH:
            y = choices[rng.integers(len(choices))]
            words = by_label[y][rng.integers(len(by_label[y]))]
            n = int(min(LENGTH - at, rng.geometric(1 / STRETCH), len(words)))
            start = int(rng.integers(len(words) - n + 1))
            ids[at : at + n, c] = [numbers.setdefault(w, len(numbers)) for w in words[start : start + n]]
            labels[at : at + n, c] = y
            at += n
    return list(numbers), ids, labels


def fit(rows: list[tuple[str, str | None]]) -> Crf | None:
    """A trained model of ``(language, text)`` rows; None where there is nothing to learn from."""
    texts = [(lang, (text or "").split()) for lang, text in rows]
    texts = [(lang, words) for lang, words in texts if any(map(_LETTER.search, words))]
    if not texts:
        return None
    languages = sorted({lang for lang, _ in texts})
    seen, of_lang = [], {lang: Counter() for lang in languages}
    for lang, words in texts:
        distinct = sorted({plain(w) for w in words if _LETTER.search(w)})
        seen.append(np.unique(features(distinct)[0]))
        of_lang[lang].update(distinct)
    codes, texts_with = np.unique(np.concatenate(seen), return_counts=True)
    codes = codes[np.lexsort((codes, -texts_with))][: min(FEATURES, int((texts_with > 1).sum()))]
    lexicon: dict[str, list[int]] = {}
    for q, lang in enumerate(languages):
        for w, _ in sorted(of_lang[lang].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(q)
    model = Crf(languages, np.sort(codes), lexicon)
    model.train(*splice([(words, languages.index(lang)) for lang, words in texts]))
    model.weights = model.weights.astype(np.float32)
    return model


def learn(docs: DataFrame, *, per_language: int = SAMPLE, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Crf | None:
    """Fit on a bounded sample of the rows with a language that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    rows = rows.where(~held_out(F.col("doc_id")))
    known = rows.groupBy("doc_id").agg(F.min("lang").alias("label"))
    return fit([(r.label, r.text) for r in sample_labelled(rows.select("doc_id", "text"), known, per_language, SEED)])


def keep_languages(docs: DataFrame, model: Crf | None, *, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is known with a score of at least ``least``."""
    marked, row = numbered_rows(docs)
    tagged = tag_languages(marked, model, id_col=row, text_col=text_col)
    rejected = tagged.where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least))
    return without_rows(marked, row, rejected.select(F.col("doc_id").alias(row)))


def label_long(model: Crf, text: str, spans: bool) -> tuple[str, float, list[dict]]:
    """Language, score and spans of one long text, a piece at a time."""
    def emissions() -> Iterator[np.ndarray]:
        for piece in text_pieces(text, step_chars(model)):
            table = worker_state("langid", model, lambda: WordTable(model.emissions, 200_000))
            ids = table.rows(piece.split())
            if len(ids):
                yield table.values[ids]

    products = [model.product(e[:, :-1].astype(np.float64), n == 0) for n, e in enumerate(emissions())]
    k = len(model.languages)
    if not products:
        return UNKNOWN, 0.0, []
    into, out = [np.full(k, np.nan)], [np.ones(k)]
    for n, p in enumerate(products[:-1]):
        step = (np.full(k, 1.0 / k) if n == 0 else into[-1]) @ p
        into.append(step / step.sum())
    for p in products[:0:-1]:
        step = p @ out[-1]
        out.append(step / step.sum())
    out.reverse()
    sums, letters, runs, at = np.zeros(k), 0.0, [], 0
    for n, e in enumerate(emissions()):
        p = model.marginals(e[:, :-1].astype(np.float64), np.array([len(e)]), into[n][None], out[n][None])
        sums += np.where(e[:, -1:] > 0, p, 0).sum(axis=0)
        letters += float(e[:, -1].sum())
        if spans:
            for x in stretches(model, p, at):
                if runs and runs[-1]["lang"] == x["lang"]:
                    runs[-1]["last"] = x["last"]
                else:
                    runs.append(x)
        at += len(e)
    best = int(sums.argmax())
    return (model.languages[best], min(1.0, sums[best] / letters), runs) if letters else (UNKNOWN, 0.0, runs)


def stretches(model: Crf, p: np.ndarray, at: int) -> list[dict]:
    """Runs of words of one language, by the largest marginal, from word number ``at`` on."""
    own = p.argmax(axis=1)
    ends = np.flatnonzero(np.r_[own[1:] != own[:-1], True])
    return [{"first": int(a) + at, "last": int(b) + at, "lang": model.languages[own[b]]} for a, b in zip(np.r_[0, ends[:-1] + 1], ends, strict=True)]


def label_texts(model: Crf | None, texts: list[str | None], spans: bool = False) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and (if asked for) spans of whole texts."""
    if model is not None and len(texts) == 1 and len(texts[0] or "") > 2 * step_chars(model):
        lang, score, runs = label_long(model, texts[0], spans)
        return [lang], np.array([score]), [runs]
    cut = [(t or "").split() if model is not None else [] for t in texts]
    sizes = np.array([len(ws) for ws in cut], np.int64)
    lang, score, runs = [UNKNOWN] * len(cut), np.zeros(len(cut)), [[] for _ in cut]
    if not sizes.sum():
        return lang, score, runs
    table = worker_state("langid", model, lambda: WordTable(model.emissions, 200_000))
    ids = table.rows([w for ws in cut for w in ws])
    e = table.values[ids]
    p = model.marginals(e[:, :-1].astype(np.float64), sizes)
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]
    sums = np.add.reduceat(np.where(e[:, -1:] > 0, p, 0), starts)
    letters = np.add.reduceat(e[:, -1], starts)
    best = sums.argmax(axis=1)
    for i, d in enumerate(filled.tolist()):
        if letters[i]:
            lang[d], score[d] = model.languages[best[i]], min(1.0, sums[i, best[i]] / letters[i])
    if spans:
        for d, s in zip(filled.tolist(), starts.tolist(), strict=True):
            runs[d] = stretches(model, p[s : s + sizes[d]], 0)
    return lang, score, runs


def tag_languages(docs: DataFrame, model: Crf | None, *, spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row a document; with ``spans`` also the stretches of words of one language,
    ``array<struct<first,last,lang>>`` in words from 0, both ends included."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text", step_chars(sent.value)):
            lang, score, runs = label_texts(sent.value, texts, spans)
            columns, names = [part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", spans array<struct<first:int,last:int,lang:string>>" if spans else ""
    return map_arrow(rows, run, f"doc_id {id_type}, lang_pred string, score double{more}", "languages")
