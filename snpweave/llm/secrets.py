"""Secret scans over a trigram inverted index, in DataFrame operations alone.

Each rule is a regular expression.  A Boolean query over trigrams is derived from the
expression itself: it is parsed, each part gives the texts it can be, or that its match
begins and ends with, and the trigrams that these must have; concatenation, alternation
and repetition combine them (after R. Cox, "Regular Expression Matching with a Trigram
Index").  The index is a written table of postings ``(trigram, row)``, restricted to the trigrams that
some query names; postings of one alternative are intersected by counting a row's
trigrams, alternatives are united, and the candidates are verified by the expression itself
on the whole text.  Rules whose expression has no mandatory trigram (character classes
only) scan every text.

Only candidates' texts meet the candidate list (which is broadcast while it is short), and
spans are attached to the rows by number, so texts are not shuffled.

Defined results: null text counts as empty and has no spans; offsets are code points,
end exclusive; rows are told apart by a number of their own, so repeated and null ids
are rows like others; an empty table gives no rows; extra columns are ignored; whole texts are scanned, of any length.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_sums
from ..storage import materialize
from .common import bounded_broadcast, numbered_rows

#: Texts that a part of an expression is followed up as at most, and characters of one class; beyond it less is known, never something wrong.
MOST_TEXTS, MOST_LETTERS = 48, 6

#: A query in disjunctive form: alternatives, each the trigrams that must all occur.  ``ALWAYS`` holds for every text.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset({frozenset()})


def _least(query: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(x: Query, y: Query) -> Query:
    """Both hold; the less selective side alone where the product would be large."""
    if len(x) * len(y) > 4 * MOST_TEXTS:
        return max(x, y, key=lambda q: min(map(len, q)))
    return _least(frozenset(a | b for a, b in product(x, y)))


def _has(texts: frozenset[str]) -> Query:
    """One of the texts occurs."""
    return _least(frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts))


@dataclass(frozen=True)
class Part:
    """What is known of the matches of a part of an expression: all of them (``texts``), or what they begin and end with."""

    texts: frozenset[str] | None
    begins: frozenset[str]
    ends: frozenset[str]
    query: Query

    @classmethod
    def of(cls, texts: set[str]) -> Part:
        some = frozenset(texts)
        return cls(some, some, some, ALWAYS) if len(some) <= MOST_TEXTS else UNKNOWN.knowing(_has(some))

    def open(self) -> Part:
        """The same without the list of all matches, which have gone into the query."""
        if self.texts is None:
            return self
        return Part(None, frozenset(t[:2] for t in self.texts), frozenset(t[-2:] for t in self.texts), _has(self.texts))

    def knowing(self, query: Query) -> Part:
        return Part(self.texts, self.begins, self.ends, _both(self.query, query))

    def then(self, other: Part) -> Part:
        if self.texts is not None and other.texts is not None and len(self.texts) * len(other.texts) <= MOST_TEXTS:
            return Part.of({a + b for a, b in product(self.texts, other.texts)}).knowing(_both(self.query, other.query))
        joint = {a + b for a, b in product(self.ends, other.begins)}
        over = _has(frozenset(joint)) if len(joint) <= MOST_TEXTS else ALWAYS
        left = {a + b for a, b in product(self.texts, other.begins)} if self.texts is not None else set(self.begins)
        right = {a + b for a, b in product(self.ends, other.texts)} if other.texts is not None else set(other.ends)
        x, y = self.open(), other.open()
        begins = frozenset(t[:2] for t in left) if len(left) <= MOST_TEXTS else x.begins
        ends = frozenset(t[-2:] for t in right) if len(right) <= MOST_TEXTS else y.ends
        # A list of whole texts followed by an open part: keep its own trigrams, and those over the seam.
        return Part(None, begins, ends, _both(_both(x.query, y.query), over))

    def otherwise(self, other: Part) -> Part:
        if self.texts is not None and other.texts is not None and len(self.texts | other.texts) <= MOST_TEXTS and self.query == other.query == ALWAYS:
            return Part.of(set(self.texts | other.texts))
        x, y = self.open(), other.open()
        return Part(None, x.begins | y.begins, x.ends | y.ends, _least(x.query | y.query))


EMPTY = Part(frozenset({""}), frozenset({""}), frozenset({""}), ALWAYS)
UNKNOWN = Part(None, frozenset({""}), frozenset({""}), ALWAYS)


def _letters(kind, value) -> set[str] | None:
    """The lower-cased characters of one class item; None if they are many or not listed."""
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.RANGE and value[1] - value[0] < MOST_LETTERS:
        return {chr(c).lower() for c in range(value[0], value[1] + 1)}
    return None


def _part(kind, value) -> Part:
    if kind is op.LITERAL:
        return Part.of({chr(value).lower()})
    if kind is op.IN:
        found = [_letters(k, v) for k, v in value] if value[0][0] is not op.NEGATE else [None]
        some = set().union(*found) if None not in found else None
        return Part.of(some) if some and len(some) <= MOST_LETTERS else UNKNOWN
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind in (op.ATOMIC_GROUP,):
        return _sequence(value)
    if kind is op.BRANCH:
        some = [_sequence(x) for x in value[1]]
        out = some[0]
        for x in some[1:]:
            out = out.otherwise(x)
        return out
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        once = _sequence(inner)
        if most == 1:
            return once if least else once.otherwise(EMPTY)
        out = EMPTY
        for _ in range(min(least, 3)):
            out = out.then(once)
        if least == most <= 3:
            return out
        return out.then(UNKNOWN).then(Part(None, frozenset({""}), once.open().ends, ALWAYS)) if least else UNKNOWN
    if kind is op.AT:
        return EMPTY
    return UNKNOWN  # any character, negated classes, references; look-arounds take no text


def _sequence(parsed) -> Part:
    out = EMPTY
    for kind, value in parsed:
        if kind not in (op.ASSERT, op.ASSERT_NOT):
            out = out.then(_part(kind, value))
    return out


def trigram_query(pattern: str) -> Query:
    """The trigrams, lower-cased, that a text with a match must have; ``ALWAYS`` if the expression asks for none.

    Letters' case is disregarded throughout, so the query holds whatever part of the expression ignores it.
    """
    query = _sequence(parser.parse(pattern)).open().query
    return ALWAYS if frozenset() in query else query


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds the spans; a span is kept if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def query(self) -> tuple[frozenset[str], ...]:
        """Alternatives, each the trigrams that must all occur; empty if there is no query."""
        found = trigram_query(self.pattern)
        return () if found == ALWAYS else tuple(sorted(found, key=sorted))


# The three base rules, in the order of the list; quotes, blanks and letters as given.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further well-known credential shapes that the scan adds.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)

SPANS = "array<struct<start:bigint,end:bigint>>"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches as ``array<struct<start,end>>`` in code points.

    The stretches between matches come from a split by the same expression; a match
    ends where the stretches and matches up to it end.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    lengths = [F.transform(x, lambda s: F.length(s)) for x in (gaps, whole, kept)]

    def placed(x: Column) -> Column:
        ends = running_sums(F.transform(x, lambda v: v["gap"] + F.coalesce(v["hit"], F.lit(0))))
        each = lambda e: F.zip_with(x, e, lambda v, end: F.struct((end - v["hit"]).cast("bigint").alias("start"), end.alias("end"), (v["kept"] >= rule.least).alias("ok")))
        return F.transform(F.filter(let(ends, each), lambda v: F.coalesce(v["ok"], F.lit(False))), lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end")))

    sizes = F.arrays_zip(*(x.alias(n) for x, n in zip(lengths, ("gap", "hit", "kept"), strict=True)))
    return F.when(text.rlike(rule.pattern), let(sizes, placed)).otherwise(F.array().cast(SPANS))


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Postings ``(trigram, row)`` of the trigrams that the rules' queries name, on ``(row, text)``."""
    wanted = sorted({t for r in rules for alternative in r.query() for t in alternative})
    present = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    return docs.select("row", F.lower("text").alias("low")).select(F.explode(present).alias("trigram"), "row")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(row, kinds)``: the rules whose trigram query holds, by intersecting postings."""
    spark = index.sparkSession
    terms = [(r.kind, n, t, len(a)) for r in rules for n, a in enumerate(r.query()) for t in sorted(a)]
    plan = spark.createDataFrame(terms, "kind string, alternative int, trigram string, needed int")  # the rules' own size
    met = index.join(F.broadcast(plan), "trigram").groupBy("row", "kind", "alternative").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
    return met.where("n = needed").groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, found)``: each rule's spans under its kind, one row a document; ``row`` is the number that
    :func:`numbered_rows` gives the rows of ``docs``."""
    rules = BASE_RULES + EXTRA_RULES if rules is None else rules
    marked, row = numbered_rows(docs)
    rows = marked.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    indexed = tuple(r for r in rules if r.query())
    none = F.array().cast(SPANS)
    scanned = rows.select("doc_id", "row", *[spans(F.col("text"), r).alias(r.kind) for r in rules if not r.query()])
    if indexed:
        hits = materialize(candidates(materialize(trigram_index(rows, indexed), "trigrams"), indexed), "candidates")
        verified = rows.select("row", "text").join(bounded_broadcast(hits), "row").select("row", *[F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)).otherwise(none).alias(r.kind) for r in indexed])
        some = materialize(verified.where(" OR ".join(f"size(`{r.kind}`) > 0" for r in indexed)), "verified")
        scanned = scanned.join(bounded_broadcast(some), "row", "left")
    return scanned.select("doc_id", "row", F.struct(*[F.coalesce(r.kind, none).alias(r.kind) for r in rules]).alias("found"))


def spans_text(found: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` by start, then by the rules' order, comma-joined."""
    def said(n: int, kind: str):
        return lambda s: F.struct(s.start.alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), s.start.cast("string"), s.end.cast("string")).alias("said"))

    parts = [F.transform(found[r.kind], said(n, r.kind)) for n, r in enumerate(rules)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x.said), ",")


def secret_report(docs: DataFrame, extra: tuple[Rule, ...] = EXTRA_RULES, **options) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row a document."""
    found = find_secrets(docs, BASE_RULES + extra, **options)
    counts = [F.size(F.col("found")[r.kind]).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("found"), BASE_RULES), 256).alias("base_sha256"), spans_text(F.col("found"), BASE_RULES + extra).alias("spans"))
