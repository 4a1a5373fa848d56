"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from snpweave.llm import common, exact_dedup, minhash


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out, stays = [], set()
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and lower(t) not in stays
        if kept:
            stays.add(lower(t))
        out.append((i, keep, len(ids), kept, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def texts(seed=0, n=60):
    rng = random.Random(seed)
    words = ["ab" + str(i) for i in range(40)] + ["É", "ß"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 900))) for _ in range(n // 3)]
    return [(i, (t.upper() if rng.random() < 0.3 else t + rng.choice(["", " ", "x"]))) for i, t in enumerate(rng.choice(base) for _ in range(n))]


@pytest.mark.parametrize("digest", [exact_dedup.default_digest, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_exact_groups(spark, edge, digest):
    """A digest of three values makes nearly all chunks collide: identifiers must still be exact."""
    for docs in (edge, spark.createDataFrame(texts(), "doc_id long, text string")):
        got = exact_dedup.exact_dedup(docs, digest=digest, min_chars=32, max_chars=128).drop("row").collect()
        assert sorted(map(tuple, got), key=str) == expected_exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_exact_empty_and_chunks_join(spark, none, edge):
    assert exact_dedup.exact_dedup(none).count() == 0
    t = F.coalesce("text", F.lit(""))
    assert edge.where(F.array_join(exact_dedup.chunks(t, 16, 64), "") != t).count() == 0


def expected_near(rows, threshold=75):
    """Rows as documents: ``(doc_id, n_shingles, component_id)``, sorted."""
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([k for k, (i, _) in enumerate(rows) if i is not None], 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least[find(k)] if i is not None else None) for k, (i, _) in enumerate(rows)), key=str)


def near_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 250))]
        out.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy)
    out += [passage + [rng.choice(words) for _ in range(rng.choice((5, 25, 60)))] for _ in range(40)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def near_rows(docs):
    got = minhash.minhash_components(docs).collect()
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    linked = [r for r in got if r.doc_id is not None and r.n_shingles]
    assert sorted({r.component_id for r in linked}) == sorted({r.doc_id for r in linked if r.first and r.kept})
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def test_near_components(spark, edge):
    for docs in (edge, spark.createDataFrame(near_texts(), "doc_id long, text string")):
        assert near_rows(docs) == expected_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_hubs_are_dealt(spark, monkeypatch, tmp_path):
    """The same result where nearly every hub is cut, and where lists are too long to broadcast."""
    spark.createDataFrame(near_texts(), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(minhash, "HUB", 2), monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert near_rows(docs) == expected_near([(r.doc_id, r.text) for r in docs.collect()])


def test_near_rows_that_share_an_id(spark):
    a, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "ac")
    rows = [(1, a), (1, c), (2, a + " more"), (3, c + " more"), (4, "alone here with nobody near"), (4, "alone here with nobody near")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(docs) == expected_near(rows) and {(r.doc_id, r.component_id) for r in minhash.minhash_components(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert sorted(r.doc_id for r in minhash.minhash_components(docs).where("first").collect()) == [1, 1, 4]


def test_chunks_of_other_scripts_follow_the_content(spark):
    """A sentence more at the start moves few cuts, whatever the script."""
    rng = random.Random(5)
    for letters, gap, end in (("абвгдежз", " ", ". "), ("的一是了我不人在", "", "。"), ("अआइईउऊ", " ", "। "), ("abcdefgh", " ", ". ")):
        said = [gap.join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(8)) + end for _ in range(200)]
        two = spark.createDataFrame([("".join(said),), (said[7] + "".join(said),)], "t string").select(exact_dedup.chunks(F.col("t"), 32, 512).alias("c")).collect()
        one, other = ({x for x in r.c} for r in two)
        assert len(one & other) > 0.8 * len(one), letters


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(3000)).encode()
    whole = minhash.shingle_sets([text])[0]
    monkeypatch.setattr(minhash, "text_pieces", lambda t: common.text_pieces(t, 100))
    assert (minhash.shingle_sets([text])[0] == whole).all() and b"".join(common.text_pieces(text, 100)) == text


def test_near_empty(none):
    assert minhash.minhash_components(none).count() == 0


def test_sketch_bound_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (3, 200, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.r_[b[: n // 2], a[n // 2 :]])
        differ = len(np.setxor1d(a, b))
        bits = sum(int(x).bit_count() for x in (minhash.parity_sketch(a) ^ minhash.parity_sketch(b)).view(np.uint64))
        assert bits <= differ
