"""Packing against a plain tokenizer run, and the pipeline end to end."""

import json
import os
import random
import zlib

import numpy as np
import pytest

from snpweave.llm import common, packing, queries

tokenizers = pytest.importorskip("tokenizers")
DATA = "/root/testdata/sf0.001"

ODD = ["It's we're DON'T x'll 'd''s ÀÉß×÷µ ÿŸ ﬁ İstanbul ΑΣ áb <|endoftext|>x a<|startoftext|> \x1c\x85 y z　q 1234 ½ ٣ !!!?? a_b-c", "\n \n", "naïve's L'été çà’s", "\t\tx\r\ny\x0bz", "enß Ertzßsch", "ù́e"]


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_path()


def test_words_give_the_tokenizers_ids(path):
    rng = random.Random(2)
    letters = "abcxyzÀéßñ×'0!.,-_<|>½ \n\t"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    with open(path, encoding="utf-8") as f:
        e = packing.WordEncoder(f.read())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # from the table the second time
        assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(texts)] == want


@pytest.mark.parametrize("window", [8, 2048])
def test_round_trip(spark, edge, none, path, window):
    docs = edge.repartition(3)
    with open(path, encoding="utf-8") as f:
        tok = tokenizers.Tokenizer.from_str(f.read())
    pieces = packing.pack(docs, path, window=window).collect()
    line = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in line:  # gapless over all sequences, cut at the window alone
        assert p.sequence_id * window + p.offset == at and 1 <= p.length <= window - p.offset and len(p.ids) == 4 * p.length
        at += p.length
    docs_of, ids = [], []
    for p in line:
        if p.start == 0:
            ids = []
            docs_of.append((p.doc_id, ids, p.doc_tokens))
        assert p.start == len(ids)
        ids += np.frombuffer(bytes(p.ids), "<u4").tolist()
    assert all(len(x) == n for _, x, n in docs_of)
    digests = {(r.sequence_id, r.offset): r.ids_crc32 for r in queries.packed_digests(packing.pack(docs, path, window=window)).collect()}
    assert digests == {(p.sequence_id, p.offset): zlib.crc32(bytes(p.ids)) for p in pieces}
    want = [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in edge.collect()]
    assert sorted(((d, x) for d, x, _ in docs_of), key=str) == sorted(want, key=str)
    assert packing.pack(none, path).count() == 0


def test_only_the_stated_tokenizer_goes_by_words(path):
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    assert packing.WordEncoder(json.dumps(made)).by_word
    made["normalizer"]["normalizers"].pop()  # no lower-casing
    other = packing.WordEncoder(json.dumps(made))
    assert not other.by_word and np.frombuffer(other.encode(["Hello World"])[0], other.dtype).tolist() == other.tokenizer.encode("Hello World", add_special_tokens=False).ids


def test_a_long_text_in_pieces(path, monkeypatch):
    with open(path, encoding="utf-8") as f:
        e = packing.WordEncoder(f.read())
    text = " ".join(ODD * 20)
    want = e.encode([text])
    monkeypatch.setattr(packing, "SLICE_CHARS", 50)
    assert e.encode([text]) == want


def texts_of(spark, docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_pipeline_judges_rows(spark, edge, none, path, tmp_path, monkeypatch):
    """Nulls, repeated ids with equal and unlike texts, ties, empty tables and clashing columns, stage by stage against brute force."""
    import corpus_pipeline

    a, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "ac")
    item = " ".join(f"item{k}" for k in range(40))
    rows = [(5, "same text a"), (5, "SAME text a"), (5, "other one here"), (6, "other one here"), (None, "no id"), (None, "no id"), (None, None), (8, None), (9, ""), (1, a), (1, c), (2, a + " more"), (3, c + " more"), (20, "x " + item), (20, "clean text of the same id"), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, _row string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for limit in (common.BROADCAST_IDS, 0):
        monkeypatch.setattr(common, "BROADCAST_IDS", limit)
        for made in (docs, spark.read.parquet(str(tmp_path / "documents.parquet"))):
            exact = corpus_pipeline.exact_copies(spark, made, str(tmp_path))
            assert exact.schema == made.schema
            got = texts_of(spark, exact)
            assert len(got) == 11 and {(i, (t or "").lower()) for i, t in got} == {(5, "same text a"), (6, "other one here"), (None, "no id"), (9, ""), (1, a), (1, c), (2, a + " more"), (3, c + " more"), (20, "x " + item), (20, "clean text of the same id"), (None, item)}
            near = texts_of(spark, corpus_pipeline.near_copies(spark, made, str(tmp_path)))
            assert [x for x in near if x[0] in (1, 2, 3)] == [(1, a), (1, c)] and len([x for x in near if x[0] == 5]) == 2 and len([x for x in near if x[0] is None]) == 4
            clean = texts_of(spark, corpus_pipeline.benchmark_leaks(spark, made, str(tmp_path)))
            assert clean == sorted([x for x in rows if item not in (x[1] or "")], key=str)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == [] and stage(spark, docs, str(tmp_path)).schema == docs.schema
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark, path):
    import corpus_pipeline

    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == raw.columns, name
        rows = {tuple(r) for r in out.collect()}
        assert rows <= {tuple(r) for r in docs.collect()} and len(rows) >= 0.7 * docs.count(), name
        docs = spark.createDataFrame(sorted(rows), raw.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted(map(tuple, whole)) != [] and sum(r.length for r in whole) == sum(r.length for r in pieces.collect())
