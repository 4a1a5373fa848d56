"""Language, toxicity and quality: exact inner workings, held-out accuracy, edges."""

import os
import random
import zlib

import numpy as np
import pytest

from snpweave.llm import common, langid, queries, quality, toxicity

DATA = "/root/testdata/sf0.01"
with_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

VOWELS = {"xx": "aou", "yy": "eiy"}


def made(seed=0, n=120):
    """Two made-up languages; texts with the word ``badword`` are toxic, texts of repeated signs are poor."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(("xx", "yy"))
        words = ["".join(rng.choice("bdklmnrst") + rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 60))]
        toxic, poor = rng.random() < 0.4, rng.random() < 0.4
        if toxic:
            words.insert(rng.randrange(len(words)), "badword")
        rows.append((i, " ".join(words) if not poor else " ".join(w.upper() + "!!!" for w in words[:3] * 10), lang, int(toxic and not poor), int(not poor)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, x, q in rows] + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_fold(spark, tables):
    got = {r.doc_id: r.h for r in tables[0].select("doc_id", common.held_out(tables[0].doc_id).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in got}


def test_segments_give_the_same_marginals():
    rng = np.random.default_rng(0)
    m = langid.Crf(["a", "b", "c"], {}, {})
    m.transitions, m.start = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    sizes = np.array([1, 0, 63, 64, 65, 300, 129])
    e = rng.normal(0, 2, (int(sizes.sum()), 3))
    got, at = m.marginals(e, sizes), 0
    for n in sizes:
        if n:
            want, _ = m.posteriors(e[at : at + n][:, None, :])
            assert np.allclose(want[:, 0], got[at : at + n])
        at += n


def test_a_long_text_in_pieces_is_labelled_alike(monkeypatch):
    rng = random.Random(4)
    model = langid.fit([("xx", " ".join(rng.choice(("kasoma", "tuloda", "baro", "numaso")) for _ in range(40))), ("yy", " ".join(rng.choice(("keyite", "siniry", "medyli", "12", "-")) for _ in range(40)))] * 5)
    text = " ".join(rng.choice(("kasoma", "tuloda", "keyite", "siniry", "12", "new")) for _ in range(900))
    want = langid.label_texts(model, [text], True)
    monkeypatch.setattr(langid, "STEP_CHARS", 500)
    got = langid.label_texts(model, [text], True)
    assert got[0] == want[0] and np.allclose(got[1], want[1]) and got[2] == want[2]
    assert langid.label_texts(model, ["1 " * 2000], True)[:2] == (["und"], np.zeros(1))


def test_every_language_is_learnt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 90}") for i in range(2000)] + [(7, "text", "l3"), (None, "x", None)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "fit", lambda rows: rows)
    rows = langid.learn(docs, per_language=3)
    assert len({lang for lang, _ in rows}) == 90 and len(rows) <= 270


def test_sampled_texts_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a" * 900), (1, "b"), (2, "c" * 500), (3, None), (4, "d")], "doc_id long, text string")
    known = spark.createDataFrame([(i, "l") for i in range(1, 5)], "doc_id long, label string")
    rows = common.sample_labelled(docs, known, 10, 1, chars=100)
    assert [r.doc_id for r in rows] == [1, 2, 3, 4] and max(len(r.text or "") for r in rows) == 100


def test_posteriors_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    m = langid.Crf(["a", "b"], {}, {})
    m.transitions, m.start, e = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2), rng.normal(0, 1, (4, 1, 2))
    total = np.zeros((4, 2))
    for path in product((0, 1), repeat=4):
        weight = np.exp(m.start[path[0]] + sum(e[i, 0, y] for i, y in enumerate(path)) + sum(m.transitions[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            total[i, y] += weight
    p, pairs = m.posteriors(e)
    assert np.allclose(p[:, 0], total / total.sum(axis=1, keepdims=True)) and np.isclose(pairs.sum(), 3)


def test_language(spark, tables, edge, none):
    docs, _ = tables
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.tag_languages(docs, model, spans=True).collect()}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in docs.collect()]) > 0.95
    mixed = spark.createDataFrame([(1, "kasoma tuloda baro numaso " * 4 + "keyite siniry medyli beteki " * 4)], "doc_id long, text string")
    spans = langid.tag_languages(mixed, model, spans=True).first().spans
    assert [s.lang for s in spans] == ["xx", "yy"] and abs(spans[0]["last"] - 15) <= 1
    for m in (model, None):
        rows = langid.tag_languages(edge, m).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert langid.tag_languages(none, model).count() == 0 and langid.learn(none) is None
    kept = langid.keep_languages(edge, model, least=0.4)
    assert kept.schema == edge.schema and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_toxicity(spark, tables, edge, none):
    docs, labels = tables
    rows = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert np.mean([rows[i].predicted == want[i] for i in held]) > 0.9
    assert all(r.predicted == int(r.score >= 0.7) for r in rows.values())
    twice = labels.union(labels.selectExpr("doc_id", "quality", "0 AS toxic"))  # of unlike labels the largest counts
    assert {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, twice).collect()} == {i: r.score for i, r in rows.items()}
    assert len(toxicity.toxicity_scores(edge, labels).collect()) == edge.count() and toxicity.toxicity_scores(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_is_calibrated_on_all_labelled_rows(spark, monkeypatch):
    """Labels that texts do not tell: the sample is half toxic, all labelled rows are a tenth."""
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("red", "blue", "green", "grey", "pink")) for _ in range(12)), "xx" if i % 2 else "yy", int(rng.random() < 0.1)) for i in range(600)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = [r for r in toxicity.toxicity_scores(docs, labels).collect() if not r.held_out]
    assert abs(np.mean([r.score for r in got]) - np.mean([rows[r.doc_id][3] for r in got])) < 0.05


def test_toxicity_moves_no_whole_text(spark, tables, monkeypatch):
    """With labels too many to broadcast: each text is read in one pass and no shuffle lies under it; every labelled row is counted, repeated ids too."""
    docs, labels = tables
    docs = docs.union(docs.where("doc_id < 9"))
    plans, counts, write, settle = [], [], toxicity.map_arrow, toxicity.settle

    def noted(df, *rest):
        if "text" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *rest)

    monkeypatch.setattr(toxicity, "map_arrow", noted)
    monkeypatch.setattr(toxicity, "settle", lambda model, got: counts.extend(got) or settle(model, got))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = toxicity.toxicity_scores(docs, labels).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [p for p in plans if "hashpartitioning" in p or "SortMergeJoin" in p] and len(plans) == 1
    assert len(got) == docs.count() and sum(r.n for r in counts) == sum(not r.held_out for r in got)


def test_toxicity_thresholds_use_counts():
    class Count(dict):
        __getattr__ = dict.__getitem__

    counts = [Count(lang=k, label=y, bin=b, n=n) for k, y, b, n in (("a", 0, 2000, 900), ("a", 1, 4000, 5), ("b", 0, 2000, 9), (None, 1, 4000, 3))]
    model = toxicity.ConvText(np.arange(5))
    limits = toxicity.settle(model, counts)
    low, high = model.calibrated(np.array([-10.0, 10.0]))
    assert set(limits) == {"a"} and low < limits["a"] < high


def test_convolution_of_ragged_texts_equals_padded():
    model = toxicity.ConvText(np.arange(500))
    texts = [["one", "two", "three", "four"], [], ["five"], ["six", "seven"]]
    ids = [model.rows(toxicity.pieces(t)) for t in texts]
    words = [w for t in texts for w in t]
    got = model.logits(model.pooled(model.terms(words), np.arange(len(words)), np.array([len(t) for t in texts])))
    for t, row, g in zip(texts, ids, got):
        padded = np.full((1, len(t) + 3, toxicity.PARTS), -1, np.int32)
        padded[0, : len(t)] = row
        _, p, _, _ = model._forward(padded)
        assert np.isclose((p @ model.out + model.out_bias)[0], g, atol=1e-5)


def test_gradients():
    """A small step along what training changes lowers the loss by what the derivatives say."""
    rng = np.random.default_rng(0)
    model = toxicity.ConvText(np.arange(1, 40))
    texts, labels = [rng.integers(1, 40, (9, toxicity.PARTS)).astype(np.int32) for _ in range(6)], np.array([0, 1, 0, 1, 0, 1], np.float32)
    for f in ("embed", "out"):
        setattr(model, f, getattr(model, f).astype(np.float64))
    model.filters = [f.astype(np.float64) for f in model.filters]

    def loss():
        out = 0.0
        for t, y in zip(texts, labels):
            padded = np.vstack([t, np.full((max(toxicity.WIDTHS), toxicity.PARTS), -1, np.int32)])[None]
            p = model._forward(padded)[3][0]
            out -= y * np.log(p) + (1 - y) * np.log(1 - p)
        return out / len(texts)

    grads = model.gradients(texts, labels, np.ones(len(texts), np.float32))
    for param, grad in ((model.filters[1], grads[1]), (model.out, grads[-1])):
        for at in [np.unravel_index(k, param.shape) for k in rng.integers(0, param.size, 5)]:
            old, step = param[at], 1e-5
            param[at] = old + step
            up = loss()
            param[at] = old - step
            down = loss()
            param[at] = old
            assert np.isclose((up - down) / (2 * step), grad[at], atol=1e-4)


def test_toxicity_of_a_long_text_in_pieces(monkeypatch):
    model = toxicity.ConvText(np.arange(1 << 16))
    text = " ".join(f"w{i % 97}" for i in range(2000))
    want = model.raw([text], common.WordTable(model.terms))
    monkeypatch.setattr(toxicity, "STEP_CHARS", 300)
    assert np.allclose(model.raw([text], common.WordTable(model.terms)), want, atol=1e-5)


def test_statistics_in_pieces(monkeypatch):
    text = "One two, two\n\nTHREE #$ four!\nOne two, two\n" * 30 + "é" * 50
    want = quality.statistics(text)
    monkeypatch.setattr(quality, "text_pieces", lambda t: common.text_pieces(t, 40))
    assert np.allclose(quality.statistics(text), want)


def test_ridge_against_a_direct_solution(spark, tables, monkeypatch):
    docs, labels = tables
    labelled = quality.document_statistics(docs).join(labels.where("quality IS NOT NULL"), "doc_id").selectExpr("stats", "quality AS label").repartition(7)
    monkeypatch.setattr(quality, "FAN", 2)  # several levels of sums
    model = quality.fit(labelled)
    rows = labelled.collect()
    phi, y = model.features(np.array([r.stats for r in rows])), np.array([float(r.label) for r in rows])
    penalty = quality.RIDGE * len(rows) * np.eye(phi.shape[1])
    penalty[-1, -1] = 0
    assert np.allclose(model.weights, np.linalg.solve(phi.T @ phi + penalty, phi.T @ y), atol=1e-6)


def test_quality(spark, tables, edge, none):
    docs, labels = tables
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in rows if rows[i].held_out]
    assert np.mean([rows[i].predicted == want[i] for i in held]) > 0.9
    got = quality.quality_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0.5, 2]), np.array([1.0, 1, 3, 1]))
    assert np.allclose(np.interp([1, 2, 3, 4], x, y), [0, 0.625, 0.625, 2])


def test_normal_equations_do_not_depend_on_partitions(spark, tables):
    docs, labels = tables
    joined = quality.document_statistics(docs).join(labels.where("quality IS NOT NULL"), "doc_id").selectExpr("stats", "quality AS label")
    a, b = (quality.fit(joined.repartition(n)) for n in (1, 5))
    assert np.allclose(a.weights, b.weights, atol=1e-6)


@with_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language(spark, DATA).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = queries.op5_quality(spark, DATA).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    got = queries.op2_toxicity(spark, DATA).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.8 and np.mean([r.predicted for r in got if not r.toxic]) < 0.02
