"""Language and quality models: held-out accuracy, and odd documents."""

import zlib

import numpy as np
import pytest

from quern.llm import langid, quality

D = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_languages(docs):
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}


def test_a_mixture(docs):
    model = langid.train(docs)
    texts = {r.lang: r.text for r in docs.where("length(text) > 2000").orderBy("doc_id").limit(60).collect()}
    mixed = texts["en"][:1500] + " " + texts["de"][:1500]
    mix = model.infer(mixed)
    assert set(mix) == {"en", "de"} and 0.3 < mix["en"] < 0.7 and abs(sum(mix.values()) - 1) < 1e-6


def plain_inference(model, text):
    """The same selection with neither the bound that spares the estimate nor the one that ends it: thousands of rounds for every set of languages."""
    ids, n = np.unique(langid.trigrams(text), return_counts=True)
    p, n = model.p[ids], n.astype(float)
    p, n = p[p[:, 0] > 0], n[p[:, 0] > 0]

    def fit(kept):
        mix = np.full(len(kept), 1 / len(kept))
        for _ in range(4000):
            mix = mix * (p[:, kept].T @ (n / (p[:, kept] @ mix))) / n.sum()
        return mix, n @ np.log(p[:, kept] @ mix)

    kept = list(range(len(model.langs)))
    mix, best = fit(kept)
    while len(kept) > 1:
        rest = [k for i, k in enumerate(kept) if i != mix.argmin()]
        new, value = fit(rest)
        if best - value > langid.PENALTY * np.log(n.sum() + 1):
            break
        kept, mix, best = rest, new, value
    return {model.langs[k]: x for k, x in zip(kept, mix, strict=True)}


def test_inference_is_that_of_plain_rounds(docs):
    """Whole documents, pairs of them in different shares, and scraps."""
    model = langid.train(docs)
    texts = [r.text for r in docs.where("length(text) BETWEEN 300 AND 4000").orderBy("doc_id").limit(40).collect()]
    cases = texts[:20] + [a[: 100 * (k % 9 + 1)] + " " + b[:1000] for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False))] + [t[:25] for t in texts]
    several = 0
    for text in cases:
        want, got = plain_inference(model, text), model.infer(text)
        assert set(want) == set(got)
        assert all(abs(want[k] - got[k]) < 0.03 for k in want)
        several += len(want) > 1
    assert several >= 8


def test_many_languages(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(30)], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGS", 5)
    with pytest.raises(ValueError, match="languages"):
        langid.train(rows)


def test_odd_languages(odd, odd_rows, none, docs):
    model = langid.train(docs)
    got = langid.identify_languages(odd, model).collect()
    assert len(got) == len(odd_rows)
    for r, (i, t, *_) in zip(got, odd_rows, strict=True):
        assert r.doc_id == i and r.held_out == held(i)
        assert (r.lang_pred == "und") == (not t or not any(map(str.isalpha, t)))
    assert langid.identify_languages(none).count() == 0
    untrained = langid.identify_languages(odd, langid.train(none)).collect()
    assert {r.lang_pred for r in untrained} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {i for i, t, *_ in odd_rows if t}


def test_no_leak(docs, spark):
    """Changing the languages of held-out documents changes no prediction."""
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(langid.text_fold(F.col("doc_id")) == 1, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(changed).collect()}
    assert a == b


def test_quality(docs, spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, labels, model).join(labels, "doc_id").collect()
    out = [(r.score, r.quality) for r in got if r.held_out]
    good, bad = [s for s, q in out if q], [s for s, q in out if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    # the column expression scores as the rules do
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, labels, model).collect()}
    for i, t in texts.items():
        x = np.array([quality.statistics(t)])
        margin = model.intercept + sum(w for r, w in zip(model.rules, model.weights, strict=True) if quality._holds(x, r)[0])
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_lasso():
    rng = np.random.default_rng(0)
    z = (rng.random((2000, 30)) < 0.5).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * z[:, 3] - 2 * z[:, 7])))).astype(float)
    weights, _ = quality.fit_lasso(z, y, 0.02)
    assert set(np.flatnonzero(np.abs(weights) > 1e-6)) >= {3, 7} and (np.abs(weights) > 1e-6).sum() < 8 and weights[3] > 0 > weights[7]


def test_lasso_against_plain_descent():
    """The same objective by plain proximal steps, many of them, and the conditions of an optimum."""
    rng = np.random.default_rng(1)
    z = (rng.random((400, 12)) < 0.3).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1] + z[:, 2] - 0.3)))).astype(float)
    penalty = 0.01
    scale = np.maximum(z.std(axis=0), 0.05)
    a = z / scale

    def value(w, b):
        m = a @ w + b
        return np.mean(np.logaddexp(0, m) - y * m) + penalty * np.abs(w).sum()

    w, b = np.zeros(12), 0.0
    for _ in range(20_000):
        rest = 1 / (1 + np.exp(-(a @ w + b))) - y
        w, b = w - 0.1 * a.T @ rest / 400, b - 0.1 * rest.mean()
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * penalty, 0)
    weights, intercept = quality.fit_lasso(z, y, penalty)
    mine = weights * scale
    assert abs(value(mine, intercept) - value(w, b)) < 1e-5 and np.abs(mine - w).max() < 0.01
    gradient = a.T @ (1 / (1 + np.exp(-(a @ mine + intercept))) - y) / 400
    assert (np.abs(gradient) <= penalty + 1e-3).all() and np.allclose(gradient[mine != 0], -penalty * np.sign(mine[mine != 0]), atol=1e-3)


def test_splits_against_all():
    """The first split of a tree is the best of all that leave enough rows on both sides; every rule is a path of it."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 4)), rng.random(300)
    y[x[:, 2] > 0.4] += 1
    bars = [np.quantile(x[:, k], np.linspace(0.05, 0.95, 19)) for k in range(4)]
    best = max(
        ((y[x[:, k] > b].sum() ** 2 / (x[:, k] > b).sum() + y[x[:, k] <= b].sum() ** 2 / (x[:, k] <= b).sum(), k, b) for k in range(4) for b in bars[k] if quality.MIN_LEAF <= (x[:, k] > b).sum() <= 300 - quality.MIN_LEAF),
    )
    paths = []
    quality._grow(x, y, bars, np.arange(4), 2, (), paths)
    assert {p[0] for p in paths} == {(best[1], float(best[2]), True), (best[1], float(best[2]), False)}
    assert all(len(p) == 1 or p[:-1] in paths for p in paths) and len(paths) <= 6
    assert all(quality.MIN_LEAF <= quality._holds(x, p).sum() for p in paths)


@pytest.mark.parametrize("n", [1, 19, 40, 41, 59, 80, 99, 120, 201])
def test_peaks_see_every_word(n):
    """Whatever stands at the end of a text, or anywhere, is in some stretch."""
    peak = quality.STATS.index("symbol_peak")
    for at in {0, n // 2, n - 1}:
        words = ["clean"] * n
        words[at] = "#$%^&*#$%^&*"
        assert quality.statistics(" ".join(words))[peak] > 0
    assert quality.statistics(" ".join(["clean"] * 80 + ["@#$"] * 19))[peak] > 0.2


def test_odd_quality(odd, odd_rows, none, spark):
    labels = spark.createDataFrame([(5, 1), (5, 1), (3, 0), (3, 1), (None, 1), (7, None), (9, 0)], "doc_id bigint, quality int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
