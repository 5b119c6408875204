"""The pipeline against its stages done plainly, one document at a time."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from quern.llm import bpe, decontam, langid, queries, secret_scan

from .test_scans import brute_secrets
from .test_simhash import brute_components, brute_fingerprint

D = "/root/testdata/sf0.001"
RUN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def grams(raw):
    return {raw[i : i + decontam.Q] for i in range(len(raw) - decontam.Q + 1)}


def plainly_contaminated(windows, text):
    """Whether some window is in the text within its edits: each that shares enough q-grams with it, wherever, is aligned with all of it (test_decontam holds the alignment to the whole table)."""
    raw = decontam.normal(text)
    held = grams(raw)
    return any(w.text in raw or len(held & g) >= len(g) - w.edits * decontam.Q and decontam.least_edits(w.text, raw)[0] <= w.edits for w, g in windows)


def plain_words(text):
    """Whole runs of 4 characters or more that no base span touches."""
    base, edge = [(int(a), int(b)) for _, a, b in (x.split(":") for x in brute_secrets(text).split(",") if x)], RUN | set(map(chr, range(0xC0, 0x250)))
    for a, b in runs(text):
        if b - a >= 4 and not (a and text[a - 1] in edge) and not (b < len(text) and text[b] in edge) and not any(x < b and y > a for x, y in base):
            yield text[a:b]


def plainly_redacted(text, model):
    """Base spans as the contract words them, runs of 12 characters or more found by hand; what overlaps becomes one mark."""
    spans = [(int(a), int(b)) for _, a, b in (x.split(":") for x in brute_secrets(text).split(",") if x)]
    base, edge = list(spans), RUN | set(map(chr, range(0xC0, 0x250)))
    for a, b in runs(text):
        whole = not (a and text[a - 1] in edge) and not (b < len(text) and text[b] in edge)
        if whole and b - a >= 12 and not any(x <= a and b <= y for x, y in base) and model.score(text[a:b]) > secret_scan.THRESHOLD:
            spans.append((a, b))
    out, at = "", 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = b
    return out + text[at:]


def runs(text):
    start = None
    for i, c in enumerate(text + " "):
        if c in RUN and start is None:
            start = i
        elif c not in RUN and start is not None:
            yield start, i
            start = None


def test_against_plain_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.train(docs)
    rows = {i: t for i, t in rows.items() if model.predict(t)[0] != "und" and model.predict(t)[1] >= 0.4}
    ids = sorted(rows)
    kept = {ids[c] for c in brute_components([brute_fingerprint(rows[i]) for i in ids])}
    windows = [(w, grams(w.text)) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect() for w in decontam.windows_of(r.item_id, decontam.normal(r.text))]
    bad = {i for i in kept if plainly_contaminated(windows, rows[i])}
    assert bad and len(bad) < len(kept) / 2
    markov, word = secret_scan.train(spark.createDataFrame([(rows[i],) for i in kept - bad], "text string")), bpe.codec(bpe.tokenizer_path())
    want = set()
    for i in kept - bad:
        ids = word.library.encode(plainly_redacted(rows[i], markov), add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(word.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, D).collect()} == want


def test_secrets_learn_from_every_document(spark):
    """Of many documents, twelve spell out an odd word of their own, which stays; twelve others hold a key, which goes."""
    rng, n = random.Random(2), 6000
    at = rng.sample(range(n), 24)
    odd_words = {i: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)) for i in at[:12]}
    keys = {i: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(24)) for i in at[12:]}

    def text(i, key):
        parts = f"{odd_words[i][:8]} {odd_words[i][4:12]} {odd_words[i][8:]} " * 200 + odd_words[i] if i in odd_words else ""
        return f"a plain line of the document number {i} with {key} {parts}"

    docs = spark.createDataFrame([(i, text(i, keys.get(i, "none"))) for i in range(n)], "doc_id bigint, text string").repartition(4)
    out = {r.doc_id: r.text for r in corpus_pipeline.replace_secrets(spark, docs, D).collect()}
    assert out == {i: text(i, "[SECRET]" if i in keys else "none") for i in range(n)}


def test_secrets_learn_every_word(spark):
    """All words of all documents are learned, counted by hand: long ones that pass by the labelled samples alone too, words between odd marks, but no parts of words with accents."""
    texts = [r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    texts += ["`quoted` {braced} |barred| ~waved~ \u00a0spaced\u00a0 «cited», r\u00e9unions \u00c4rztehaus d\u00e9veloppementale"]
    words, alone = Counter(w for t in texts for w in plain_words(t)), secret_scan.train()
    assert sum(alone.score(w) > secret_scan.THRESHOLD for w in words if len(w) >= 12) > 100
    want = secret_scan.Transitions()
    for label in (0, 1):
        want.add([t for t, la in secret_scan.default_samples() if la == label], label)
    for word, n in words.items():
        for w in [word, word.upper()] if word.isalpha() else [word]:
            for a, b in zip(w[:-1], w[1:], strict=True):
                want.of(0, secret_scan.make_of(w))[ord(a) - 32, ord(b) - 32] += n * min(1, secret_scan.WEIGHT_DOCS / len(texts))
    model = secret_scan.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(model.log, secret_scan.MarkovRatio(want).log, rtol=0, atol=1e-9)


def test_secrets_between_odd_marks(spark):
    """A key between marks that no word holds goes, whatever marks; one that touches a letter with an accent is no whole run."""
    key = "9fK2mQz7Xb4TnL8vRc3W"
    texts = [f"the key {a}{key}{b} of a line" for a, b in ("``", "{}", "||", "~~", "\u00a0\u00a0", "«»", "()", ";.")]
    docs = spark.createDataFrame(list(enumerate([*texts, f"the key \u00e9{key} of a line"])), "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.replace_secrets(spark, docs, D).collect()}
    assert out == {**{i: t.replace(key, "[SECRET]") for i, t in enumerate(texts)}, len(texts): f"the key \u00e9{key} of a line"}


def test_stages_keep_columns(spark, odd, none):
    for docs in (odd, none):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, D)
            assert out.columns == docs.columns, name
            at = out
        assert corpus_pipeline.STAGES[-1][1](spark, at, D).columns[:2] == ["doc_id", "n_tokens"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query(spark, name):
    df = queries.QUERIES[name](spark, D)
    assert df.count() > 0 or name.startswith("op7")
