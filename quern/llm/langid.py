"""Language identification as inference of a multilingual mixture.

A document's letter trigrams are taken as drawn from a mixture of languages.
Expectation-maximisation estimates the proportions; languages are dropped from the set, the
least share first, as long as the likelihood penalised by the number of languages gains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_fold

UNDETERMINED = "und"
#: Training: about this many labelled documents.
TRAIN_DOCS = 12_000
BUCKETS = 1 << 16
#: Share of the pooled trigrams in every language's model.
SMOOTH = 0.05
PENALTY = 3.0
#: Expectation-maximisation goes on until the log-likelihood is proven to be within this share of the penalty of its maximum.
GAP = 0.02
#: Languages at most: the models are a dense table of so many by BUCKETS.
MAX_LANGS = 1000

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def trigrams(text: str | None) -> np.ndarray:
    """The hashed trigrams of the lower-case text that have a letter in the middle; all else counts as one kind of gap."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)[letter[1:-1]]


class MixtureModel:
    """Trigram distributions of the learned languages."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        """counts: a row for each language, BUCKETS wide."""
        self.langs = langs
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.p = np.ascontiguousarray(((1 - SMOOTH) * share + SMOOTH * (share.mean(axis=0) if langs else 0)).T)

    def _fit(self, p: np.ndarray, n: np.ndarray, start: np.ndarray, gap: float) -> tuple[np.ndarray, float]:
        """Proportions, and the log-likelihood, by expectation-maximisation.

        The likelihood is concave: its gradient bounds what any other proportions can gain, and
        the rounds end when that is below gap. Every round gains, so they do end.
        """
        mix, total = start, n.sum()
        while True:
            joint = p @ mix
            gain = p.T @ (n / joint)
            if gain.max() - total <= gap:
                return mix, float(n @ np.log(joint))
            mix = np.maximum(mix * gain / total, 1e-12)  # so that none is lost to rounding
            mix /= mix.sum()

    def infer(self, text: str | None) -> dict[str, float] | None:
        """The selected languages' proportions, or None if the text is null, has no letter or shares no trigram with the training texts."""
        grams = trigrams(text)
        if not len(grams) or not self.langs:
            return None
        ids, n = np.unique(grams, return_counts=True)
        p = self.p[ids]
        known = p[:, 0] > 0  # smoothing: known to one language, known to all
        p, n = p[known], n[known].astype(float)
        if not len(n):
            return None
        alone = n @ np.log(p)
        best = int(alone.argmax())
        penalty = PENALTY * np.log(n.sum() + 1)
        # the likelihood is concave in the proportions: this bounds what any mixture can gain over the best language alone
        if (n @ (p / p[:, [best]]) - n.sum()).max() <= penalty:
            return {self.langs[best]: 1.0}
        kept = np.arange(len(self.langs))
        gap = GAP * penalty
        mix, fit = self._fit(p, n, np.full(len(kept), 1 / len(kept)), gap)
        while len(kept) > 1:
            rest = np.delete(np.arange(len(kept)), mix.argmin())
            if len(rest) == 1:
                mix_rest, fit_rest = np.ones(1), float(alone[kept[rest[0]]])
            else:
                mix_rest, fit_rest = self._fit(p[:, kept[rest]], n, (mix[rest] + 1e-6) / (mix[rest] + 1e-6).sum(), gap)
            if fit - fit_rest > penalty:
                break
            kept, mix, fit = kept[rest], mix_rest, fit_rest
        return {self.langs[k]: float(x) for k, x in zip(kept, mix, strict=True)}

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language of the largest share, that share, all shares); ties to the name that sorts first."""
        mix = self.infer(text)
        if not mix:
            return (self.langs[0], 0.0, {}) if self.langs and text and any(map(str.isalpha, text)) else (UNDETERMINED, 0.0, {})
        lang = min(mix, key=lambda k: (-mix[k], k))
        return lang, min(1.0, mix[lang]), mix


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS) -> MixtureModel:
    """Counts trigrams by language over about max_docs documents, drawn evenly, outside fold 1 that have a text and a language.

    No such documents: a model without languages, which predicts `und`. Over MAX_LANGS languages are an error. Runs its jobs at once.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where((text_fold(F.col("i")) != 1) & F.col("l").isNotNull() & F.col("t").isNotNull())
    total = rows.count()
    # rows are drawn one by one, so that neither a hot id nor copies come along as a whole
    drawn = rows.sample(False, max_docs / total, seed=7) if total > max_docs else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["l", "g", "n"])

    counted = drawn.select("l", "t").mapInArrow(run, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["l"].unique())
    if not langs:
        return MixtureModel([], np.zeros((0, BUCKETS)))
    if len(langs) > MAX_LANGS:
        raise ValueError(f"{len(langs)} languages to learn, {MAX_LANGS} at most")
    counts = np.zeros((len(langs), BUCKETS))
    counts[counted["l"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), counted["g"].to_numpy(int)] = counted["n"]
    return MixtureModel(langs, counts)


def identify_languages(docs: DataFrame, model: MixtureModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture (language: share) of every whole text.

    `und` with score 0 where the text is null or empty or has no letter; a very long text counts
    whole. Of equal shares the name that sorts first wins. Ids are carried, null or not (a null
    id is not held out of training, nor is it an input); repeated rows are each returned; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.predict(b.column(2)[i].as_py()) for i in range(b.num_rows)]
            mixture = pa.array([list(m.items()) for _, _, m in out], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _, _ in out], pa.string()), pa.array([s for _, s, _ in out], pa.float64()), mixture], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (text_fold(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, mixture map<string,double>")


def keep_identified(docs: DataFrame, model: MixtureModel | None = None, least_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that are `und` (null, empty or letterless texts) or whose main language has a share below least_score.

    All columns stay, whatever their names; null ids and repeated rows are judged like others, very long texts whole;
    an empty table stays empty. Without a model one is trained at once.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                lang, score, _ = shared.value.predict(b.column(at)[i].as_py())
                keep.append(lang != UNDETERMINED and score >= least_score)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
