"""Document quality by a sparse ensemble of rules.

Small regression trees are grown on statistics of labelled texts; every path from a root is
a conjunctive rule. Logistic regression under an L1 penalty keeps few of the rules, and the
sum of their weights is compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_fold

#: Training: at most this many labelled documents, those of least hash of their id.
TRAIN_DOCS = 12_000
N_TREES, DEPTH, MIN_LEAF, BINS = 40, 3, 30, 32
PENALTY = 2e-3

#: The statistics, in this order; shares are of words or characters as named.
STATS = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "exclaim_share", "pipe_share", "line_length",
    "repeat_share", "distinct_share", "top_word_share", "symbol_word_share", "shout_word_share", "line_repeat_share", "short_line_share", "upper_peak", "symbol_peak", "repeat_peak",
)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) and b not in b".,'\"!|")
#: Words in a stretch; a text's peaks are the largest shares among its stretches, the last of which ends with the text.
STRETCH = 40


def _share_in(raw: bytes, kinds: bytes) -> int:
    return len(raw) - len(raw.translate(None, kinds))


def statistics(text: str | None) -> list[float]:
    """STATS of a whole text; zeros for an empty or null one."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return [0.0] * len(STATS)
    upper, symbol, exclaim, pipe = _share_in(raw, _UPPER), _share_in(raw, _SYMBOL), raw.count(b"!"), raw.count(b"|")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = [a == b for a, b in zip(words, words[1:], strict=False)]
    lines = [x for x in raw.split(b"\n") if x]
    symbols = upper_peak = symbol_peak = repeat_peak = shout = 0.0
    for lo in range(0, m, STRETCH):
        lo = max(0, min(lo, m - STRETCH))
        part = words[lo : lo + STRETCH]
        joined = b" ".join(part)
        upper_peak = max(upper_peak, _share_in(joined, _UPPER) / len(joined))
        symbol_peak = max(symbol_peak, (_share_in(joined, _SYMBOL) + joined.count(b"!") + joined.count(b"|")) / len(joined))
        repeat_peak = max(repeat_peak, sum(repeats[lo : lo + STRETCH]) / len(part))
    shout = sum([v for w, v in counts.items() if w.isupper() and len(w) > 1]) / m
    symbols = sum([v for w, v in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b",")]) / m
    return [
        float(np.log1p(n)), float(np.log1p(m)), (n - m) / m, upper / n, _share_in(raw, _DIGIT) / n, symbol / n, exclaim / n, pipe / n, float(np.log1p(n / max(1, len(lines)))),
        sum(repeats) / m, len(counts) / m, max(counts.values()) / m, symbols, shout, 1 - len(set(lines)) / max(1, len(lines)), sum([len(x) < 40 for x in lines]) / max(1, len(lines)), upper_peak, symbol_peak, repeat_peak,
    ]


def with_statistics(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns of docs, and a double column for each of STATS."""
    rows = docs.select(*(f"`{c}`" for c in columns), F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), *(f"{s} double" for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(columns))
            found = np.array([statistics(texts[i].as_py()) for i in range(b.num_rows)], float).reshape(b.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[:, k]) for k in range(len(STATS)))], names=[*columns, *STATS])

    return rows.mapInArrow(run, schema)


#: A condition: (statistic's number, threshold, whether above it); a rule is a tuple of them.
Condition = tuple[int, float, bool]


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The score, from columns named as in STATS, in built-in functions alone."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, bar, above in rule:
                holds = holds & (F.col(STATS[k]) > bar if above else F.col(STATS[k]) <= bar)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{STATS[k]} {'>' if above else '<='} {bar:.4g}" for k, bar, above in r) for w, r in sorted(zip(self.weights, self.rules, strict=True), key=lambda x: -abs(x[0]))]


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, bar, above in rule:
        out &= x[:, k] > bar if above else x[:, k] <= bar
    return out


def _grow(x: np.ndarray, target: np.ndarray, bars: list[np.ndarray], stats: np.ndarray, depth: int, path: tuple[Condition, ...], out: list) -> None:
    """Adds the paths of a tree that splits by least squares; stats: those that the tree may use."""
    if path:
        out.append(path)
    if depth == 0 or len(x) < 2 * MIN_LEAF:
        return
    best, total, n = (1e-9, -1, 0.0), target.sum(), len(target)
    for k in stats:
        for bar in bars[k]:
            right = x[:, k] > bar
            r = int(right.sum())
            if min(r, n - r) >= MIN_LEAF:
                s = target[right].sum()
                gain = s * s / r + (total - s) ** 2 / (n - r) - total * total / n
                if gain > best[0]:
                    best = (gain, k, float(bar))
    _, k, bar = best
    if k >= 0:
        right = x[:, k] > bar
        for side, above in ((right, True), (~right, False)):
            _grow(x[side], target[side], bars, stats, depth - 1, (*path, (int(k), bar, above)), out)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[tuple[Condition, ...]]:
    """Distinct paths of N_TREES trees, each grown on half of the rows and two thirds of the statistics, on what those before left unexplained."""
    rng, margin = np.random.default_rng(seed), np.zeros(len(y))
    bars = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, BINS))) for k in range(x.shape[1])]
    rules: dict[tuple, None] = {}
    for _ in range(N_TREES):
        rows = rng.random(len(y)) < 0.5
        stats = np.sort(rng.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False))
        rest = y - 1 / (1 + np.exp(-margin))
        paths: list[tuple[Condition, ...]] = []
        _grow(x[rows], rest[rows], bars, stats, DEPTH, (), paths)
        for p in paths:
            rules[tuple(sorted(p))] = None
        inner = {p[:-1] for p in paths}
        for p in paths:
            if p not in inner:  # a leaf
                hit = _holds(x, p)
                margin[hit] += 2.0 * rest[hit].mean() if hit.any() else 0.0
    return list(rules)


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradients."""
    n, d = z.shape
    scale = np.maximum(z.std(axis=0), 0.05)
    a = np.hstack([z / scale, np.ones((n, 1))])
    step = 4.0 * n / (np.linalg.norm(a, 2) ** 2)
    bars = np.append(np.full(d, penalty), 0.0)
    w = v = np.zeros(d + 1)
    t = 1.0
    for _ in range(rounds):
        gradient = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        moved = v - step * gradient
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * bars, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max() < 1e-6
        w, t = new, t_new
        if done:
            break
    return w[:-1] / scale, float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """The ensemble for statistics x and labels y; with one label only, or none, a constant."""
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble((), (), 0.0 if len(y) == 0 else 4.0 * float(2 * y[0] - 1))
    rules = extract_rules(x, y)
    if not rules:
        share = y.mean()
        return RuleEnsemble((), (), float(np.log(share / (1 - share))))
    weights, intercept = fit_lasso(np.column_stack([_holds(x, r) for r in rules]).astype(float), y)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleEnsemble(tuple(rules[k] for k in kept), tuple(float(weights[k]) for k in kept), intercept)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS) -> RuleEnsemble:
    """Fits at most max_docs labelled documents outside fold 1. An id labelled both ways, or with a null, is left out."""
    named = labels.select(F.col(id_col).cast("bigint").alias("__id"), F.col(label_col).cast("int").alias("__y")).where((text_fold(F.col("__id")) != 1) & F.col("__id").isNotNull() & F.col("__y").isin(0, 1))
    single = named.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").drop("__z")
    # max_docs rows of two numbers: a bounded table, and one row for each id
    sample = single.orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__t")).where("__id IS NOT NULL").join(F.broadcast(sample), "__id")
    # one text for each id before any statistics, by a partial minimum: a hot id is one row from each task
    texts = rows.groupBy("__id").agg(F.first("__y").alias("__y"), F.min("__t").alias("__t"))
    found = with_statistics(texts, ["__id", "__y"], "__t").orderBy("__id").toPandas()
    return fit(found[list(STATS)].to_numpy(float), found["__y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, model: RuleEnsemble | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every whole text.

    Null and empty texts have statistics of zero and are scored like others; very long ones
    count whole. Texts with equal statistics have equal scores, and a score of just 0.5 is
    predicted 1. Ids are carried, null or not; repeated rows are each returned; an empty table
    gives no rows; other columns are ignored, whatever their names. Without a model one is
    trained at once; without labels it is a constant.
    """
    model = model or train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_statistics(rows, ["doc_id"]).select("doc_id", (text_fold(F.col("doc_id")) == 1).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
