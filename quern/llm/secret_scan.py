"""Secrets in texts: fixed patterns, and character Markov models for strings that no pattern names.

First-order Markov chains over characters are trained on random strings, others on ordinary
identifiers and on the words of all documents, a chain for each make of strings (which
of lower case, capitals, digits and other characters they have). A run of characters is a
secret where the log-likelihood ratio, of the likeliest random chain to the likeliest ordinary
one, passes a threshold. The ratio is a sum over transitions, so that a short string needs
more of it in each. Of strings that an ordinary chain makes, at most a share exp(-threshold)
passes (for each random chain): the threshold is the logarithm of that share.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import materialize, release, scratch_mark, slices

#: The base patterns, kinds in the order that breaks ties, least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is one match, so that the least length can stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: What the models judge: a whole run of these characters.
LEAST_MARKOV = 12
_RUN = r"A-Za-z0-9+/_\-"
CANDIDATE = re.compile(rf"(?<![{_RUN}\u00c0-\u024f])[{_RUN}]{{{LEAST_MARKOV},}}(?![{_RUN}\u00c0-\u024f])")
#: Words of the documents that ordinary chains learn from.
_ORDINARY = re.compile(rf"(?<![{_RUN}\u00c0-\u024f])[{_RUN}]{{4,}}(?![{_RUN}\u00c0-\u024f])")
#: The words of all documents are counted; those of more documents than this weigh as much as so many documents' do, or
#: the labelled samples, and with them the threshold, would mean less the larger a table is.
WEIGHT_DOCS = 2000
#: Characters of text whose words are counted before their transitions are: bounds memory.
_COUNTED = 1 << 20

#: Word stems from which ordinary identifiers are made, as labelled samples.
STEMS = (
    "account action address array average batch binary block buffer button cache channel client column command config connection content context "
    "count counter create current customer data database date default delete description device document element email enable engine entry error event "
    "example field file filter first folder format frame function global group handler header height image index input instance interface item key label "
    "last layer layout length level library license limit line list local location logger manager mapping matrix memory message method model module name "
    "network node number object offset option order output package page parameter parent path pattern payment percent pixel pointer position price process "
    "product profile project property provider query queue random record reference region release report request resource response result return river "
    "sample schema scope search section select sequence server service session setting shape signal size source start state status storage stream string "
    "style summary system table target template test thread time title total transaction type update upload user value variable vector version view "
    "warehouse weight width window worker write"
).split()


def default_samples(n: int = 4000, seed: int = 17) -> list[tuple[str, int]]:
    """n labelled strings for each label: 1 random, 0 ordinary identifiers, numbers and dates. The same at every call."""
    rng = random.Random(seed)
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = (digits + "abcdef", lower + lower.upper() + digits, lower + digits, lower + lower.upper() + digits + "+/", lower.upper() + digits, lower, lower + lower.upper())
    out = []
    for _ in range(n):
        alphabet = rng.choice(alphabets)
        out.append(("".join(rng.choice(alphabet) for _ in range(rng.randint(12, 48))), 1))
        words, style = [rng.choice(STEMS) for _ in range(rng.randint(2, 5))], rng.randrange(5)
        date = f"{rng.randint(1950, 2049)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        number = str(rng.randrange(10 ** rng.randint(4, 20)))
        name = ("_".join(words), "-".join(words), "/".join(words), words[0] + "".join(w.title() for w in words[1:]), rng.choice((date, number, "-".join(number[i : i + 4] for i in range(0, len(number), 4)))))[style]
        tail = rng.choice(("", str(rng.randrange(100)), "_v" + str(rng.randrange(10)), "-" + date)) if style < 4 else ""
        out.append((name.upper() + tail if rng.random() < 0.1 else name + tail, 0))
    return out


def make_of(text: str) -> int:
    """Which kinds of characters a string has, as bits: lower case, capitals, digits, others."""
    return (text != text.upper()) + 2 * (text != text.lower()) + 4 * any(map(str.isdigit, text)) + 8 * (not text.isalnum())


class Transitions:
    """Counts of character transitions (printable ASCII) by label and make."""

    SIZE = 95

    def __init__(self) -> None:
        self.counts: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def codes(cls, text: str) -> np.ndarray:
        return np.clip(np.frombuffer(text.encode("ascii", "replace"), np.uint8).astype(np.int64) - 32, 0, cls.SIZE - 1)

    def add(self, texts: Iterable[str], label: int) -> None:
        """Counts the transitions within each text (a Counter's as often as it says): those of one make together, set apart by spaces, which no text has."""
        by_make: dict[int, list[tuple[str, int]]] = {}
        for t, n in Counter(texts).items():
            by_make.setdefault(make_of(t), []).append((t, n))
        for make, some in by_make.items():
            c = self.codes(" ".join(t for t, _ in some))
            times = np.repeat([float(n) for _, n in some], [len(t) + 1 for t, _ in some])[:-1]
            inside = (c[:-1] > 0) & (c[1:] > 0)
            pairs = c[:-1][inside] * self.SIZE + c[1:][inside]
            self.of(label, make)[:] += np.bincount(pairs, times[:-1][inside], self.SIZE**2).reshape(self.SIZE, self.SIZE)

    def of(self, label: int, make: int) -> np.ndarray:
        return self.counts.setdefault((label, make), np.zeros((self.SIZE, self.SIZE)))


class MarkovRatio:
    """Log-likelihood ratios of strings, random against ordinary."""

    def __init__(self, transitions: Transitions, weight: float = 5.0) -> None:
        def chains(label: int) -> np.ndarray:
            """A chain for each make, which leans on the chain of all makes, which leans on the characters' shares, with so much weight."""
            held = [c for (la, _), c in sorted(transitions.counts.items()) if la == label] or [np.zeros((Transitions.SIZE, Transitions.SIZE))]
            every = np.sum(held, axis=0)
            share = (every.sum(axis=0) + 0.5) / (every.sum() + 0.5 * Transitions.SIZE)
            pooled = (every + weight * share) / (every.sum(axis=1, keepdims=True) + weight)
            log = np.log(np.array([(c + weight * pooled) / (c.sum(axis=1, keepdims=True) + weight) for c in held]))
            log[:, np.arange(Transitions.SIZE), np.arange(Transitions.SIZE)] = 0.0  # a repeated character says nothing either way
            return log

        random_, ordinary = chains(1), chains(0)
        self.log, self.n_random = np.concatenate([random_, ordinary]), len(random_)

    def score(self, text: str) -> float:
        """The likeliest random chain's log-likelihood less the likeliest ordinary one's; 0 for a text without transitions."""
        c = Transitions.codes(text)
        sums = self.log[:, c[:-1], c[1:]].sum(axis=1)
        return float(sums[: self.n_random].max() - sums[self.n_random :].max())


def word_transitions(docs: DataFrame, text_col: str, into: Transitions) -> None:
    """Adds the words, outside base spans, of all documents, weighed as WEIGHT_DOCS says. What is collected are sums: 16 makes of 95 x 95 at most.

    Keys in the documents would pass for ordinary, each by its own transitions. So words as long as candidates that pass by the
    chains held so far are set aside, and judged again by the chains that the other words give, until those left all pass: only they are not learned.
    """
    n = docs.count()
    if not n:
        return
    spark, begun, share = docs.sparkSession, scratch_mark(), min(1.0, WEIGHT_DOCS / n)
    rows, step = docs.select(F.col(text_col).alias("t")), _learn_texts
    while True:
        learned = rows.mapInArrow(partial(step, MarkovRatio(into)), "make bigint, at bigint, word string, n double")
        learned = materialize(learned.groupBy("make", "at", "word").agg(F.sum("n").alias("n")), "words")
        sums = learned.where("word IS NULL").collect()
        for r in sums:
            into.of(0, r.make).ravel()[r.at] += r.n * share
        rows, step = learned.where("word IS NOT NULL").select("word", "n"), _learn_words
        if not sums or rows.isEmpty():
            break
    release(spark, begun)


def _learn_texts(model: MarkovRatio, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: sums of the transitions of words that do not pass by the model, and, with how often they occur, the words that do."""
    found, words, held = Transitions(), Counter(), 0
    for b in batches:
        for item in b.column(0):
            text = item.as_py() or ""
            words.update(ordinary_words(text))
            held += len(text)
            if held >= _COUNTED:
                yield _learn(words, model, found)
                words, held = Counter(), 0
    yield _learn(words, model, found)
    yield from _sums(found)


def _learn_words(model: MarkovRatio, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of distinct words and how often they occur."""
    found = Transitions()
    for b in batches:
        yield _learn(Counter(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))), model, found)
    yield from _sums(found)


def _learn(words: Counter, model: MarkovRatio, into: Transitions) -> pa.RecordBatch:
    """Adds the words that do not pass and returns those that do."""
    aside = {w: float(words.pop(w)) for w in [w for w in words if len(w) >= LEAST_MARKOV and model.score(w) > THRESHOLD]}
    into.add(words, 0)
    capitals = Counter()
    for w, times in words.items():
        if w.isalpha():
            capitals[w.upper()] += times  # any word may stand in capitals
    into.add(capitals, 0)
    none = pa.nulls(len(aside), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(aside, pa.string()), pa.array(aside.values(), pa.float64())], names=["make", "at", "word", "n"])


def _sums(found: Transitions) -> Iterator[pa.RecordBatch]:
    for (_, make), counts in found.counts.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), make)), pa.array(at), pa.nulls(len(at), pa.string()), pa.array(counts.ravel()[at])], names=["make", "at", "word", "n"])


def ordinary_words(text: str) -> Iterator[str]:
    """The runs that no base span touches."""
    base, k, end = base_spans(text), 0, 0
    if not base:
        yield from _ORDINARY.findall(text)
        return
    for m in _ORDINARY.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            end = max(end, base[k][2])
            k += 1
        if end <= m.start():
            yield m[0]


def train(docs: DataFrame | None = None, samples: DataFrame | None = None, text_col: str = "text", label_col: str = "label", max_rows: int = 20_000) -> MarkovRatio:
    """Models from labelled samples (1 random, 0 ordinary; at most max_rows of them by hash order; default_samples() if none are given) and, as ordinary ones, the words of all docs that do not pass by the samples alone. Runs its jobs at once."""
    if samples is None:
        labelled = default_samples()
    else:
        rows = samples.select(F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("int").alias("l")).where("t IS NOT NULL AND l IN (0, 1)")
        labelled = [(r.t, r.l) for r in rows.orderBy(F.xxhash64("t"), "t", "l").limit(max_rows).collect()]
    transitions = Transitions()
    for label in (0, 1):
        transitions.add([t.replace(" ", "") for t, la in labelled if la == label], label)
    if docs is not None:
        word_transitions(docs, text_col, transitions)
    return MarkovRatio(transitions)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end): leftmost non-overlapping matches of each kind, then those long enough."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def model_spans(text: str, model: MarkovRatio, threshold: float, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, ratio) of candidates that lie in no base span and whose ratio passes the threshold."""
    out, k, end = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][0] <= a:
            end = max(end, base[k][2])
            k += 1
        if end < b and (ratio := model.score(m[0])) > threshold:
            out.append((a, 3, b, ratio))
    return out


def find_secrets(text: str | None, model: MarkovRatio, threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]:
    """(base spans, all spans, the ratios of those that the models add) in order."""
    base = base_spans(text or "")
    added = model_spans(text or "", model, threshold, base)
    return base, sorted(base + [x[:3] for x in added]), [x[3] for x in added]


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_spans string, spans string, ratios array<double>"
#: One ordinary string in a hundred thousand may pass.
THRESHOLD = math.log(1e5)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, model: MarkovRatio | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: SCHEMA. Spans are kind:start:end in code points, end exclusive, by start, then kind; ratios has one number for each markov span.

    A null or empty text has none; a very long one is searched whole, in time that grows with it; ids are carried,
    null or not; repeated rows give repeated rows; an empty table gives none; other columns are ignored, whatever
    their names. Without a model one is trained at once, on the documents' words among others.
    """
    model = model or train(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find_secrets(t, model, threshold) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in every) for _, every, _ in found], pa.int64()) for kind in range(4)]
            written = [pa.array([_written(x[i]) for x in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, *written, pa.array([r for *_, r in found], pa.list_(pa.float64()))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_spans", "spans", "ratios"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """text with every span, overlapping ones together, replaced by mark."""
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def _in_type(sizes: list[int | None], kind: pa.DataType) -> pa.Array:
    """Numbers in a column's own type; null where they do not fit."""
    if pa.types.is_integer(kind):
        most = (1 << kind.bit_width - 1) - 1
    else:
        most = 10 ** (kind.precision - kind.scale) - 1 if pa.types.is_decimal(kind) else 1 << 62
    make = Decimal if pa.types.is_decimal(kind) else float if pa.types.is_floating(kind) else int if pa.types.is_integer(kind) else str
    return pa.array([None if n is None or n > most else make(n) for n in sizes], kind)


def redact_secrets(docs: DataFrame, model: MarkovRatio | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the secrets in text_col replaced by mark; all columns and rows stay, repeated ones and null ids too, whatever other columns are named.

    Null and empty texts stay as they are; very long ones are searched whole; an empty table stays empty. count_col
    gets the number of characters of the texts that change, in its own type: an integer, another number or a string
    (null where it does not fit; a column of any other type is left alone). Without a model one is trained at once.
    """
    model = model or train(docs, text_col=text_col)
    at, kind = docs.columns.index(text_col), dict(docs.dtypes).get(count_col, "")
    counts = docs.columns.index(count_col) if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string")) and kind != "interval" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            new = [t and redact(t, find_secrets(t, model, threshold)[1], mark) for t in texts]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.column(at).type)
            if counts is not None and (changed := [n != t for n, t in zip(new, texts, strict=True)]) and any(changed):
                sizes = _in_type([len(n) if c else None for n, c in zip(new, changed, strict=True)], columns[counts].type)
                columns[counts] = pc.if_else(pa.array(changed), sizes, columns[counts])
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in docs.schema]))
