"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on the document ids.

A file holds a range of ids in ascending order, each row with its place in the file; stripes
are read in parallel, and a filter on doc_id skips files, stripes and row groups by their
statistics and Bloom filters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quern.llm.bpe import byte_symbols
from quern.llm.common import scratch_path

END_ID = 2
#: Pre-tokens whose ids a worker keeps; beyond it starts anew.
CACHE_PIECES = 800_000
STRIPE_BYTES, ROWS_PER_INDEX = 16 << 20, 1000
#: Bytes of the table (as Spark estimates them) in a part, where the session's shuffle partitions do not make smaller ones.
PART_BYTES = 256 << 20
#: Texts, and characters of them, that are encoded in one go; a longer text makes one of its own.
RUN_TEXTS, RUN_CHARS = 1000, 32 << 20

_LETTER = "A-Za-zÀ-ÖØ-öø-ž"
#: Texts of these characters alone (space and newline are their only white space) are cut into pre-tokens here, others by the library.
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-ž]*")
#: The byte-level pre-tokenizer's pattern, for texts in which no two characters of white space meet.
_PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s")

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedEncoder:
    """The tokenizers library behind a cache of pre-tokens, whose ids do not depend on what is around them."""

    def __init__(self, path: str) -> None:
        # the file's model over pre-tokens that are cut and written in byte symbols here; the model's own cache only costs time
        self.pieces = Tokenizer.from_file(path)
        if self.pieces.normalizer is not None or not isinstance(self.pieces.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError("the tokenizer is not a byte-level one")
        self.pieces.pre_tokenizer = None
        self.pieces.model._resize_cache(0)
        self.special = [t.content for t in self.pieces.get_added_tokens_decoder().values()]
        self.symbols = dict(enumerate(byte_symbols()))
        vocabulary = self.pieces.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.path = path
        self._empty()

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _empty(self) -> None:
        self._kept: dict[str, bytes] = {}
        self._learn([" "])
        self._kept["\n"] = np.array([self.pieces.token_to_id(self.symbols[10])], "<u4").tobytes()

    def _direct(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pre-tokens, none of which holds a newline, in one call and keeps them."""
        written = "\n".join(pieces).encode().decode("latin-1").translate(self.symbols).split(self.symbols[10])
        ids = np.array(self.pieces.encode_batch_fast([written], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        # where a pre-token ends, one of its tokens does
        ends = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w) for w in written])) + 4).tolist()
        raw, kept, at = ids.tobytes(), self._kept, 0
        for piece, end in zip(pieces, ends, strict=True):
            kept[piece] = raw[at:end]
            at = end

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers, with `end` behind them."""
        out: list[bytes] = [end] * len(texts)
        cut: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        new: set[str] = set()
        known = self._kept.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if any([s in text for s in self.special]) or not _PLAIN.fullmatch(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
                out[i] = self._direct(text) + end
                continue
            pieces = _PIECE.findall(text)
            ids = list(map(known, pieces))
            gaps = [k for k, x in enumerate(ids) if x is None]
            new.update([pieces[k] for k in gaps])
            cut.append((i, pieces, ids, gaps))
        if new:
            if len(self._kept) + len(new) > CACHE_PIECES:
                self._empty()
            self._learn(list(new))
        for i, pieces, ids, gaps in cut:
            for k in gaps:
                ids[k] = self._kept[pieces[k]]
            ids.append(end)
            out[i] = b"".join(ids)
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """The encoder of a worker process, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


#: Relative precision of the ids' quantiles that part the files.
_PRECISION = 20_000


def part_of(doc_id: Column, tie: Column, bounds: list[int]) -> Column:
    """The number of the range that an id falls into; an id that several bounds equal is spread over their ranges by tie.

    Bounds are searched in two steps, so that a row is compared with few of them.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    lasts, table = F.array(*(F.lit(g[-1]) for g in groups)), F.array(*(F.array(*map(F.lit, g)) for g in groups))

    def count(below: Callable[[Column], Column]) -> Column:
        """How many bounds are below."""
        full = F.size(F.filter(lasts, below))
        return F.least(full * width, F.lit(len(bounds))) + F.coalesce(F.size(F.filter(F.get(table, full), below)), F.lit(0))

    low, high = count(lambda b: b < doc_id), count(lambda b: b <= doc_id)
    return (low + F.pmod(tie, high - low + 1)).cast("int")


FILE_SCHEMA = "doc_id bigint, part int, at bigint, n_tokens bigint, ids array<int>"


def runs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of pieces of a column that hold few texts and few characters, or one long text."""
    lo, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py()
        if held and (len(held) >= RUN_TEXTS or size + len(text or "") > RUN_CHARS):
            yield lo, held
            lo, held, size = i, [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield lo, held


def parts_for(docs: DataFrame) -> int:
    """How many files: the session's shuffle partitions, or more where they would hold over PART_BYTES of the table as Spark estimates it; at most _PRECISION."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(_PRECISION, max(least, int(str(size)) // PART_BYTES)))


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Writes FILE_SCHEMA rows to the folder `to`: the parts in ascending order, rows within each in ascending doc_id order (null first).

    Rows of one id (or of none), however many and however alike, are dealt to the parts that their id spans. A
    null or empty text has the end id alone; a very long one is encoded whole, by itself. Repeated rows are written
    each; other columns are ignored, whatever their names; an empty table writes no rows. Runs two jobs at once.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for lo, texts in runs(b.column(1)):
                raw = enc.encode_many(texts, end)
                sizes = np.array([len(x) // 4 for x in raw], np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(raw)), pa.array(np.full(len(raw), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), ids],
                    names=["doc_id", "part", "at", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"`{text_col}` AS text")
    n = partitions or parts_for(rows)
    # quantiles of the ids alone: a range partitioning of Spark's own would read all texts for its sample
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = rows.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(_PRECISION, n))).first()[0] if n > 1 else None
    tie = F.xxhash64(F.monotonically_increasing_id())
    ordered = rows.repartitionById(n, part_of(key, tie, list(bounds or []))).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    (
        ordered.mapInArrow(run, FILE_SCHEMA)
        .write.option("compression", "zstd")  # ids as run-length encoding packs them still shrink by two fifths
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROWS_PER_INDEX))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(to)
    )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """FILE_SCHEMA rows; a filter on doc_id is pushed down to the files' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(folder)


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, base): the ids in all parts before; one row for each file."""
    ends = read_tokens(spark, folder).groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    return ends.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS base")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all rows before), n_tokens and ids_crc32 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            raw = memoryview(values).cast("B")
            sums = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, folder).select("doc_id", "part", "at", "ids").mapInArrow(run, "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint")
    # a row for each file that write_tokens made, so as many as it had partitions
    bases = F.broadcast(part_starts(spark, folder))
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, **how) -> DataFrame:
    """write_tokens to the shared folder at once, then token_digests (lazily); odd input as write_tokens has it: every row is returned, and an empty table gives none."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, folder, **how)
    return token_digests(spark, folder)
