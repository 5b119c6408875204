"""Benchmark decontamination by the q-gram lemma.

A benchmark text is cut into windows: one of 13 words from every word on (of 96 characters
at most, and from every 12 characters on within a long word), and one of 96 characters every
48. So a passage of 13 whole words, or of 108 characters (bytes of UTF-8), is found wherever
it begins. Two strings of which one, of length m, becomes the other by at most k edits share
at least m - q + 1 - k * q q-grams, all within k + 1 neighbouring diagonals (place in the
document minus place in the item). So the q-grams shared with each item are gathered in
overlapping bands of diagonals; the windows of which a band holds enough are verified by
alignment. Texts are compared in lower case, with runs of other characters than letters and
digits as one space. A benchmark text of under q characters is found as it is, as whole words.

A benchmark of several blocks costs the documents one pass for a table of bits over all its
q-grams; the blocks are searched in those documents alone that share enough with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize

Q = 12
#: Windows are this long, begin half as far apart, and allow one edit for so many characters.
WINDOW, PER_EDIT = 96, 16
#: The least passage in words; a window of so many begins at every word.
WORDS = 13
#: Diagonals in a band, besides the overlap of k with the next.
BAND = 32
#: The benchmark is broadcast in blocks of about this many bytes of text; an index takes about 25 times as much memory.
BLOCK_BYTES = 4 << 20
#: Where there are several blocks: bytes of text of which one table of bits (16 for each q-gram) tells the documents that may hold something.
TABLE_BYTES = 64 << 20
#: Pairs of places that are looked at together; a text with more is taken in stretches that overlap by more than any window takes.
PAIRS, STRETCH, OVERLAP = 1 << 18, 512, 128

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").translate(_TABLE).split())


def gram_codes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every Q-gram (12 bytes: two overlapping words of 8)."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.empty(len(raw) - 7, "<u8")
    for k in range(8):
        part = np.frombuffer(raw, "<u8", count=(len(raw) - k) // 8, offset=k)
        words[k::8] = part
    return (words[:n] * _C1) ^ (words[Q - 8 :] * _C2)


@dataclass(frozen=True)
class Window:
    item: int
    text: bytes
    edits: int
    shared: int
    start: int


def spans_of(raw: bytes) -> list[tuple[int, int]]:
    """Start and end of the item's windows; a text shorter than WINDOW is itself one window."""
    size, out = len(raw), []
    for s in range(0, max(1, size - WINDOW // 2), WINDOW // 2) if size > WINDOW else (0,):
        at = max(0, min(s, size - WINDOW))
        out.append((at, min(size, at + WINDOW)))
    starts = [0, *(i + 1 for i, c in enumerate(raw) if c == 32)]
    ends = [*(s - 1 for s in starts[1:]), size]
    for n, (s, word_end) in enumerate(zip(starts, ends, strict=True)):
        for at in range(s, max(word_end, s + 1), Q):
            last = ends[n + WORDS - 1] if n + WORDS <= len(ends) else size + 1
            end = min(last, at + WINDOW)
            if end <= size:
                out.append((at, end))
    return list(dict.fromkeys(out))


def windows_of(item: int, raw: bytes) -> list[Window]:
    """The item's windows; one too short for the lemma may not be edited."""
    out = []
    for start, end in spans_of(raw):
        grams = end - start - Q + 1
        if grams > 0:
            k = max(0, min((end - start) // PER_EDIT, (grams - 1) // Q))
            out.append(Window(item, raw[start:end], k, grams - k * Q, start))
    return out


def least_edits(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edits, end in text) of pattern against any substring of text, by the bits of whole numbers (Myers).

    The text is the stretch that a band of diagonals allows, so that this is the alignment within the band.
    """
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
    up, down, score = full, 0, len(pattern)
    best, end = score, 0
    for j, c in enumerate(text):
        x = peq.get(c, 0) | down
        same = ((up + (x & up)) ^ up) | x
        rise, fall = down | full & ~(up | same), up & same
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        rise = rise << 1 & full
        up, down = (fall << 1 | ~(rise | same)) & full, rise & same
    return best, end


class BitTable:
    """Whether a q-gram may be among those added: one bit of 16 for each."""

    def __init__(self, grams: int) -> None:
        self.bits = max(16, int(grams * 16).bit_length())
        self.table = np.zeros(1 << self.bits - 3, np.uint8)

    def add(self, codes: np.ndarray) -> None:
        at = codes >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.table, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, codes: np.ndarray) -> np.ndarray:
        at = codes >> np.uint64(64 - self.bits)
        return (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


@dataclass(frozen=True)
class Suspicion:
    """Tells which texts may hold something of a benchmark, from its q-grams alone."""

    table: BitTable
    least: int
    short: frozenset[bytes]

    def suspects(self, text: str | None) -> bool:
        """Whether so many q-grams as the least demanding window asks for lie where one window can take them, or a short item may be there."""
        raw = normal(text)
        if self.short and not self.short.isdisjoint(raw.split()):
            return True
        at = np.flatnonzero(self.table.holds(gram_codes(raw)))
        return len(at) >= self.least and bool((at[self.least - 1 :] - at[: len(at) - self.least + 1] < OVERLAP).any())


class BenchmarkIndex:
    """Q-grams of all texts of a block of the benchmark, and their windows."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        raws = sorted({(item, normal(text)) for item, text in items})
        self.short: dict[bytes, list[int]] = {}
        for item, raw in raws:
            if 0 < len(raw) < Q:
                self.short.setdefault(raw, []).append(item)
        self.short_words = sorted({raw.count(b" ") + 1 for raw in self.short})
        raws = [(item, raw) for item, raw in raws if len(raw) >= Q]
        self.items, self.raws = [item for item, _ in raws], [raw for _, raw in raws]
        windows = [np.array([(w.start, len(w.text), w.edits, w.shared) for w in windows_of(item, raw)], np.int32) for item, raw in raws]
        start, size, edits, shared = np.concatenate([np.empty((0, 4), np.int32), *windows]).T
        self.start, self.size, self.edits, self.shared = start.copy(), size.astype(np.int16), edits.astype(np.int8), shared.astype(np.int16)
        self.bounds = np.cumsum([0, *map(len, windows)])
        self.least = np.array([w[:, 3].min() for w in windows], np.int64)
        del windows, start, size, edits, shared
        # a place is counted through all texts of the block; where each begins tells whose it is
        self.offsets = np.cumsum([0, *map(len, self.raws)])
        codes = np.concatenate([np.empty(0, np.uint64), *map(gram_codes, self.raws)])
        place = np.concatenate([np.empty(0, np.uint32), *(np.arange(o, o + len(r) - Q + 1, dtype=np.uint32) for o, r in zip(self.offsets.tolist(), self.raws, strict=False))])
        order = np.argsort(codes, kind="stable")
        codes, self.place = codes[order], place[order]
        del order, place
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        self.first = np.append(np.flatnonzero(new), len(codes)).astype(np.uint32)
        self.codes = codes[new]
        self.maybe = BitTable(len(self.codes))
        self.maybe.add(self.codes)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.start, self.size, self.edits, self.shared, self.bounds, self.least, self.offsets, self.place, self.first, self.codes, self.maybe.table)) + sum(map(len, self.raws))

    def short_matches(self, raw: bytes, found: dict) -> None:
        """Adds the items of under Q characters that the text holds as whole words."""
        words = raw.split() if self.short else []
        for n in self.short_words:
            for text in {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} & self.short.keys():
                start = (b" " + raw + b" ").find(b" " + text + b" ")
                for item in self.short[text]:
                    add(found, (item, text), 0, start, start + len(text))

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, windows found, least edits, start, end) for each text of the benchmark of which a window is in the text; the place, in the normal text, of the first window with the least edits."""
        raw, found, done = normal(text), {}, {}
        self.short_matches(raw, found)
        for item, bands in self.shared_bands(raw):
            if item not in done:
                done[item] = np.zeros(self.bounds[item + 1] - self.bounds[item], bool)
            if not done[item].all():
                self.verify(raw, item, bands, found, done[item])
        return [(key[0], *got) for key, got in sorted(found.items())]

    def shared_bands(self, raw: bytes) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """(item, bands) of the whole text, or of its stretches; a stretch that the text has had before tells nothing new."""
        codes = gram_codes(raw)
        at = np.flatnonzero(self.maybe.holds(codes))
        if not len(at) or not len(self.codes):
            return
        slot = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        true = self.codes[slot] == codes[at]
        at, slot = at[true], slot[true]
        if not len(at):
            return
        many = (self.first[slot + 1] - self.first[slot]).astype(np.int64)
        if many.sum() <= PAIRS:
            yield from self.bands(at, slot)
            return
        seen: set[bytes] = set()
        for lo in range(0, len(raw), STRETCH):
            part = raw[lo : lo + STRETCH + OVERLAP]
            a, b = np.searchsorted(at, [lo, lo + STRETCH + OVERLAP - Q + 1])
            if a < b and part not in seen:
                seen.add(part)
                yield from self.bands(at[a:b], slot[a:b])

    def postings(self, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in the text and in the block, up to PAIRS or so at once: all, or those in overlapping ranges of the block."""
        begin, end = self.first[slot].astype(np.int64), self.first[slot + 1].astype(np.int64)
        total = int((end - begin).sum())
        step = max(4 * OVERLAP, int(self.offsets[-1] * PAIRS // max(1, total)))
        for g in range(0, int(self.offsets[-1]), step) if total > PAIRS else (None,):
            lo, hi = begin, end
            if g is not None:
                lo = np.array([x + np.searchsorted(self.place[x:y], g) for x, y in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
                hi = np.array([x + np.searchsorted(self.place[x:y], g + step + OVERLAP) for x, y in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
            n = hi - lo
            if n.any():
                within = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(at, n), self.place[within].astype(np.int64)

    def bands(self, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each item that shares enough with the text at these places: the bands of diagonals with enough for some window, and their shared places in the item."""
        for text_at, place in self.postings(at, slot):
            owner = np.searchsorted(self.offsets, place, side="right") - 1
            diagonal = text_at - (place - self.offsets[owner])
            # band b holds the diagonals from b * BAND on, and the edits' worth of the next band: overlapping, no place is cut
            band = diagonal // BAND
            early = diagonal - band * BAND < WINDOW // PER_EDIT
            owner, place, band = np.concatenate([owner, owner[early]]), np.concatenate([place, place[early]]), np.concatenate([band, band[early] - 1])
            low = band.min()
            order = np.lexsort((place, band, owner))
            owner, place, band = owner[order], place[order], band[order] - low
            new = np.ones(len(owner), bool)  # a band counts a place once
            new[1:] = (owner[1:] != owner[:-1]) | (band[1:] != band[:-1]) | (place[1:] != place[:-1])
            owner, place, band = owner[new], place[new], band[new]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])]))
            counts = np.diff(np.append(first, len(owner)))
            out: dict[int, list] = {}
            for k in np.flatnonzero(counts >= self.least[owner[first]]).tolist():
                lo, item = int(first[k]), int(owner[first[k]])
                out.setdefault(item, []).append((int(band[lo] + low) * BAND, place[lo : lo + int(counts[k])] - self.offsets[item]))
            yield from out.items()

    def verify(self, raw: bytes, item: int, bands: list[tuple[int, np.ndarray]], found: dict, done: np.ndarray) -> None:
        """Adds the windows of one item that the text holds; done: those found already."""
        lo, hi = self.bounds[item], self.bounds[item + 1]
        starts, sizes = self.start[lo:hi], self.size[lo:hi]
        for diag, places in bands:
            held = np.searchsorted(places, starts + sizes - Q + 1) - np.searchsorted(places, starts)
            for w in np.flatnonzero((held >= self.shared[lo:hi]) & ~done).tolist():
                start, k = int(starts[w]), int(self.edits[lo + w])
                part = self.raws[item][start : start + int(sizes[w])]
                # a match begins in the band or, where edits come before what is shared, up to k diagonals off it
                left = max(0, diag + start - k)
                region = raw[left : max(0, diag + start + BAND + len(part) + 3 * k)]
                exact = region.find(part)
                edits, end = (0, exact + len(part)) if exact >= 0 else least_edits(part, region) if k else (1, 0)
                if edits <= k:
                    done[w] = True
                    add(found, (self.items[item], self.raws[item]), edits, left + max(0, end - len(part)), left + end)


def add(found: dict, key: tuple[int, bytes], edits: int, start: int, end: int) -> None:
    got = found.setdefault(key, [0, edits, start, end])
    got[0] += 1
    got[1:] = min(got[1:], [edits, start, end])


def _rows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")


class Blocks:
    """The benchmark in blocks of about block_bytes of text each; items without a text or an id are left out."""

    def __init__(self, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES) -> None:
        self.rows = _rows(benchmark, item_col, text_col)
        size = self.rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.n, self.per_table = 1 + size // block_bytes, max(1, table_bytes // block_bytes)

    def items(self, k: int) -> list[tuple[int, str]]:
        part = self.rows if self.n == 1 else self.rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(self.n)) == k)
        return [(r.i, r.t) for r in part.orderBy("i", "t").collect()]

    def groups(self) -> Iterator[list[int]]:
        """The blocks that share a table."""
        for lo in range(0, self.n, self.per_table):
            yield list(range(lo, min(self.n, lo + self.per_table)))

    def suspicion(self, blocks: list[int], block_bytes: int) -> Suspicion:
        """What all of these blocks have in common documents by; one block's texts at a time are on the driver."""
        table, least, short = BitTable(len(blocks) * block_bytes), OVERLAP, set()
        for k in blocks:
            for _, text in self.items(k):
                raw = normal(text)
                if len(raw) >= Q:
                    table.add(gram_codes(raw))
                    least = min(least, *(w.shared for w in windows_of(0, raw)))
                elif raw:
                    short.add(raw.split()[0])
        return Suspicion(table, least, frozenset(short))


def _filtered(docs: DataFrame, at: int, keep) -> DataFrame:
    """The documents whose text (the column at `at`) passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([keep(b.column(at)[i].as_py()) for i in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _searched(rows: DataFrame, index: BenchmarkIndex) -> DataFrame:
    """(doc_id, __row, item_id, n_windows, edits, start, end) of (doc_id, __row, text) rows."""
    shared, names = rows.sparkSession.sparkContext.broadcast(index), ["doc_id", "__row", "item_id", "n_windows", "edits", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a text at a time, as there may be many items in each
                if got := shared.value.matches(b.column(2)[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(c)[i].as_py()] * len(got), pa.int64()) for c in (0, 1)] + [pa.array([g[k] for g in got], pa.int64()) for k in range(5)], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` bigint" for n in names))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, table_bytes: int, item_col: str, item_text_col: str) -> DataFrame:
    blocks = Blocks(benchmark, item_col, item_text_col, block_bytes, table_bytes)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("text"))
    if blocks.n == 1:
        return _searched(rows, BenchmarkIndex(blocks.items(0)))
    out = None
    for group in blocks.groups():
        shared = docs.sparkSession.sparkContext.broadcast(blocks.suspicion(group, block_bytes))
        suspects = materialize(_filtered(rows, 2, lambda t, shared=shared: shared.value.suspects(t)), "suspects")
        for k in group:
            part = _searched(suspects, BenchmarkIndex(blocks.items(k)))
            out = part if out is None else out.unionByName(part)
    return out


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES, item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row for every document that holds a window of the benchmark: doc_id, n_items and n_windows (texts of the benchmark, and windows of them, that it holds), and of the one with the least edits, then the least id: item_id, edits, start, end.

    Start and end are byte places in the normal text. Null and empty texts match nothing; very
    long ones are searched whole, repetitive ones in bounded memory; null ids are carried;
    repeated rows are each returned; other columns are ignored, whatever their names. Items
    without an id or a text match nothing, repeated ones count once; an empty benchmark or
    table gives no rows. The benchmark is read, and if it is large its suspects written, at once.
    """
    found = _found(docs, benchmark, id_col, text_col, block_bytes, table_bytes, item_col, item_text_col)
    # a document's rows come from few tasks and are few; the sums are partial before they are shuffled
    best = F.min(F.struct("edits", "item_id", "start", "end"))
    return found.groupBy("doc_id", "__row").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_windows").alias("n_windows"), best.alias("b")).select("doc_id", "n_items", "n_windows", "b.item_id", "b.edits", "b.start", "b.end")


def contaminating(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The other side of contaminated: item_id, n_docs (rows that hold a window of it) and edits (the least) of every item found."""
    found = _found(docs, benchmark, id_col, text_col, block_bytes, table_bytes, item_col, item_text_col)
    return found.groupBy("item_id").agg(F.count_distinct("__row").alias("n_docs"), F.min("edits").alias("edits"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES, item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """docs without those that hold a window of the benchmark; all columns stay, whatever their names.

    Null and empty texts stay; null ids and repeated rows are judged like others, very long texts whole; an empty
    benchmark drops nothing, an empty table stays empty. The benchmark is read at once.
    """
    blocks, at, context = Blocks(benchmark, item_col, item_text_col, block_bytes, table_bytes), docs.columns.index(text_col), docs.sparkSession.sparkContext

    def without(rows: DataFrame, k: int) -> DataFrame:
        index = context.broadcast(BenchmarkIndex(blocks.items(k)))
        return _filtered(rows, at, lambda t: not index.value.matches(t))

    if blocks.n == 1:
        return without(docs, 0)
    for group in blocks.groups():
        shared = context.broadcast(blocks.suspicion(group, block_bytes))
        clean, rest = _filtered(docs, at, lambda t, s=shared: not s.value.suspects(t)), _filtered(docs, at, lambda t, s=shared: s.value.suspects(t))
        for k in group:
            rest = without(rest, k)
        docs = clean.unionByName(rest)
    return docs
