"""Fuzzy search for short licence notices.

A notice with K allowed edits is split into K + 1 pieces; by the pigeonhole principle one of
them occurs unchanged in every place within K edits. Exact finds of the pieces give
candidate windows, where the regex library's bounded-error matching verifies the edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import slices

#: Bytes that belong to no word become spaces, A-Z become a-z; every byte of a non-ASCII character is a word's.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # over text in its own case

#: The phrases that count as base places, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    """label, and parts of (words, allowed edits); what tells one licence from another allows none."""

    label: str
    parts: tuple[tuple[str, int], ...]

    @property
    def text(self) -> str:
        return "".join(t for t, _ in self.parts)

    @property
    def edits(self) -> int:
        return sum(k for _, k in self.parts)

    def pieces(self) -> list[tuple[int, bytes]]:
        """(offset, piece): edits + 1 pieces of near-equal length."""
        raw, n = self.text.encode(), self.edits + 1
        cuts = [len(raw) * i // n for i in range(n + 1)]
        return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def pattern(self, best: bool) -> regex.Pattern:
        """Whole words within the allowed edits: the first place that has them, or the one with the fewest."""
        body = "".join(f"(?:{regex.escape(t)}){{e<={k}}}" if k else regex.escape(t) for t, k in self.parts)
        return regex.compile(f"{'(?b)' if best else ''}(?<![^ ])(?:{body})(?![^ ])".encode())


#: The notices looked for by default, in the words of the licences themselves.
NOTICES = (
    Notice("mit", (("under the ", 1), ("mit", 0), (" license", 1))),
    Notice("mit", (("permission is hereby granted free of charge to any person obtaining a copy", 4),)),
    Notice("apache-2", (("apache", 1), (" license version ", 1), ("2", 0))),
    Notice("cc-by-nc", (("cc by nc", 0),)),
    Notice("cc-by-nc", (("creative commons attribution ", 2), ("noncommercial", 1))),
    Notice("cc-by-sa", (("cc by sa", 0),)),
    Notice("gpl-2", (("gnu ", 0), ("general public license version ", 2), ("2", 0))),
    Notice("gpl-3", (("gnu ", 0), ("general public license version ", 2), ("3", 0))),
    Notice("lgpl", (("gnu ", 0), ("lesser general public license", 2))),
    Notice("agpl", (("gnu ", 0), ("affero general public license", 2))),
    Notice("mpl-2", (("mozilla public license version ", 2), ("2", 0))),
    Notice("bsd", (("redistribution and use in source and binary forms", 3),)),
    Notice("unlicense", (("free and unencumbered software released into the public domain", 3),)),
    Notice("all-rights-reserved", (("all rights reserved", 1),)),
)

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,errors:int,text:string>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("errors", pa.int32()), ("text", pa.string())]))),
])


class Finder:
    """The places of one notice in text that has single spaces around every word.

    From the left on: the first place within the allowed edits, or what overlaps it with the
    fewest edits; then the same behind it.
    """

    def __init__(self, notice: Notice) -> None:
        self.label, self.length, self.edits, self.pieces = notice.label, len(notice.text), notice.edits, notice.pieces()
        self.first, self.best = notice.pattern(False), notice.pattern(True)

    def reach(self, start: int) -> int:
        """Before here ends whatever begins at start, or a little later."""
        return start + self.length + 2 * self.edits + 2

    def best_at(self, joined: bytes, start: int) -> regex.Match:
        """The best match among those that begin with or soon after the first one, at start; the stretch ends with a word, and begins before one, as the library inserts nothing where a search begins."""
        return self.best.search(joined, max(0, start - 1), joined.rfind(b" ", start, self.reach(start)))

    def windows(self, joined: bytes) -> list[int]:
        """Where the notice would begin, judged by the exact pieces, in order."""
        starts = set()
        for offset, piece in self.pieces:
            at = joined.find(piece)
            while at >= 0:
                starts.add(at - offset)
                at = joined.find(piece, at + 1)
        return sorted(starts)

    def matches(self, joined: bytes) -> Iterator[regex.Match]:
        pos, starts, at = 0, self.windows(joined), 0
        while at < len(starts):
            # the first match begins in the first window that has one, or in one that begins before it
            found, k = None, at
            while k < len(starts) and (found is None or starts[k] - self.edits - 1 <= found):
                lo = max(pos, starts[k] - self.edits - 1)
                hi = joined.rfind(b" ", lo, self.reach(starts[k])) if lo < self.reach(starts[k]) else -1
                m = self.first.search(joined, lo, hi) if hi > lo else None
                if m and (found is None or m.start() < found):
                    found = m.start()
                elif found is None:
                    at = k + 1
                k += 1
            if found is None:
                return
            best = self.best_at(joined, found)
            yield best
            pos = best.end()


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        self.finders = [Finder(n) for n in notices]
        self.base = [(f" {p} ".encode(), label) for p, label in BASE]

    def _fuzzy(self, joined: bytes) -> Iterator[tuple[str, int, int, int, int]]:
        """(label, start, end, errors, notice length) in joined, which has single spaces around every word."""
        for f in self.finders:
            for m in f.matches(joined):
                yield f.label, m.start(), m.end(), sum(m.fuzzy_counts), f.length

    def scan(self, text: str | None) -> tuple:
        """One row's values, in the order of SCHEMA without the id."""
        raw = (text or "").encode("utf-8", "replace")
        words = raw.translate(_TABLE).split()
        joined = b" " + b" ".join(words) + b" "
        hits, base = [], set()
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                hits.append(at)
                base.add(label)
                at = joined.find(phrase, at + 1)
        found = sorted({x for x in self._fuzzy(joined)}, key=lambda x: (x[1], x[0], x[2]))
        spans, score = [], 1.0 if hits else 0.0
        # the space before each word, in order, so that a place is a word's number by one search
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if hits or found else None
        places = np.searchsorted(gaps, hits).tolist() if hits else []
        if found:
            where = [m.span() for m in _WORD.finditer(text)]
            for label, start, end, errors, length in found:
                score = max(score, 1.0 - errors / length)
                inner = joined[start:end]
                first = int(np.searchsorted(gaps, start)) - 1 + (inner[:1] == b" ")
                last = first + len(inner.split()) - 1
                a, b = where[first][0], where[last][1]
                spans.append({"label": label, "start": a, "end": b, "errors": errors, "text": text[a:b]})
        labels = base | {x[0] for x in found}
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices in every whole text: SCHEMA, with a span (code points) for each notice found.

    A null or empty text has no words and the score 0; a very long one is scanned whole, in time that grows with it;
    the id is carried, null or not; repeated rows give repeated rows; an empty table gives none; other columns are
    ignored, whatever their names. Of places of a notice that overlap one counts (see Finder). The score is 1 - edits / length of the best match, 1 where a base phrase stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in slices(batches):
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_ARROW)[1:])], schema=_ARROW)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)
