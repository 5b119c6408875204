"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding.

A token sequence is the BPE encoding of its text exactly if every two neighbours are
compatible: encoded together, they stay the two tokens that they are. So for every prefix
of a piece there is one last token: the one that ends there and is compatible with the last
token of the prefix before it. An automaton with suffix links (of Aho and Corasick, over the
vocabulary: it finds the same matches as a suffix automaton of each text would, and is built
once) gives all tokens that end at a position; the tokens found for the prefixes are the
back-pointers that yield the ids. Decoding starts from the ids alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: A character with the end-of-word suffix is one symbol: its code point plus this.
_WORD_END = 0x20000
#: Pieces of text and pairs of tokens of which a worker keeps what it found; beyond that it starts anew.
CACHE_PIECES, CACHE_PAIRS = 300_000, 200_000
#: Pieces longer than this are not kept.
_LONG = 64

#: The letters and digits among the characters of _PLAIN.
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ž", "0-9²³¹¼-¾"
#: Characters for which Python's normalisation, lower case and classes equal the tokenizers library's; texts with others go through the library's own normaliser and pre-tokenizer.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-įĲ-ž]*")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that byte-level pre-tokenizers write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [chr(moved.get(b, b)) for b in range(256)]


class BpeModel:
    """The merges of a tokenizers file, and the dynamic programme over them."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None = None) -> None:
        self.suffix, self.vocab = suffix, vocab
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in merges]
        symbols = [(self._symbols(a), self._symbols(b)) for a, b in pairs]
        self.rank = {p: i for i, p in reversed(list(enumerate(symbols)))}
        self.ids = {self._symbols(t): i for t, i in vocab.items()}
        self.built = {a + b: (a, b) for a, b in reversed(symbols) if a + b in self.ids}
        self.automaton = ahocorasick.Automaton()
        for s in self.ids:
            if len(s) == 1 or s in self.built:
                self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        self._spines: dict[str, tuple[list, list]] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _WORD_END) if body else token
        return token

    def _spine(self, token: str) -> tuple[list, list]:
        """((symbol, rank of the merge that ends it), ...) along the token's left edge and along its right edge, from the first symbol on."""
        if token not in self._spines:
            sides = []
            for side in (0, 1):
                chain, end = [], float("inf")
                at = token
                while True:
                    chain.append((at, end))
                    if at not in self.built:
                        break
                    parts = self.built[at]
                    end, at = self.rank[parts], parts[side]
                sides.append(chain[::-1])
            self._spines[token] = (sides[0], sides[1])
        return self._spines[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right stay as they are when encoded together."""
        key = (left, right)
        if key not in self._fits:
            if len(self._fits) >= CACHE_PAIRS:
                self._fits.clear()
            self._fits[key] = self._stay_apart(self._spine(left)[1], self._spine(right)[0])
        return self._fits[key]

    def _stay_apart(self, left: list, right: list) -> bool:
        """Follows the two symbols beside the border through time; a merge across it must come before either symbol's own next merge."""
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = left[i], right[j]
            across = self.rank.get((a, b))
            if across is not None and across < a_end and across <= b_end:
                return False
            if a_end == b_end == float("inf"):
                return True
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def _is_whole(self, token: str) -> bool:
        """Whether the merges make this token of its own text (true of every token of a trained vocabulary)."""
        if token not in self._whole:
            parts = self.built.get(token)
            self._whole[token] = parts is None or self._is_whole(parts[0]) and self._is_whole(parts[1]) and self._joins(*parts)
        return self._whole[token]

    def _joins(self, left: str, right: str) -> bool:
        """Whether nothing but the merge of left and right takes place across their border."""
        i = j = 0
        a_side, b_side = self._spine(left)[1], self._spine(right)[0]
        while True:
            (a, a_end), (b, b_end) = a_side[i], b_side[j]
            across = self.rank.get((a, b))
            if across is not None and across < a_end and across <= b_end:
                return (a, b) == (left, right)
            if a_end == b_end == float("inf"):
                return False
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one pre-tokenized piece, written in byte symbols."""
        if not piece:
            return []
        if self.suffix:
            piece = piece[:-1] + chr(ord(piece[-1]) + _WORD_END)
        if piece in self.ids and self._is_whole(piece):
            return [self.ids[piece]]
        n = len(piece)
        last: list[str | None] = [None] * (n + 1)  # the last token of the encoding of each prefix
        for end, token in self.automaton.iter(piece):
            if last[end + 1] is None:
                start = end + 1 - len(token)
                before = last[start]
                if (start == 0 or before is not None and self.fits(before, token)) and self._is_whole(token):
                    last[end + 1] = token
        if last[n] is None:
            raise ValueError(f"the vocabulary has no symbols for {piece!r}")
        out, at = [], n
        while at:
            out.append(self.ids[last[at]])
            at -= len(last[at])
        return out[::-1]


class BpeCodec:
    """Whole texts to ids and back, as the tokenizers library does with the same file and no added special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        self.library = Tokenizer.from_file(path)
        self.model = BpeModel(model["vocab"], model["merges"], model.get("end_of_word_suffix"))
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.bytes = byte_symbols()
        pre = config["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(pre[0]["pattern"]["Regex"])
        self.decoder = config.get("decoder")
        # the pieces' pattern in explicit classes, which says the same of plain characters
        self.plain_pieces = re.compile(self.pieces.pattern.replace(r"\p{L}", _LETTER).replace(r"\p{N}", _DIGIT).replace(f"[[{_LETTER}]", f"[{_LETTER}"))
        self._named = {str(i): t for i, t in self.tokens.items()}
        self._ids: dict[str, str] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces in their own characters and keeps what they come to."""
        if len(self._ids) + len(pieces) > CACHE_PIECES:
            self._ids = {}
        for p in pieces:
            self._ids[p] = " ".join(map(str, self.model.encode_piece(p if p.isascii() else "".join([self.bytes[b] for b in p.encode()]))))

    def _segment(self, text: str) -> str:
        if _PLAIN.fullmatch(text):
            pieces = self.plain_pieces.findall(text.lower())
            if new := set(pieces).difference(self._ids):
                self._learn(new if len(self._ids) + len(new) <= CACHE_PIECES else set(pieces))
            found = " ".join(map(self._ids.__getitem__, pieces))
            for p in new:
                if len(p) > _LONG:
                    del self._ids[p]
            return found
        clean = self.library.normalizer.normalize_str(text)
        return " ".join([str(i) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(clean) for i in self.model.encode_piece(p)])

    def encode_written(self, text: str | None) -> str:
        """Decimal ids, joined by one space."""
        text = text or ""
        if not self.special_split or not any([s in text for s in self.special]):
            return self._segment(text)
        parts = [str(self.special[x]) if x in self.special else self._segment(x) for x in self.special_split.split(text)]
        return " ".join([x for x in parts if x])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_written(text).split()]

    def decode_written(self, ids: str) -> str:
        """The text of decimal ids that are joined by one space."""
        if self.decoder is None:
            return " ".join(map(self._named.__getitem__, ids.split()))
        return self.library.decode([int(i) for i in ids.split()], skip_special_tokens=False)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space where the file names no decoder (as here); else what its decoder makes of them."""
        return self.decode_written(" ".join(map(str, ids)))


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The codec of a worker process, made once."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text encoded, and its ids decoded again: token count and digests of ids and decoded text.

    A null or empty text has no tokens, and its digests are those of the empty string; a very long one is encoded
    whole; ids are carried, null or not; repeated rows give repeated rows; an empty table gives none; other columns
    are ignored, whatever their names.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            counts, digests, decoded = [], [], []
            for i in range(b.num_rows):
                ids = c.encode_written(b.column(1)[i].as_py())
                counts.append(ids.count(" ") + 1 if ids else 0)
                digests.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode_written(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with an array<int> column of ids added (or replaced, where docs has one of that name).

    All rows stay, repeated ones and null ids too, and all other columns as they are; a null or empty text gives an
    empty array, a very long one is encoded whole; an empty table stays empty.
    """
    path = path or tokenizer_path()
    kept = [c for c in docs.columns if c != out_col]
    rows = docs.select(*(f"`{c}`" for c in kept))
    at = kept.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([c.encode(b.column(at)[i].as_py()) for i in range(b.num_rows)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str | None = None, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """rows with the decoded text of an array<int> column added (or replaced); a null array gives a null, an empty one the empty text; all rows and other columns stay."""
    path = path or tokenizer_path()
    kept = [c for c in rows.columns if c != out_col]
    rows = rows.select(*(f"`{c}`" for c in kept))
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))
