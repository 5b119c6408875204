"""Index definitions and the catalog that holds them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

#: Default punctuation and stop words.
PUNCTUATION = ",.<>{}[]\"':;!@#$%^&*()-+=~/\\|?"
STOP_WORDS = tuple(
    "a is the an and are as at be but by for if in into it no not of on or such that their then there these they this to was will with".split()
)
KEY = "__key"
NUMERIC, TAG, TEXT, VECTOR = "NUMERIC", "TAG", "TEXT", "VECTOR"
MAX_PREFIXES, MAX_FIELDS, MAX_TEXT_FIELDS = 8, 1000, 64
MAX_DIM, MAX_M, MAX_EF_CONSTRUCTION, MAX_EF_RUNTIME = 32768, 2_000_000, 1_000_000, 1_000_000


class QueryError(ValueError):
    """A definition or query that is refused."""


@dataclass(frozen=True)
class Field:
    """One indexed field: the alias names it in queries, the identifier in the documents."""

    alias: str
    kind: str
    identifier: str = ""
    separator: str = ","
    case_sensitive: bool = False
    suffix: bool = False
    stem: bool = True
    algorithm: str = "FLAT"
    dim: int = 0
    metric: str = "L2"
    initial_cap: int = 10240
    block_size: int = 1024
    m: int = 16
    ef_construction: int = 200
    ef_runtime: int = 10

    def __post_init__(self) -> None:
        if not self.identifier:
            object.__setattr__(self, "identifier", self.alias)
        if self.kind not in (NUMERIC, TAG, TEXT, VECTOR):
            raise QueryError(f"unknown field type {self.kind!r}")
        if self.kind == TAG and len(self.separator) != 1:
            raise QueryError("a tag separator is one character")
        if self.kind == VECTOR:
            if not 1 <= self.dim <= MAX_DIM:
                raise QueryError(f"DIM must be between 1 and {MAX_DIM}")
            if self.metric not in ("L2", "IP", "COSINE"):
                raise QueryError(f"unknown distance metric {self.metric!r}")
            if self.algorithm not in ("FLAT", "HNSW"):
                raise QueryError(f"unknown vector algorithm {self.algorithm!r}")
            for name, value, most in (("M", self.m, MAX_M), ("EF_CONSTRUCTION", self.ef_construction, MAX_EF_CONSTRUCTION), ("EF_RUNTIME", self.ef_runtime, MAX_EF_RUNTIME)):
                if self.algorithm == "HNSW" and not 1 <= value <= most:
                    raise QueryError(f"{name} must be between 1 and {most}")

    @property
    def column(self) -> str:
        """The prepared column that predicates read."""
        return f"__{self.kind.lower()}_{self.alias}"

    @property
    def score_name(self) -> str:
        return f"__{self.alias}_score"


@dataclass(frozen=True)
class IndexSchema:
    name: str
    fields: tuple[Field, ...]
    on: str = "HASH"
    prefixes: tuple[str, ...] = ()
    language: str = "ENGLISH"
    score: float = 1.0
    score_field: str | None = None
    skip_initial_scan: bool = False
    punctuation: str = PUNCTUATION
    stop_words: tuple[str, ...] = STOP_WORDS
    offsets: bool = True
    min_stem_size: int = 4
    db: int = 0

    def __post_init__(self) -> None:
        if self.on not in ("HASH", "JSON"):
            raise QueryError("an index is ON HASH or ON JSON")
        if not self.fields:
            raise QueryError("an index needs a field")
        if len(self.fields) > MAX_FIELDS or sum(f.kind == TEXT for f in self.fields) > MAX_TEXT_FIELDS:
            raise QueryError(f"at most {MAX_FIELDS} fields, {MAX_TEXT_FIELDS} of them TEXT")
        for what in ("alias", "identifier"):
            names = [getattr(f, what) for f in self.fields]
            if len(set(names)) < len(names):
                raise QueryError(f"two fields have the same {what}")
        if len(self.prefixes) > MAX_PREFIXES:
            raise QueryError(f"at most {MAX_PREFIXES} prefixes")
        if not 0 <= self.score <= 1:
            raise QueryError("SCORE must be between 0 and 1")
        if self.language.upper() != "ENGLISH":
            raise QueryError(f"unsupported language {self.language!r}")
        kept: list[str] = []
        for p in self.prefixes:  # one that an earlier one covers adds nothing
            if not any(p.startswith(k) for k in kept):
                kept.append(p)
        object.__setattr__(self, "prefixes", tuple(kept))
        object.__setattr__(self, "stop_words", tuple(w.lower() for w in self.stop_words))

    def field(self, alias: str) -> Field | None:
        return next((f for f in self.fields if f.alias == alias), None)

    def of_kind(self, kind: str) -> list[Field]:
        return [f for f in self.fields if f.kind == kind]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> IndexSchema:
        raw = json.loads(text)
        fields = tuple(Field(**f) for f in raw.pop("fields"))
        return IndexSchema(fields=fields, **{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


@dataclass(frozen=True)
class Settings:
    """Limits and compatibility switches of an engine."""

    query_bytes: int = 10_240
    query_depth: int = 1_000
    query_terms: int = 1_000
    tag_min_prefix: int = 2
    fuzzy_max_distance: int = 3
    #: Words that a prefix, suffix, edit distance or stem stands for: None is all of them; a number (200 is usual) is the first so many by their spelling.
    max_term_expansions: int | None = None
    max_knn: int = 10_000
    inorder_compat: bool = False
    #: Release whose gated behaviour applies: from (1, 2, 1) on non-empty strings are true and bad numbers NaN; from (1, 3, 0) on a document with a bad field is dropped whole.
    emulate: tuple[int, int, int] = (1, 0, 0)
    strict_load: bool = False
    l2_sqrt: bool = False
    sort_max: int = 10

    def since(self, *version: int) -> bool:
        return self.emulate >= tuple(version)


@dataclass
class Catalog:
    """Index definitions by database and name."""

    entries: dict[tuple[int, str], object] = field(default_factory=dict)

    def add(self, db: int, name: str, entry: object) -> None:
        if (db, name) in self.entries:
            raise QueryError(f"index {name} already exists")
        self.entries[db, name] = entry

    def get(self, db: int, name: str) -> object:
        if (db, name) not in self.entries:
            raise QueryError(f"index {name} not found")
        return self.entries[db, name]

    def drop(self, db: int, name: str) -> object:
        entry = self.get(db, name)
        del self.entries[db, name]
        return entry

    def names(self, db: int) -> Iterator[str]:
        return (name for d, name in self.entries if d == db)


def parse_create(tokens: list[str], db: int = 0) -> IndexSchema:
    """An index definition from command tokens: name, options in any order, SCHEMA and the fields."""
    at, name = 1, tokens[0] if tokens else ""
    if not name:
        raise QueryError("an index needs a name")
    options: dict = {}

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise QueryError("the command ends too early")
        at += 1
        return tokens[at - 1]

    def number(least: int = 0) -> int:
        text = take()
        if not text.isdigit() or int(text) < least:
            raise QueryError(f"{text!r} is not a count")
        return int(text)

    while True:
        word = take().upper()
        if word == "SCHEMA":
            break
        if word == "ON":
            options["on"] = take().upper()
        elif word == "PREFIX":
            options["prefixes"] = tuple(take() for _ in range(number(1)))
        elif word == "SCORE":
            options["score"] = float(take())
        elif word == "SCORE_FIELD":
            options["score_field"] = take()
        elif word == "LANGUAGE":
            options["language"] = take().upper()
        elif word == "SKIPINITIALSCAN":
            options["skip_initial_scan"] = True
        elif word == "PUNCTUATION":
            options["punctuation"] = take()
        elif word == "STOPWORDS":
            options["stop_words"] = tuple(take() for _ in range(number()))
        elif word == "NOSTOPWORDS":
            options["stop_words"] = ()
        elif word in ("WITHOFFSETS", "NOOFFSETS"):
            options["offsets"] = word == "WITHOFFSETS"
        elif word == "MINSTEMSIZE":
            options["min_stem_size"] = number(1)
        elif word == "NOSTEM":
            options["nostem"] = True
        elif word == "WITHSUFFIXTRIE":
            options["suffix"] = True
        else:
            raise QueryError(f"{word} is not supported here")
    nostem, suffix = options.pop("nostem", False), options.pop("suffix", False)
    fields = []
    while at < len(tokens):
        identifier = alias = take()
        if at < len(tokens) and tokens[at].upper() == "AS":
            take()
            alias = take()
            if any(c in PUNCTUATION for c in alias):
                raise QueryError(f"the alias {alias!r} has punctuation in it")
        kind, more = take().upper(), {}
        if kind == VECTOR:
            more["algorithm"] = take().upper()
            end = at + 1 + number()
            given = set()
            while at < end:
                option = take().upper()
                given.add(option)
                if option == "TYPE":
                    if take().upper() != "FLOAT32":
                        raise QueryError("a vector's TYPE is FLOAT32")
                elif option == "DISTANCE_METRIC":
                    more["metric"] = take().upper()
                elif option in ("DIM", "INITIAL_CAP", "BLOCK_SIZE", "M", "EF_CONSTRUCTION", "EF_RUNTIME"):
                    more[option.lower()] = number()
                else:
                    raise QueryError(f"{option} is no option of a vector")
            if missing := {"TYPE", "DIM", "DISTANCE_METRIC"} - given:
                raise QueryError(f"a vector needs {', '.join(sorted(missing))}")
        elif kind == TEXT:
            more = {"stem": not nostem, "suffix": suffix}
        while at < len(tokens) and tokens[at].upper() in ("SORTABLE", "SEPARATOR", "CASESENSITIVE", "NOSTEM", "WITHSUFFIXTRIE", "NOSUFFIXTRIE", "WEIGHT"):
            option = take().upper()
            if option == "SORTABLE":
                continue
            if option in ("SEPARATOR", "CASESENSITIVE") and kind != TAG or option in ("NOSTEM", "WITHSUFFIXTRIE", "NOSUFFIXTRIE", "WEIGHT") and kind != TEXT:
                raise QueryError(f"{option} does not go with {kind}")
            if option == "SEPARATOR":
                more["separator"] = take()
            elif option == "CASESENSITIVE":
                more["case_sensitive"] = True
            elif option == "WEIGHT":
                if float(take()) != 1.0:
                    raise QueryError("WEIGHT must be 1.0")
            elif option == "NOSTEM":
                more["stem"] = False
            else:
                more["suffix"] = option == "WITHSUFFIXTRIE"
        fields.append(Field(alias, kind, identifier, **more))
    return replace(IndexSchema(name, tuple(fields), **options), db=db)
