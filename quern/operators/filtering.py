"""Filter trees to boolean columns: true where a row matches, false or null where it does not."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import permutations
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import any_order_column, osa_within, stem, stem_column, within_column, words_column
from quern.plans.filters import And, MatchAll, Node, Not, NumericRange, Or, Tags, Word
from quern.plans.schema import Field, IndexSchema, Settings
from quern.sources.prepare import is_path, raw_value

#: Unordered proximity is written out as every order of up to so many words.
MAX_ORDERS = 4
#: Bounds from here on are compared as doubles, as integers are then no longer exact in them.
_EXACT = float(1 << 53)
#: A tag field's raw text is tested first for up to so many tags.
_HINTS = 16


class FilterCompiler:
    """Compiles a tree for one prepared table.

    `rows` is that table, with a column more for each stem or edit distance: the words of the
    row that match. Where a cap on expansions is set, the vocabulary is read once for each
    such word while the query is compiled.
    """

    def __init__(self, schema: IndexSchema, settings: Settings, rows: DataFrame) -> None:
        self.schema, self.settings, self.rows = schema, settings, rows
        self._words: dict[tuple, list[str] | None] = {}
        self._names: dict[tuple, str] = {}

    def column(self, node: Node) -> Column:
        if isinstance(node, MatchAll):
            return F.lit(True)
        if isinstance(node, NumericRange):
            return self._range(node)
        if isinstance(node, Tags):
            return self._tags(node)
        if isinstance(node, Word):
            return reduce(or_, (self._holds(node, f) for f in node.fields))
        if isinstance(node, Not):
            # a complement needs a plain false; elsewhere a null is as good, and leaves comparisons bare for the scan
            return ~F.coalesce(self.column(node.child), F.lit(False))
        if isinstance(node, Or):
            return reduce(or_, map(self.column, node.children))
        found = reduce(and_, map(self.column, node.children))
        near = self._near(node)
        return found if near is None else found & near

    def hint(self, node: Node) -> Column | None:
        """What must hold wherever node does, in tests that a scan can do; None if there is nothing of the kind. An alternative reaches the scan in no other way."""
        if isinstance(node, NumericRange):
            return self._bounds(node) if self._raw(self.schema.field(node.field))[1] in ("tinyint", "smallint", "int", "bigint", "float", "double") else None
        if isinstance(node, Tags):
            return self._tag_text(node)
        if isinstance(node, And):
            some = [h for c in node.children if (h := self.hint(c)) is not None]
            return reduce(and_, some) if some else None
        if isinstance(node, Or):
            every = [self.hint(c) for c in node.children]
            return None if any(h is None for h in every) else reduce(or_, every)
        return None

    def _column(self, alias: str) -> Column:
        return F.col(f"`{self.schema.field(alias).column}`")

    def _raw(self, field: Field) -> tuple[Column, str]:
        """A field's own column and type; a path into JSON counts as having none."""
        return (F.lit(None), "") if is_path(self.schema, field) else raw_value(self.rows, self.schema, field)

    @staticmethod
    def _begins(prefix: str) -> Callable[[Column], Column]:
        return lambda t: t.startswith(prefix)

    def _range(self, node: NumericRange) -> Column:
        found, (raw, kind) = self._bounds(node), self._raw(self.schema.field(node.field))
        # what is no number is above any bound
        return found & ~F.isnan(raw) if kind in ("float", "double") and node.high == math.inf and not node.high_open else found

    def _bounds(self, node: NumericRange) -> Column:
        """Bare comparisons of the stored column where it is a number, which the scan can use."""
        field = self.schema.field(node.field)
        raw, kind = self._raw(field)
        if kind in ("tinyint", "smallint", "int", "bigint") and all(math.isinf(x) or abs(x) < _EXACT for x in (node.low, node.high)) and node.low < math.inf and node.high > -math.inf:
            tests = []
            if node.low > -math.inf:
                tests.append(raw >= (math.floor(node.low) + 1 if node.low_open else math.ceil(node.low)))
            if node.high < math.inf:
                tests.append(raw <= (math.ceil(node.high) - 1 if node.high_open else math.floor(node.high)))
            return reduce(and_, tests) if tests else raw.isNotNull()
        c = raw if kind in ("float", "double") else self._column(node.field)
        low = c > node.low if node.low_open else c >= node.low
        high = c < node.high if node.high_open else c <= node.high
        if node.low == -math.inf and not node.low_open:
            low = c.isNotNull()
        return low if node.high == math.inf and not node.high_open else low & high

    def _tags(self, node: Tags) -> Column:
        field = self.schema.field(node.field)
        c = self._column(node.field)
        tests = []
        if len(node.exact) == 1:
            tests.append(F.array_contains(c, node.exact[0]))
        elif node.exact:
            tests.append(F.arrays_overlap(c, F.array(*map(F.lit, node.exact))))
        for p in node.prefixes:
            tests.append(F.exists(c, self._begins(p)))
        found, text = reduce(or_, tests), self._tag_text(node)
        return found if text is None else text & found

    def _tag_text(self, node: Tags) -> Column | None:
        """What the scan can test: the stored text has one of the tags in it, or where case is folded its first letter."""
        field = self.schema.field(node.field)
        raw, kind = self._raw(field)
        wanted = [t for t in (*node.exact, *node.prefixes) if t]
        if kind != "string" or len(wanted) > _HINTS or len(wanted) < len(node.exact) + len(node.prefixes):
            return None
        parts = wanted if field.case_sensitive else [x for t in wanted for x in ((t,) if t.upper() == t.lower() else (t[0].lower(), t[0].upper()) if t[0].isascii() else (t[0],))]
        return reduce(or_, (raw.contains(x) for x in dict.fromkeys(parts)))

    # -- words

    def _vocabulary(self, fields: tuple[str, ...], keep: Callable[[DataFrame], DataFrame], limit: int | None, by: Column | None = None) -> list[str]:
        """The distinct words of the fields that pass `keep`, in order (of `by`), the first `limit` of them."""
        # a plain explode would have Spark filter by the words' number first, and so find them twice more
        every = reduce(DataFrame.unionAll, (self.rows.select(F.explode_outer(self._column(f)).alias("w")) for f in fields)).where("w IS NOT NULL")
        found = keep(every).distinct().orderBy("w" if by is None else by)
        return [r.w for r in (found if limit is None else found.limit(limit)).collect()]

    def _hidden(self, key: tuple, value: Callable[[], Column]) -> Column:
        """A column of the table for a value that is computed in Python, which no lambda can hold."""
        if key not in self._names:
            self._names[key] = f"__found_{len(self._names)}"
            self.rows = self.rows.withColumn(self._names[key], value())
        return F.col(self._names[key])

    def _stemmed(self, node: Word, field: str) -> bool:
        return node.how == "term" and self.schema.field(field).stem

    def _fixed(self, node: Word, field: str) -> list[str] | None:
        """The words that node stands for, where they are known beforehand: itself, or an expansion that is capped."""
        limit = self.settings.max_term_expansions
        if node.how == "exact" or node.how == "term" and not self._stemmed(node, field):
            return [node.text]
        if limit is None:
            return None
        key = (node, "stem" if node.how == "term" else "")
        if key not in self._words:
            w = F.col("w")
            if node.how == "term":
                goal, stemmed = stem(node.text), tuple(f for f in node.fields if self.schema.field(f).stem)

                def keep(d: DataFrame) -> DataFrame:
                    return d.where(self._may_stem(goal)(w)).distinct().where(stem_column(w) == goal)

                self._words[key] = list(dict.fromkeys([node.text, goal, *self._vocabulary(stemmed, keep, limit)]))
            elif node.how == "fuzzy":
                self._words[key] = self._vocabulary(node.fields, lambda d: d.where(self._may_be_near(node)(w)).distinct().where(within_column(w, node.text, node.distance)), limit)
            else:
                test = w.startswith(node.text) if node.how == "prefix" else w.endswith(node.text)
                # the first by the spelling read from the word's fixed side on
                some = self._vocabulary(node.fields, lambda d: d.where(test), limit + 1, F.reverse(w) if node.how == "suffix" else None)
                self._words[key] = some[:limit] if len(some) > limit else None
        return self._words[key]

    def _may_stem(self, goal: str) -> Callable[[Column], Column]:
        """A stem begins as its word does; so few words reach the stemmer."""
        return lambda w: w.startswith(goal[:1]) & (F.octet_length(w) >= self.schema.min_stem_size)

    @staticmethod
    def _may_be_near(node: Word) -> Callable[[Column], Column]:
        """A swap is two edits to the built-in distance: what is over twice the limit needs no closer look."""
        size = len(node.text.encode())
        return lambda w: F.octet_length(w).between(size - node.distance, size + node.distance) & (F.levenshtein(w, F.lit(node.text), 2 * node.distance) >= 0)

    def _matching(self, node: Word, field: str) -> Column:
        """The row's words in the field that are near to node's, or have its stem."""
        if node.how == "fuzzy":
            goal, limit = node.text.encode(), node.distance
            likely, test = self._may_be_near(node), lambda w: osa_within(w.encode(), goal, limit)
        else:
            root = stem(node.text)
            likely, test = self._may_stem(root), lambda w: stem(w) == root
        c = self._column(field)
        return self._hidden((node, field), lambda: words_column(F.array_distinct(F.filter(c, likely)), test))

    def _test(self, node: Word, field: str) -> Callable[[Column], Column]:
        """Whether node stands for a word of the field."""
        words = self._fixed(node, field)
        if words is not None:
            return lambda t: t.isin(*words) if words else F.lit(False)
        if node.how in ("prefix", "suffix"):
            return (lambda t: t.startswith(node.text)) if node.how == "prefix" else (lambda t: t.endswith(node.text))
        found = self._matching(node, field)
        if node.how == "fuzzy":
            return lambda t: F.array_contains(found, t)
        return lambda t: t.isin(node.text, stem(node.text)) | F.array_contains(found, t)

    def _holds(self, node: Word, field: str) -> Column:
        words, c = self._fixed(node, field), self._column(field)
        if words is None and node.how in ("prefix", "suffix"):
            return F.exists(c, self._test(node, field))
        if words is None:
            found = F.size(self._matching(node, field)) > 0
            return found if node.how == "fuzzy" else found | F.arrays_overlap(c, F.array(F.lit(node.text), F.lit(stem(node.text))))
        if len(words) == 1:
            return F.array_contains(c, words[0])
        return F.arrays_overlap(c, F.array(*map(F.lit, words))) if words else F.lit(False)

    # -- positions

    def _near(self, node: And) -> Column | None:
        """Whether the words stand near each other in one field; None if the conjunction asks for no places."""
        if node.slop is None and not node.inorder or sum(self._placed(c) for c in node.children) < 2:
            return None
        placed, tests = [c for c in node.children if self._placed(c)], []
        for f in self.schema.of_kind("TEXT"):
            words = [c.text for c in placed if isinstance(c, Word) and f.alias in c.fields and self._fixed(c, f.alias) == [c.text]]
            if self.schema.offsets and node.slop is not None and not node.inorder and len(placed) > MAX_ORDERS and len(set(words)) == len(placed):
                tests.append(self._within(words, f.alias, node.slop))
            elif (spans := self._spans(node, f.alias)) is not None:
                tests.append(F.size(spans) > 0)
        return reduce(or_, tests) if tests else F.lit(False)

    def _placed(self, node: Node) -> bool:
        return isinstance(node, Word) or isinstance(node, (And, Or)) and any(map(self._placed, node.children))

    def _spans(self, node: Node, field: str) -> Column | None:
        """The places of node in a field, as sorted (s, e) structs; None if it cannot stand there."""
        if isinstance(node, Word):
            if field not in node.fields:
                return None
            test, c = self._test(node, field), self._column(field)
            at = F.filter(F.transform(c, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
            if not self.schema.offsets:
                at = F.transform(at, lambda i: F.lit(0))
            return F.transform(at, lambda i: F.struct(i.alias("s"), i.alias("e")))
        placed = [c for c in node.children if self._placed(c)]
        parts = [self._spans(c, field) for c in placed]
        if isinstance(node, Or):
            parts = [p for p in parts if p is not None]
            return F.array_sort(F.array_distinct(F.concat(*parts))) if parts else None
        if any(p is None for p in parts):
            return None
        if len(parts) == 1:
            return parts[0]
        if node.inorder:
            return self._in_order(parts, node.slop)
        if node.slop is None:
            return F.array_sort(F.concat(*parts))
        if len(parts) <= MAX_ORDERS:
            return F.array_sort(F.array_distinct(F.concat(*(self._in_order(list(p), node.slop, strict=True) for p in permutations(parts)))))
        return self._hidden((node, field), lambda: any_order_column(parts, node.slop))

    def _in_order(self, parts: list[Column], slop: int | None, strict: bool = False) -> Column:
        """For every place of the first part the nearest places of the others behind it, one after the other, where the gaps are within slop."""
        relaxed = self.settings.inorder_compat and not strict
        chain = F.transform(parts[0], lambda u: F.struct(u["s"].alias("s"), u["s"].alias("at"), u["e"].alias("e"), F.lit(0).alias("gaps")))

        def behind(part: Column) -> Callable[[Column], Column]:
            return lambda p: F.struct(p.alias("p"), F.get(F.filter(part, lambda v: v["s"] >= p["at"] if relaxed else v["s"] > p["e"]), 0).alias("v"))

        for part in parts[1:]:
            linked = F.filter(F.transform(chain, behind(part)), lambda x: x["v"].isNotNull())
            chain = F.transform(
                linked,
                lambda x: F.struct(
                    x["p"]["s"].alias("s"), x["v"]["s"].alias("at"), x["v"]["e"].alias("e"), (x["p"]["gaps"] + F.greatest(F.lit(0), x["v"]["s"] - x["p"]["at"] - 1)).alias("gaps")
                ),
            )
        if slop is not None:
            chain = F.filter(chain, lambda x: x["gaps"] <= slop)
        return F.transform(chain, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    def _within(self, words: list[str], field: str, slop: int) -> Column:
        """Whether single words that differ, of which no place can be two, stand within slop others in any order: one pass over the places, with the last one of each word."""
        reach, unseen = slop + len(words) - 1, -(1 << 30)
        listed = F.array(*map(F.lit, words))
        at = F.filter(F.transform(self._column(field), lambda t, i: F.struct(F.array_position(listed, t).alias("k"), i.alias("s"))), lambda x: x["k"] > 0)
        start = F.struct(F.lit(False).alias("near"), *(F.lit(unseen).alias(f"w{k}") for k in range(len(words))))

        def step(state: Column, x: Column) -> Column:
            last = [F.when(x["k"] == k + 1, x["s"]).otherwise(state[f"w{k}"]) for k in range(len(words))]
            return F.struct((state["near"] | (F.least(*last) >= x["s"] - reach)).alias("near"), *(c.alias(f"w{k}") for k, c in enumerate(last)))

        return F.aggregate(at, start, step, lambda state: state["near"])
