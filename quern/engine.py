"""The engine: a session's indexes, and the commands over them."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quern.operators import aggregate as aggregation
from quern.operators import search as searching
from quern.operators.aggregate import Stage
from quern.operators.search import SearchOptions
from quern.plans.commands import parse_aggregate, parse_search, split_command
from quern.plans.schema import KEY, TAG, TEXT, VECTOR, Catalog, Field, IndexSchema, QueryError, Settings, parse_create
from quern.session import ship
from quern.sources.prepare import prepare, typed
from quern.sources.snapshot import load_snapshot, save_snapshot


@dataclass(frozen=True)
class Index:
    schema: IndexSchema
    source: DataFrame
    key: str = KEY


class Engine:
    """Declares indexes over tables of keyed documents and queries them.

    A table has a key column and a column for each field, or for JSON documents one column
    named `$`. Every query returns a lazy DataFrame.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, db: int = 0) -> None:
        self.spark, self.settings, self.db, self.catalog = spark, settings or Settings(), db, Catalog()
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(spark)

    # -- definitions

    def create(self, schema: IndexSchema, source: DataFrame, key: str = KEY) -> IndexSchema:
        """Declares an index over source, whose column `key` names its documents; with skip_initial_scan it begins empty."""
        if key not in source.columns:
            raise QueryError(f"the table has no key column {key!r}")
        schema = replace(schema, db=self.db)
        self.catalog.add(self.db, schema.name, Index(schema, source.limit(0) if schema.skip_initial_scan else source, key))
        return schema

    def drop(self, name: str) -> None:
        self.catalog.drop(self.db, name)

    def names(self) -> DataFrame:
        """The names of the database's indexes."""
        return self.spark.createDataFrame([(n,) for n in self.catalog.names(self.db)], "name string")

    def index(self, name: str) -> Index:
        return self.catalog.get(self.db, name)

    def replace_source(self, name: str, source: DataFrame) -> None:
        """Puts another table behind an index, as a stream of changes does."""
        self.catalog.entries[self.db, name] = replace(self.index(name), source=source)

    def prepared(self, name: str) -> DataFrame:
        found = self.index(name)
        return prepare(found.source, found.schema, self.settings, found.key)

    def info(self, name: str) -> DataFrame:
        """One row: counts (documents, field values (records), words and distinct words, and for each field the documents that have it), then the definition and the state."""
        return self._counts(name).withColumns(self._definition(self.index(name).schema))

    def _definition(self, schema: IndexSchema) -> dict[str, Column]:
        """What does not depend on the documents. A table is read whole by every query, so that no backfill or queue is ever open."""

        def listed(values: tuple[str, ...]) -> Column:
            return F.array(*map(F.lit, values)).cast("array<string>")

        attributes = F.array(*(F.struct(F.lit(f.identifier).alias("identifier"), F.lit(f.alias).alias("attribute"), F.lit(f.kind).alias("type"), F.lit(self._details(f)).alias("details")) for f in schema.fields))
        out = {
            "prefixes": listed(schema.prefixes), "default_score": F.lit(float(schema.score)), "score_field": F.lit(schema.score_field or ""), "attributes": attributes, "language": F.lit(schema.language.lower()),
            "backfill_in_progress": F.lit(0), "backfill_complete_percent": F.lit(1.0), "mutation_queue_size": F.lit(0), "recent_mutations_queue_delay": F.lit("0 sec"), "state": F.lit("ready"),
        }
        if schema.of_kind(TEXT):
            out |= {"punctuation": F.lit(schema.punctuation), "stop_words": listed(schema.stop_words), "with_offsets": F.lit(int(schema.offsets)), "min_stem_size": F.lit(schema.min_stem_size)}
        return out

    @staticmethod
    def _details(f: Field) -> str:
        """The options of a field."""
        if f.kind == TAG:
            return f"SEPARATOR {f.separator}" + (" CASESENSITIVE" if f.case_sensitive else "")
        if f.kind == TEXT:
            return ("WITHSUFFIXTRIE" if f.suffix else "NOSUFFIXTRIE") + ("" if f.stem else " NOSTEM")
        if f.kind == VECTOR:
            built = f" M {f.m} EF_CONSTRUCTION {f.ef_construction} EF_RUNTIME {f.ef_runtime}" if f.algorithm == "HNSW" else f" BLOCK_SIZE {f.block_size}"
            return f"{f.algorithm} DIM {f.dim} DISTANCE_METRIC {f.metric} INITIAL_CAP {f.initial_cap}{built}"
        return ""

    def _counts(self, name: str) -> DataFrame:
        schema, rows = self.index(name).schema, self.prepared(name)
        failed = F.count_if(reduce(or_, (typed(rows, schema, f)[1] for f in schema.fields))).alias("hash_indexing_failures")
        texts = [F.col(f"`{f.column}`") for f in schema.of_kind(TEXT)]
        have = {f.alias: F.count(F.when(F.size(c) > 0, c) if f.kind == TAG else c) for f in schema.fields for c in (F.col(f"`{f.column}`"),)}
        words = F.sum(sum((F.coalesce(F.size(t), F.lit(0)) for t in texts), F.lit(0)).cast("bigint")) if texts else F.lit(0).cast("bigint")
        tags = [F.coalesce(F.sum(F.size(F.col(f"`{f.column}`"))), F.lit(0)).cast("bigint").alias(f"{f.alias}_tags") for f in schema.of_kind(TAG)]
        vectors = [F.lit(f.dim).alias(f"{f.alias}_dim") for f in schema.of_kind(VECTOR)]
        counted = rows.agg(
            F.lit(schema.name).alias("index_name"), F.lit(schema.on).alias("key_type"), F.count(F.lit(1)).alias("num_docs"), sum(have.values(), F.lit(0)).cast("bigint").alias("num_records"),
            F.coalesce(words, F.lit(0)).alias("num_words"), failed, *(c.alias(f"{a}_docs") for a, c in have.items()), *tags, *vectors,
        )
        if not texts:
            return counted.withColumn("num_terms", F.lit(0).cast("bigint"))
        terms = rows.select(F.explode_outer(F.concat(*(F.coalesce(t, F.array()) for t in texts))).alias("w")).agg(F.count_distinct("w").alias("num_terms"))
        # one row and one row: put one below the other, then each column's only value taken
        both = counted.unionByName(terms, allowMissingColumns=True)
        return both.agg(*(F.max(c).alias(c) for c in both.columns))

    # -- queries

    def search(self, name: str, query: str, **options) -> DataFrame:
        found = self.index(name)
        return searching.search(found.source, found.schema, query, self.settings, SearchOptions(**options), found.key)

    def total(self, name: str, query: str, **options) -> int:
        found = self.index(name)
        return searching.total(found.source, found.schema, query, self.settings, SearchOptions(**options), found.key)

    def aggregate(self, name: str, query: str, *stages: Stage, **options) -> DataFrame:
        found = self.index(name)
        return aggregation.aggregate(found.source, found.schema, query, self.settings, SearchOptions(**options), tuple(stages), found.key)

    def execute(self, command: str | list, source: DataFrame | None = None, key: str = KEY) -> DataFrame | None:
        """A command in tokens or as a line: FT.CREATE (over `source`), FT.DROPINDEX, FT._LIST, FT.INFO, FT.SEARCH, FT.AGGREGATE."""
        tokens = split_command(command)
        if not tokens:
            raise QueryError("an empty command")
        name, rest = tokens[0].upper(), tokens[1:]
        if name == "FT.CREATE":
            if source is None:
                raise QueryError("FT.CREATE needs the table to index")
            self.create(parse_create(rest, self.db), source, key)
            return None
        if name == "FT.DROPINDEX":
            self.drop(*rest[:1])
            return None
        if name == "FT._LIST":
            return self.names()
        if name == "FT.INFO":
            scopes = {"LOCAL", "PRIMARY", "CLUSTER", "ALLSHARDS", "SOMESHARDS", "CONSISTENT", "INCONSISTENT"}
            if bad := [w for w in rest[1:] if w.upper() not in scopes]:
                raise QueryError(f"unexpected {bad[0]!r}")
            return self.info(rest[0])
        return self._query(name, rest)[0]

    def _query(self, name: str, rest: list) -> tuple[DataFrame, int]:
        """A search's or aggregation's result, and its time-out in milliseconds."""
        if name == "FT.SEARCH":
            index, query, options = parse_search(rest)
            found = self.index(index)
            return searching.search(found.source, found.schema, query, self.settings, options, found.key), options.timeout
        if name == "FT.AGGREGATE":
            index, query, options, stages = parse_aggregate(rest)
            found = self.index(index)
            return aggregation.aggregate(found.source, found.schema, query, self.settings, options, stages, found.key), options.timeout
        raise QueryError(f"unknown command {name}")

    def rows(self, command: str | list) -> list[Row]:
        """A search's or aggregation's rows, collected; its jobs are cancelled, and the command refused, when its TIMEOUT is over."""
        tokens = split_command(command)
        if not tokens:
            raise QueryError("an empty command")
        context, tag = self.spark.sparkContext, f"quern-{uuid.uuid4().hex}"
        over, done = threading.Event(), threading.Event()

        def stop() -> None:
            over.set()
            while not done.wait(0.1):  # jobs that begin later too
                context.cancelJobsWithTag(tag)

        context.addJobTag(tag)
        try:
            df, timeout = self._query(tokens[0].upper(), tokens[1:])
            timer = threading.Timer(timeout / 1000, stop)
            if timeout:
                timer.start()
            try:
                return df.collect()
            except Exception as e:
                if over.is_set():
                    raise QueryError(f"the search took longer than {timeout} ms") from e
                raise
            finally:
                timer.cancel()
        finally:
            done.set()
            context.removeJobTag(tag)

    # -- snapshots

    def save(self, name: str, path: str) -> None:
        """Writes an index: its definition and its documents."""
        found = self.index(name)
        save_snapshot(found.source, found.schema, found.key, path)

    def load(self, path: str) -> IndexSchema:
        """Declares an index as save() wrote it."""
        schema, source, key = load_snapshot(self.spark, path)
        self.catalog.add(self.db, schema.name, Index(replace(schema, db=self.db), source, key))
        return schema
