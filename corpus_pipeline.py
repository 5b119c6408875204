"""A training-corpus pipeline of five stages; each takes and returns a table of documents.

Every stage works on all that the one before kept. All but the last return the columns of
documents: the first three drop rows, the fourth replaces secrets in the texts, the last adds
the token ids of each text and the digests of ids and decoded text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontam, langid, secret_scan, simhash
from quern.llm.common import materialize_at, ready, release, scratch_mark, scratch_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ready(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in which no language has a fair share, go.

    Null ids, repeated rows and other columns, whatever their names, stay with their text; a very
    long text is judged whole; of equal shares the language that sorts first counts; an empty table stays empty.
    """
    return langid.keep_identified(docs)


@_stage
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; of ties and repeated rows one.

    Null and empty texts are a group; a null id stays where its group has no other; very long
    texts are hashed whole; other columns stay, whatever their names; an empty table stays empty.
    """
    return simhash.keep_one_of_each(docs)


@_stage
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, perhaps edited, go.

    Null and empty texts, and all rows of an empty benchmark's documents, stay; null ids and repeated
    rows are judged by their texts, very long ones whole; other columns stay; an empty table stays empty.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows where the text changes, in its own type.

    All rows and columns stay, with null ids, repeated rows, null and empty texts; very long texts are
    searched whole; an empty table stays empty.
    """
    return secret_scan.redact_secrets(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text that is left.

    Null and empty texts have no tokens, very long ones are encoded whole; null ids and repeated
    rows are each returned, other columns are not; an empty table gives no rows.
    """
    return bpe.encode_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("benchmark", remove_benchmark),
    ("secrets", replace_secrets),
    ("bpe", encode),
]

#: SQL has no edit-bounded matching, Markov chains or expectation-maximisation: tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again for the next; what is read no more is deleted."""
    docs, begun = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        kept = scratch_path(spark, name)
        docs = materialize_at(stage(spark, docs, sf_dir), kept)
        release(spark, begun, keep=kept)
    return STAGES[-1][1](spark, docs, sf_dir)
