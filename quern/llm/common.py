"""What the training-data operators share: tables, the shared scratch folder, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ship

#: A key with more than this share of all rows is joined through a broadcast: at most 1 / HOT_SHARE keys can have it.
HOT_SHARE = 0.001


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents in an Arrow batch, where the session does not say; Spark's own 10,000 whole texts take too much memory.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> None:
    """Readies a session for the operators: the package on its workers, and batches of whole texts that stay small."""
    ship(spark)
    if spark.sparkContext.getConf().get(_BATCH) is None and spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of our own if all run on this machine (as in tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths of tables written by this process, in order, for release().
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def scratch_mark() -> int:
    """How many intermediate tables were begun so far, for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes the intermediate tables begun since a scratch_mark(), but for the one at `keep`; results that read them must have been read or written before."""
    for path in _WRITTEN[since:]:
        if path != keep:
            drop_path(spark, path)
    _WRITTEN[since:] = [keep] if keep in _WRITTEN[since:] else []


#: Rows of a narrow table in one file.
ROWS_PER_FILE = 2_000_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, a narrow table of about so many rows at most, in no more partitions than cores and rows call for."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_FILE))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder at once and read back: cuts lineage and survives a lost executor; with rows: see few_files."""
    return materialize_at(df, scratch_path(df.sparkSession, name), rows)


def materialize_at(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    spark = df.sparkSession
    (df if rows is None else few_files(df, rows)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or something like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that what is made of one stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def text_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (a null id counts as the empty text); fold 1 is held out of all training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def lookup_join(rows: DataFrame, labels: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows inner-joined to labels on key; labels has one row for each non-null key and, in weight, how many rows have it.

    Keys with over HOT_SHARE of the rows (a thousand keys at most, whatever the size) are
    broadcast, so that no task gets all rows of a hot key; the others are joined by shuffle.
    """
    bar = total * HOT_SHARE
    hot = labels.filter(F.col(weight) > bar).drop(weight)
    cold = labels.filter(F.col(weight) <= bar).drop(weight)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
