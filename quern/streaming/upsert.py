"""Continuous ingestion: a stream of changes keeps a table of documents up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.plans.schema import KEY

SEQUENCE, DELETED, BUCKET = "__seq", "__deleted", "__bucket"


def latest(changes: DataFrame, key: str = KEY, seq: str = SEQUENCE) -> DataFrame:
    """The last change of each key, by partial maxima, so that a hot key is no burden."""
    columns = [c for c in changes.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*(f"`{c}`" for c in columns)), F.col(seq)).alias("r"))
    return newest.select(key, "r.*")


def merge(state: DataFrame | None, changes: DataFrame, key: str = KEY, seq: str = SEQUENCE) -> DataFrame:
    """state after changes: the last write of a key wins, late changes lose; a deletion stays as a mark, so that they do."""
    every = changes if state is None else state.unionByName(changes, allowMissingColumns=True)
    return latest(every, key, seq)


def live(state: DataFrame, key: str = KEY) -> DataFrame:
    """The documents of a state: what is not deleted, without the bookkeeping."""
    return state.where(~F.coalesce(F.col(DELETED), F.lit(False))).drop(SEQUENCE, DELETED)


class UpsertTable:
    """A versioned table of documents in buckets of their keys' hashes: each batch of changes rewrites the buckets that it touches.

    Version n lies in `data/v=n` (the touched buckets alone) and `index/v=n` (for every bucket
    the version that holds it, at most `buckets` rows), which is written last: a version is
    whole when its index is. A batch that is run again (after a failure) writes the same
    version. Old versions are kept for readers that still hold them; vacuum() removes what the
    last two do not need. Marks of deletion stay, so that late changes lose; compact() drops those
    before a sequence number that no later change can be before.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = KEY, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self, folder: str) -> list[int]:
        """The versions that have a folder there, in order."""
        fs, at = self._files()
        if not fs.exists(at(f"{self.path}/{folder}")):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(at(f"{self.path}/{folder}")) if f.isDirectory())
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def versions(self) -> list[int]:
        """The versions that are whole, in order."""
        fs, at = self._files()
        return [v for v in self._numbers("index") if fs.exists(at(f"{self.path}/index/v={v}/_SUCCESS"))]

    def index(self, version: int) -> dict[int, int]:
        """The version that holds each bucket."""
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/index/v={version}").collect()}

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        out = None
        for version in sorted(set(held.values())):
            part = self.spark.read.parquet(f"{self.path}/data/v={version}").where(F.col(BUCKET).isin([b for b, v in held.items() if v == version]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return None if out is None else out.drop(BUCKET)

    def state(self, before: int | None = None) -> DataFrame | None:
        good = [v for v in self.versions() if before is None or v < before]
        return self._read(self.index(good[-1])) if good else None

    def documents(self) -> DataFrame | None:
        state = self.state()
        return None if state is None else live(state, self.key)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`").cast("string")), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        """`buckets` numbers at most."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def _write(self, rows: DataFrame, version: int, held: dict[int, int], touched: set[int]) -> None:
        # a bucket in one file, or in as many as the session's limit of records makes
        rows.withColumn(BUCKET, self.bucket()).repartition(F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/v={version}")
        new = sorted((held | {b: version for b in touched}).items())
        self.spark.createDataFrame(new, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/v={version}")

    def apply(self, changes: DataFrame, version: int) -> None:
        """Makes `version` of the last one before it and the changes."""
        good = [v for v in self.versions() if v < version]
        held = self.index(good[-1]) if good else {}
        touched = self._touched(changes)
        self._write(merge(self._read({b: v for b, v in held.items() if b in touched}), changes, self.key), version, held, touched)

    def compact(self, version: int, horizon) -> None:
        """Makes `version` of the last one without the marks of deletion before the sequence number `horizon`."""
        good = [v for v in self.versions() if v < version]
        if good:
            held = self.index(good[-1])
            kept = self._read(held).where(~(F.coalesce(F.col(DELETED), F.lit(False)) & (F.col(SEQUENCE) < horizon)))
            self._write(kept, version, {}, self._touched(kept))

    def vacuum(self) -> None:
        fs, at = self._files()
        whole = self.versions()
        needed = {v for n in whole[-2:] for v in self.index(n).values()}
        for v in whole[:-2]:
            fs.delete(at(f"{self.path}/index/v={v}"), True)
        for v in self._numbers("data"):
            if v not in needed and v < max(whole, default=0):
                fs.delete(at(f"{self.path}/data/v={v}"), True)

    def start(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs a stream of changes (key, __seq, __deleted and fields) into the table."""
        return changes.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda df, n: self.apply(df, n)).start()
