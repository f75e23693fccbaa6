"""A keyed table whose erasure and compaction rewrite only the buckets they touch.

Rows are dealt to hash buckets by their key.  Every write is a *generation*: a Parquet
folder partitioned by bucket.  A manifest lists the live (generation, bucket) pairs; a
new version of it is one small table, and writing it is what makes a change visible.
A job that dies before leaves a folder that no manifest names and that the next write
replaces; of two writers that start from one version, the second fails.

* ``append`` adds versions of rows; readers take the latest one per key.
* ``compact`` folds the buckets that have several generations.
* ``erase`` rewrites the buckets in which an erased key really occurs.
* ``vacuum`` deletes the folders of buckets that the manifest no longer names.

A bucket's rows are written by several tasks (a hash of the row within the bucket), so
one key with a large part of the rows is no single task's work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.operators.vault import upsert_latest

#: Files that one generation has of a bucket at most.
BUCKET_FILES = 8


@dataclass(frozen=True)
class KeyedStore:
    """``key``: what rows are dealt and erased by; ``row_key``: what tells rows apart (starts with ``key``)."""

    spark: SparkSession
    path: str
    key: str
    row_key: Sequence[str]
    version: str
    schema: str
    buckets: int = 64

    # ------------------------------------------------------------------ manifest
    def versions(self) -> int:
        """Number of changes so far."""
        try:
            last = self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("change")).first()[0]
        except AnalysisException:  # nothing was written yet
            return 0
        return last or 0

    def live(self) -> list[tuple[int, int]]:
        """The (generation, bucket) pairs that make up the table: at most a few per bucket."""
        n = self.versions()
        if not n:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifest/change={n}").where("generation > 0")
        return sorted((r.generation, r.bucket) for r in rows.collect())

    def _commit(self, change: int, pairs: Sequence[tuple[int, int]]) -> None:
        rows = [(g, b) for g, b in pairs] or [(0, 0)]
        table = self.spark.createDataFrame(rows, "generation int, bucket int").coalesce(1)
        table.write.mode("error").parquet(f"{self.path}/manifest/change={change}")

    # --------------------------------------------------------------------- reads
    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def _rows(self, pairs: Sequence[tuple[int, int]]) -> DataFrame:
        if not pairs:
            return self.spark.createDataFrame([], f"{self.schema}, generation int, bucket int")
        reader = self.spark.read.schema(f"{self.schema}, generation int, bucket int").option("basePath", f"{self.path}/rows")
        return reader.parquet(*[f"{self.path}/rows/generation={g}/bucket={b}" for g, b in pairs])

    def rows(self) -> DataFrame:
        """All versions of all rows."""
        return self._rows(self.live()).drop("generation", "bucket")

    def latest(self) -> DataFrame:
        """The latest version of each row."""
        return upsert_latest(self.rows(), list(self.row_key), self.version)

    # -------------------------------------------------------------------- writes
    def _write(self, df: DataFrame, change: int) -> list[tuple[int, int]]:
        """A new generation; the buckets that it has."""
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in self.row_key], F.col(self.version)), F.lit(BUCKET_FILES))
        target = f"{self.path}/rows/generation={change}"
        df.repartition("bucket", salt).write.mode("overwrite").partitionBy("bucket").parquet(target)
        try:
            have = self.spark.read.parquet(target).select("bucket").distinct().collect()
        except AnalysisException:  # no rows, no files
            have = []
        return [(change, r.bucket) for r in have]

    def append(self, df: DataFrame) -> None:
        """Further versions of rows."""
        change, before = self.versions() + 1, self.live()
        self._commit(change, before + self._write(self._dealt(df), change))

    def _replace(self, buckets: set[int], kept) -> None:
        change, before = self.versions() + 1, self.live()
        old = [p for p in before if p[1] in buckets]
        new = self._write(kept(self._rows(old)), change)
        self._commit(change, [p for p in before if p[1] not in buckets] + new)

    def compact(self, generations: int = 2) -> list[int]:
        """Buckets of at least so many generations keep the latest version of each row; which these were."""
        count: dict[int, int] = {}
        for _, b in self.live():
            count[b] = count.get(b, 0) + 1
        folded = {b for b, n in count.items() if n >= generations}
        if folded:
            self._replace(folded, lambda rows: self._dealt(upsert_latest(rows.drop("generation", "bucket"), list(self.row_key), self.version)))
        return sorted(folded)

    def erase(self, keys: DataFrame) -> list[int]:
        """All versions of the rows of these keys go; the buckets that were rewritten (those that held one)."""
        gone = self._dealt(keys.select(self.key).distinct())
        near = {r.bucket for r in gone.select("bucket").distinct().collect()}  # at most the number of buckets
        rows = self._rows([p for p in self.live() if p[1] in near])
        hit = {r.bucket for r in rows.join(gone.select(self.key), self.key, "left_semi").select("bucket").distinct().collect()}
        if hit:
            self._replace(hit, lambda rows: rows.drop("generation").join(gone.select(self.key), self.key, "left_anti"))
        return sorted(hit)

    def vacuum(self) -> int:
        """Delete the folders of (generation, bucket) pairs that are not live; their number.  No reader may be at an older version."""
        live = set(self.live())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/rows")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for status in files.globStatus(hadoop.Path(root, "generation=*/bucket=*")) or []:
            folder = status.getPath()
            pair = (int(folder.getParent().getName().split("=")[1]), int(folder.getName().split("=")[1]))
            if pair not in live:
                files.delete(folder, True)
                gone += 1
        return gone
