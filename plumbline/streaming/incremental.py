"""Churn and coverage kept up to date batch by batch, in folders named by the batch.

A batch writes what it adds, derived from its own rows and from batches of
smaller numbers only, into the folder of its number, replacing it. So a batch
that is given again, as a stream does after a failure, changes nothing; reading
adds up all folders. Both stores are what ``foreachBatch`` calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scoring


class _Batches:
    schema = ""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str, schema: str, before: int | None = None) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.createDataFrame([], schema + ", batch long")
        found = self.spark.read.schema(schema + ", batch long").parquet(f"{self.path}/{kind}")
        return found if before is None else found.filter(F.col("batch") < before)

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")


class ChurnStore(_Batches):
    """Commits' rows (path, hash, author, ts, additions, deletions) as sums for each path and author, each row of (path, hash, n-th) once."""

    KEYS = "path string, hash string, rows long"
    SUMS = "path string, author string, commits long, additions long, deletions long, first_seen timestamp, last_modified timestamp"

    def add(self, commits: DataFrame, batch: int) -> None:
        """A commit's rows for a path that an earlier batch has had are dropped."""
        new = commits.select(F.col("path").cast("string"), F.col("hash").cast("string"), F.col("author").cast("string"), "ts", "additions", "deletions")
        known = self._read("keys", self.KEYS, batch).select("path", "hash")
        new = new.join(known, ["path", "hash"], "left_anti").cache()
        try:
            self._write(new.groupBy("path", "hash").agg(F.count("*").alias("rows")), "keys", batch)
            sums = new.groupBy("path", "author").agg(F.count("*").alias("commits"), F.sum("additions").cast("long").alias("additions"), F.sum("deletions").cast("long").alias("deletions"), F.min("ts").cast("timestamp").alias("first_seen"), F.max("ts").cast("timestamp").alias("last_modified"))
            self._write(sums, "sums", batch)
        finally:
            new.unpersist()

    def churn(self) -> DataFrame:
        """What ``facts.churn`` gives on all commits so far."""
        per = self._read("sums", self.SUMS)
        files = per.groupBy("path").agg(F.sum("commits").alias("commit_count"), F.count_distinct("author").alias("unique_authors"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.min("first_seen").alias("first_seen"), F.max("last_modified").alias("last_modified"))
        changes = F.col("additions") + F.col("deletions")
        most = files.agg(F.max("commit_count").alias("most_commits"), F.max(changes).alias("most_changes"))
        score = scoring.churn_score(F.col("commit_count"), changes, F.col("most_commits"), F.col("most_changes"))
        return files.crossJoin(F.broadcast(most)).withColumn("churn_score", F.round(score, 6)).drop("most_commits", "most_changes")  # one row is broadcast

    def changed(self, batch: int) -> DataFrame:
        """(path) of the files that a batch has changed."""
        return self._read("sums", self.SUMS).filter(F.col("batch") == batch).select("path").distinct()


class CoverageStore(_Batches):
    """Files' covered and total lines by content hash: a batch keeps only files whose hash is another than before."""

    ROWS = "path string, hash string, covered long, total long"

    def _latest(self, before: int | None = None) -> DataFrame:
        rows = self._read("files", self.ROWS, before)
        return rows.groupBy("path").agg(F.max_by(F.struct("hash", "covered", "total"), "batch").alias("x")).select("path", "x.hash", "x.covered", "x.total")

    def add(self, files: DataFrame, batch: int) -> None:
        """files(path, hash, covered, total); of a path's rows in one batch the one with the largest hash counts."""
        new = files.groupBy(F.col("path").cast("string").alias("path")).agg(F.max(F.struct(F.col("hash").cast("string").alias("hash"), F.col("covered").cast("long").alias("covered"), F.col("total").cast("long").alias("total"))).alias("x")).select("path", "x.*")
        old = self._latest(batch).select("path", F.col("hash").alias("old"))
        self._write(new.join(old, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("old"))).drop("old"), "files", batch)

    def coverage(self, upto: int | None = None) -> DataFrame:
        """One row: files, covered, total, and their share in per cent, after a batch or after all."""
        rows = self._latest(None if upto is None else upto + 1)
        share = F.round(F.when(F.sum("total") > 0, 100 * F.sum("covered") / F.sum("total")).otherwise(0.0), 6)
        return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), share.alias("percent"))

    def delta(self, batch: int) -> DataFrame:
        """One row: the files that a batch has changed, and how many points the share has moved since the batch before."""
        now, then = self.coverage(batch), self.coverage(batch - 1).select(F.col("percent").alias("before"))
        changed = self._read("files", self.ROWS).filter(F.col("batch") == batch).agg(F.count("*").alias("changed"))
        return now.crossJoin(then).crossJoin(changed).select("changed", F.round(F.col("percent") - F.col("before"), 6).alias("moved"))  # one row each


def keep(stream: DataFrame, store: ChurnStore | CoverageStore, checkpoint: str, *, available_now: bool = True):
    """Starts the stream into the store; ``available_now`` ends when all that is there is in."""
    query = stream.writeStream.foreachBatch(lambda df, batch: store.add(df, batch)).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
