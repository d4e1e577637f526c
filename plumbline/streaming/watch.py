"""Streams of function metrics: emit what needs work, keep the last few, skip what was seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

METRICS = "path string, name string, cyclomatic int, cognitive int, tdg double, ts timestamp"


def metrics_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New JSON files of function metrics as they arrive."""
    return spark.readStream.schema(METRICS).option("maxFilesPerTrigger", per_trigger).json(folder)


def needs_work(metrics: DataFrame, cyclomatic: int = 15, cognitive: int = 20, tdg: float = 2.0) -> DataFrame:
    """Functions over any of the limits."""
    return metrics.filter((F.col("cyclomatic") > cyclomatic) | (F.col("cognitive") > cognitive) | (F.col("tdg") > tdg))


def windowed_counts(metrics: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Emitted functions in each window of event time; rows later than ``late`` are dropped."""
    return metrics.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("functions"), F.max("cyclomatic").alias("max_cyclomatic"))


def last_few(metrics: DataFrame, capacity: int = 16) -> DataFrame:
    """(path, names): after each batch the last ``capacity`` names of every path, the oldest dropped first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = list(state.get[0]) if state.exists else []
        for batch in batches:
            names += list(batch.sort_values(["ts", "name"])["name"])
        state.update((names[-capacity:],))
        yield pd.DataFrame({"path": [key[0]], "names": [names[-capacity:]]})

    return metrics.groupBy("path").applyInPandasWithState(step, "path string, names array<string>", "names array<string>", "update", GroupStateTimeout.NoTimeout)


def unseen(files: DataFrame, seen: DataFrame) -> DataFrame:
    """files(path, content) whose (path, hash) isn't among ``seen``."""
    return files.withColumn("hash", F.sha2("content", 256)).join(seen.select("path", "hash"), ["path", "hash"], "left_anti")
