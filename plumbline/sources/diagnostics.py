"""Compiler messages saved as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<file_name: string, is_primary: boolean, line_start: int, column_start: int, line_end: int, column_end: int, suggested_replacement: string, suggestion_applicability: string>"
MESSAGE = f"reason string, message struct<message: string, level: string, code: struct<code: string>, spans: array<{SPAN}>>"


def diagnostics(spark: SparkSession, path: str, *, ext: str = "rs", root: str = "server/") -> DataFrame:
    """One row for each message that has a span in a file of ``ext``: its primary span, else the first.

    ``root`` is taken off the front of paths. Lines that are no JSON, other
    reasons than compiler messages, and messages without spans give no row.
    """
    m = spark.read.schema(MESSAGE).json(path).filter("reason = 'compiler-message'").select("message.*")
    span = F.coalesce(F.get(F.filter("spans", lambda s: s["is_primary"]), F.lit(0)), F.get("spans", F.lit(0)))
    m = m.withColumn("span", span).withColumn("file", F.regexp_replace("span.file_name", f"^{root}", ""))
    level = F.when(F.col("level").isin("error", "warning"), F.col("level")).when(F.col("level").isin("help", "suggestion"), "suggestion").otherwise("note")
    return m.filter(F.col("file").endswith(f".{ext}")).select(
        "file", F.col("span.line_start").alias("line"), F.col("span.column_start").alias("column"), F.col("span.line_end").alias("end_line"), F.col("span.column_end").alias("end_column"),
        F.coalesce("code.code", F.lit("unknown")).alias("lint"), "message", level.alias("severity"), F.col("span.suggested_replacement").alias("suggestion"),
        F.coalesce(F.col("span.suggestion_applicability") == "MachineApplicable", F.lit(False)).alias("machine_applicable"),
    )
