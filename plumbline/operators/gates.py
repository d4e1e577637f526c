"""Checks of a quality gate, defects made of the analyses' results, and the age of debt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what the security check looks for, and the sections that a README needs
SECURITY = (
    (r"""(?i)password\s*=\s*["'][^"']+["']""", "Hardcoded password detected"),
    (r"""(?i)api_key\s*=\s*["'][^"']+["']""", "Hardcoded API key detected"),
    (r"""(?i)secret\s*=\s*["'][^"']+["']""", "Hardcoded secret detected"),
)
REQUIRED = ("Installation", "Usage", "Contributing", "License")


def _rows(df: DataFrame, check: str, severity: str, path: Column, message: Column, value: Column, bound: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), path.cast("string").alias("path"), message.alias("message"), value.cast("double").alias("value"), bound.cast("double").alias("bound"))


def security(lines: DataFrame) -> DataFrame:
    """A violation for each pattern in a line of lines(path, text)."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), m) for p, m in SECURITY]))
    return _rows(lines.select("path", F.explode(found).alias("message")), "security", "error", F.col("path"), F.col("message"), F.lit(None), F.lit(None))


def sections(readmes: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A violation for each required heading that a text of readmes(path, text) lacks."""
    lacking = F.array_compact(F.array(*[F.when(~F.col("text").contains(f"# {s}"), s) for s in required]))
    found = readmes.select("path", F.explode(lacking).alias("section"))
    return _rows(found, "sections", "warning", F.col("path"), F.concat(F.lit("Missing required section: "), "section"), F.lit(None), F.lit(None))


def measured(check: str, severity: str, value: DataFrame, *, least: float | None = None, most: float | None = None) -> DataFrame:
    """A violation if the one ``value`` is under ``least`` or over ``most``; a null value is none."""
    v = F.col("value")
    out = v < least if least is not None else v > most
    return _rows(value.filter(out), check, severity, F.lit("project"), F.lit("below minimum" if least is not None else "above maximum"), F.round(v, 6), F.lit(least if least is not None else most))


def gradient_defect(severity: Column, value: Column, high: float = 0.5) -> Column:
    return F.when(severity == "Critical", "Critical").when(severity == "Warning", "High").when(value > high, "Medium").otherwise("Low")


def dead_defect(confidence: Column) -> Column:
    return F.when(confidence > 0.9, "High").when(confidence > 0.7, "Medium").otherwise("Low")


def clone_defect(kind: Column, lines: Column) -> Column:
    exact, renamed = kind == "Type1", kind == "Type2"
    return F.when(exact & (lines > 50), "High").when(exact | (renamed & (lines > 30)), "Medium").otherwise("Low")


def growth_defect(growth: Column) -> Column:
    return F.when(growth.isin("Exponential", "Factorial"), "Critical").when(growth == "Cubic", "High").when(growth == "Quadratic", "Medium").otherwise("Low")


def as_defects(df: DataFrame, category: str, rule: Column, severity: Column, path: Column) -> DataFrame:
    """(category, rule, severity, path) of one analysis' results; unions of these are the defects."""
    return df.select(F.lit(category).alias("category"), rule.alias("rule"), severity.alias("severity"), path.cast("string").alias("path"))


def debt_age(debts: DataFrame, blame: DataFrame) -> DataFrame:
    """debts(path, line) and blame(path, line, ts, now) -> mean age in whole days, and of how many debts. Lines without blame don't count."""
    days = F.floor((F.col("now").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400)
    return debts.select("path", "line").join(blame, ["path", "line"]).agg(F.round(F.avg(days), 6).alias("mean_days"), F.count("*").alias("debts"))


def outside_tests(lines: DataFrame, mark: str = "#[cfg(test)]") -> DataFrame:
    """The rows of lines(path, line, text) that are in no marked block, its last line being outside.

    A block's depth is the sum of its braces, never under zero; it ends at the
    first line whose end is a closing brace at depth zero. Every mark opens a
    block anew, so the blocks of a file are windows of their own.
    """
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    braces = lambda b: F.length(t) - F.length(F.replace(t, F.lit(b), F.lit("")))
    # a line is dealt with one number, null for a mark, else its braces doubled, odd if it ends by a closing one; its text only if asked for
    rows = lines.withColumn("_code", F.when(~t.startswith(mark), 2 * (braces("{") - braces("}")) + t.endswith("}").cast("int")))
    opens, w = F.col("_code").isNull(), Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("_block", F.count(F.when(opens, 1)).over(w)).withColumn("_all", F.coalesce(F.sum(F.shiftright("_code", 1)).over(w), F.lit(0)))
    # each block counts from far below the one before, so the least so far is the block's own and a file is sorted once
    rows = rows.withColumn("_sum", F.col("_all") - F.last(F.when(opens, F.col("_all")), True).over(w) - F.col("_block") * F.lit(1 << 40))
    ends = (F.col("_code") % 2 != 0) & (F.col("_sum") <= F.min("_sum").over(w))
    rows = rows.withColumn("_ends", F.when(ends, F.col("_block"))).withColumn("_ended", F.max("_ends").over(w))
    return rows.filter((F.col("_block") == 0) | (F.col("_ended") == F.col("_block"))).select(*lines.columns)
