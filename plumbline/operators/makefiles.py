"""Makefile rules over lines(path, line, text): variables, their references, and what is slow, undefined or not portable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graphs
from plumbline.session import cut

# fixed values: assignments, references, functions that cost each time they are expanded, variables that always exist
ASSIGNMENT = r"^([A-Za-z_][A-Za-z0-9_.-]*)\s*(:=|\?=|\+=|!=|=)\s*(.*)$"
REFERENCE = r"\$[({]([A-Za-z_][A-Za-z0-9_.-]*)(?::[^)}]*)?[)}]"
COSTLY = ("$(shell", "$(wildcard", "$(foreach", "$(call", "$(eval")
BUILTIN = ("CC", "CXX", "CFLAGS", "LDFLAGS", "MAKE", "SHELL", "PWD")


def variables(lines: DataFrame) -> DataFrame:
    """(path, line, name, operator, value) of the assignments."""
    part = lambda k: F.regexp_extract("text", ASSIGNMENT, k)
    return lines.filter(F.col("text").rlike(ASSIGNMENT)).select("path", "line", part(1).alias("name"), part(2).alias("operator"), part(3).alias("value"))


def recipes(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("text").startswith("\t"))


def names_in(text: Column) -> Column:
    """The variables that a text refers to, with repeats. ``$$`` is no reference, function calls are none, nor are single lower-case letters."""
    found = F.regexp_extract_all(F.replace(text, F.lit("$$"), F.lit("")), F.lit(REFERENCE), F.lit(1))
    return F.filter(found, lambda n: ~n.rlike("^[a-z]$"))


def costly(assigned: DataFrame) -> DataFrame:
    """(path, name) of the deferred variables that call a costly function, themselves or through others.

    ``assigned`` may have what its values refer to as ``names``.
    """
    node = lambda name: F.struct("path", F.col(name).alias("name"))
    deferred = assigned.filter("operator = '='")
    calls = F.lit(False)
    for part in COSTLY:
        calls = calls | F.col("value").contains(part)
    names = F.col("names") if "names" in assigned.columns else names_in(F.col("value"))
    uses = deferred.select("path", "name", F.explode(F.array_distinct(names)).alias("used"))
    nodes = deferred.select(node("name").alias("id")).distinct()
    edges = uses.select(node("used").alias("from"), node("name").alias("to"))
    entries = deferred.filter(calls).select(node("name").alias("id")).distinct()
    return graphs.reachable(nodes, edges, entries).select("id.*")


def violations(lines: DataFrame) -> DataFrame:
    """(path, line, rule, severity, name) by four rules; phony targets and long bodies are found on parsed rules."""
    # each line is matched once; a recipe starts with a tab, so it is no assignment
    recipe, part = F.col("text").startswith("\t"), lambda k: F.regexp_extract("text", ASSIGNMENT, k)
    parsed = lines.filter(recipe | F.col("text").rlike(ASSIGNMENT)).select("path", "line", "text", F.when(~recipe, F.struct(part(1).alias("name"), part(2).alias("operator"), part(3).alias("value"))).alias("a"))
    read = cut(parsed.select("path", "line", "a.*", names_in(F.coalesce("a.value", "text")).alias("names")))
    assigned = read.filter(F.col("name").isNotNull())
    row = lambda df, rule, severity: df.select("path", "line", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "name")
    dated = assigned.filter((F.col("operator") == ":=") & (F.col("value").contains("$(shell date") | F.col("value").contains("$(date")))
    used = read.select("path", "line", F.explode("names").alias("name"))
    undefined = used.filter(~F.col("name").isin(*BUILTIN)).join(assigned.select("path", "name"), ["path", "name"], "left_anti")
    again = read.filter(F.col("name").isNull()).select("path", "line", F.explode("names").alias("name")).groupBy("path", "line", "name").agg(F.count("*").alias("n")).filter("n > 1")
    return (
        row(dated, "timestampexpanded", "info")
        .union(row(undefined, "undefinedvariable", "warning"))
        .union(row(assigned.filter(F.col("operator").isin("?=", "!=")), "portability", "info"))
        .union(row(again.join(costly(assigned), ["path", "name"]), "recursive-expansion", "performance"))
    )


def ordered(found: DataFrame, limit: int) -> DataFrame:
    """The first violations: errors, then warnings, then the rest, each by line, path and name."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.orderBy(rank, "line", "path", "name").limit(limit)
