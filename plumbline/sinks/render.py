"""Report formats as string columns: a row is a line or an element, so large reports are written in parallel.

``document`` joins the rows of an already limited frame into one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrows of the edge types, and what stands for marks that a label can't hold.
ARROWS = {"Calls": "-->", "Imports": "-.->", "Inherits": "-->|inherits|", "Implements": "-->|implements|", "Uses": "---"}
LABEL = (("&", " and "), ('"', "'"), ("<", "("), (">", ")"), ("|", " - "), ("[", "("), ("]", ")"), ("{", "("), ("}", ")"), ("\n", " "))


def csv_line(*columns: Column) -> Column:
    """Values in quotes where they hold a comma, a quote or a line end; null is empty."""
    def cell(c: Column) -> Column:
        t = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(t.rlike(r'[",\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)

    return F.concat_ws(",", *[cell(c) for c in columns])


def markdown_row(*columns: Column) -> Column:
    cells = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def gcc_line(path: Column, line: Column, column: Column, severity: Column, message: Column) -> Column:
    return F.concat(path.cast("string"), F.lit(":"), line, F.lit(":"), column, F.lit(": "), severity, F.lit(": "), message)


def xml_text(c: Column) -> Column:
    t = c.cast("string")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(mark), F.lit(name))
    return t


def junit_case(name: Column, file: Column, message: Column) -> Column:
    """A test case; one that failed where there is a message."""
    head = F.concat(F.lit('<testcase name="'), xml_text(name), F.lit('" classname="'), xml_text(file), F.lit('"'))
    return F.when(message.isNull(), F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit('><failure message="'), xml_text(message), F.lit('"/></testcase>')))


def graphml_edge(source: Column, target: Column) -> Column:
    return F.concat(F.lit('<edge source="'), xml_text(source), F.lit('" target="'), xml_text(target), F.lit('"/>'))


def lcov_record(lines: DataFrame) -> DataFrame:
    """lines(path, line, hits) -> (path, record): one record for each file."""
    each = F.array_sort(F.collect_list(F.struct("line", F.concat(F.lit("DA:"), "line", F.lit(","), "hits").alias("t"))))
    rows = lines.groupBy("path").agg(each.alias("da"), F.count(F.when(F.col("hits") > 0, 1)).alias("lh"), F.count("*").alias("lf"))
    parts = F.concat(F.array(F.concat(F.lit("SF:"), "path")), F.transform("da", lambda x: x["t"]), F.array(F.concat(F.lit("LF:"), "lf"), F.concat(F.lit("LH:"), "lh"), F.lit("end_of_record")))
    return rows.select("path", F.array_join(parts, "\n").alias("record"))


def sarif_result(rule: Column, severity: Column, message: Column, path: Column, line: Column) -> Column:
    """One result of a SARIF run, as JSON."""
    level = F.when(severity.isin("error", "critical", "high"), "error").when(severity.isin("warning", "medium"), "warning").otherwise("note")
    where = F.struct(F.struct(F.struct(path.cast("string").alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(rule.alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(where).alias("locations")))


def sarif(results: DataFrame, column: str, tool: str) -> DataFrame:
    """(text): the whole SARIF file of a limited frame of results."""
    head = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s"}},"results":[' % tool
    return results.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(column)), ","), F.lit("]}]}")).alias("text"))


def document(rows: DataFrame, line: str, order: list[str], head: str = "", tail: str = "") -> DataFrame:
    """(text) of an already limited frame: its lines in order, between head and tail."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line")))), lambda x: x["_line"])
    return rows.agg(F.concat(F.lit(head), F.array_join(sorted_, "\n"), F.lit(tail)).alias("text"))


def mermaid_id(name: Column) -> Column:
    return F.regexp_replace(name.cast("string"), r"[^A-Za-z0-9_]", "_")


def mermaid_label(label: Column) -> Column:
    for mark, other in LABEL:
        label = F.replace(label, F.lit(mark), F.lit(other))
    return label


def mermaid_node(name: Column, label: Column) -> Column:
    return F.concat(F.lit("    "), mermaid_id(name), F.lit("["), mermaid_label(label), F.lit("]"))


def mermaid_edge(source: Column, target: Column, kind: Column) -> Column:
    arrow = F.element_at(F.create_map(*[F.lit(x) for kv in ARROWS.items() for x in kv]), kind)
    return F.concat(F.lit("    "), mermaid_id(source), F.lit(" "), arrow, F.lit(" "), mermaid_id(target))


def manifest(artifacts: DataFrame) -> DataFrame:
    """artifacts(name, content) -> (name, sha256, bytes)."""
    return artifacts.select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))


def damaged(artifacts: DataFrame, listed: DataFrame) -> DataFrame:
    """(name, problem) of listed artifacts that are missing or differ, and of artifacts that aren't listed."""
    both = listed.join(manifest(artifacts).select("name", F.col("sha256").alias("now")), "name", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("name", problem.alias("problem")).filter("problem IS NOT NULL")
