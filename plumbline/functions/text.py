"""Text rules on lines of source, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Debt patterns in the order of precedence, with category and severity.
DEBT = (
    (r"(?i)\b(hack|kludge|smell)\b", "Design", "Medium"),
    (r"(?i)\b(fixme|broken|bug)\b", "Defect", "High"),
    (r"(?i)\btodo\b", "Requirement", "Low"),
    (r"(?i)\b(security|vuln|cve)\b", "Security", "Critical"),
    (r"(?i)\bperformance\s+(issue|problem)\b", "Performance", "Medium"),
    (r"(?i)\btest.*\b(disabled|skipped|failing)\b", "Test", "Medium"),
    (r"(?i)\btechnical\s+debt\b", "Design", "Medium"),
    (r"(?i)\bcode\s+smell\b", "Design", "Medium"),
    (r"(?i)\b(workaround|temp|temporary)\b", "Design", "Low"),
    (r"(?i)\b(optimize|slow)\b", "Performance", "Low"),
)
#: The strict patterns, marker and colon.
STRICT = (
    (r"(?i)\b(TODO|FIXME|XXX|BUG|HACK|KLUDGE|REFACTOR):", "Requirement", "Low"),
    (r"(?i)\b(FIXME|BUG):", "Defect", "High"),
    (r"(?i)\b(HACK|KLUDGE):", "Design", "Medium"),
    (r"(?i)\b(SECURITY|VULN|CVE):", "Security", "Critical"),
)
SEVERITIES = ("Low", "Medium", "High", "Critical")
#: Fixed value: a literal that is assigned to a secret name.
SECRET = r"""(?i)(password|api_key|secret)\s*=\s*["'][^"']+["']"""


def comment_text(line: Column) -> Column:
    """The text of a line that is a comment as a whole; null for any other line."""
    t = F.trim(line)
    return (
        F.when(t.startswith("//"), F.trim(F.substring(t, F.lit(3), F.length(t))))
        .when(t.startswith("#"), F.trim(F.substring(t, F.lit(2), F.length(t))))
        .when(t.startswith("/*") & t.endswith("*/") & (F.length(t) >= 4), F.trim(F.regexp_extract(t, r"(?s)^/\*(.*)\*/$", 1)))
        .when(t.startswith("<!--") & t.endswith("-->") & (F.length(t) >= 7), F.trim(F.regexp_extract(t, r"(?s)^<!--(.*)-->$", 1)))
    )


def comment_column(line: Column) -> Column:
    """1-based byte column of the first opener found, by the openers' order and not by place; 1 if there is none."""
    at = lambda mark: F.when(F.instr(line, mark) > 0, F.octet_length(F.substring_index(line, mark, 1)) + 1)
    return F.coalesce(at("//"), at("#"), at("/*"), at("<!--"), F.lit(1)).cast("int")


def debt_pattern(text: Column, patterns=DEBT) -> Column:
    """Index of the first pattern that matches; null for none.

    The text is bound to a lambda variable: inlined, the expression that makes
    it would be compiled once for each pattern.
    """

    def of(t: Column) -> Column:
        found = F.lit(None).cast("int")
        for k, (pattern, _, _) in reversed(list(enumerate(patterns))):
            found = F.when(t.rlike(pattern), k).otherwise(found)
        return found

    return F.get(F.transform(F.array(text), of), F.lit(0))


def _of_pattern(index: Column, patterns, part: int) -> Column:
    return F.get(F.array(*[F.lit(p[part]) for p in patterns]), index)


def debt(df: DataFrame, text: str, patterns=DEBT) -> DataFrame:
    """Adds category and severity of the debt in ``text``; keeps rows that have some."""
    found = df.withColumn("_k", debt_pattern(F.col(text), patterns)).filter(F.col("_k").isNotNull())
    return found.withColumn("category", _of_pattern(F.col("_k"), patterns, 1)).withColumn("severity", _of_pattern(F.col("_k"), patterns, 2)).drop("_k")


def adjusted_severity(severity: Column, context: Column, complexity: Column) -> Column:
    """Up one step in security or validation code or over complexity 20, down one in tests and mocks."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")
    move = F.when(context.isin("security", "validation") | (complexity > 20), 1).when(context.isin("test", "mock"), -1).otherwise(0)
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.greatest(F.lit(0), F.least(F.lit(3), at - 1 + move)))


def severity_weight(severity: Column) -> Column:
    """1 to 4 from Low to Critical."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def marker(line: Column, names: str = "TODO|FIXME|HACK|XXX") -> Column:
    """The marker of ``MARKER: text`` anywhere in the line, empty for none."""
    return F.regexp_extract(line, rf"({names}):\s*(.+)", 1)


def marker_severity(name: Column) -> Column:
    return F.when(name.isin("HACK", "XXX"), "high").when(name.isin("FIXME", "REFACTOR"), "medium").otherwise("low")


def imports_in(lines: Column) -> Column:
    """How many of an array of lines are imports."""
    return F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(use\s|import\s|from\s+\S+\s+import|#include)")))


def exports_in(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(pub (fn|struct|enum) |export )|module\.exports")))


def lines_of(text: Column) -> Column:
    """Lines without their ends; a line end at the end of the text opens no line."""
    cut = F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n")
    return F.when(text.endswith("\n"), F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def visibility(line: Column) -> Column:
    t = F.trim(line)
    return F.when(t.startswith("pub ") | t.startswith("export "), "Public").when(t.contains("private "), "Private").when(t.contains("protected "), "Protected").otherwise("Internal")


def node_id(path: Column) -> Column:
    """A path as a node id: no leading ./ , no extension, separators as underscores."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"^\./", ""), r"\.(rs|ts|js|py)$", ""), "/.-", "___")
