"""Estimates over lines(path, line, text) of source, and rules on names, lints and templates, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds and patterns of symbols; what stands before the name, then the name.
SYMBOLS = (
    ("Function", r"^((?:pub\s+)?(?:async\s+)?fn\s+)(\w+)"),
    ("Class", r"^(class\s+)(\w+)"),
    ("Function", r"^((?:export\s+)?(?:async\s+)?function\s+)(\w+)"),
    ("Function", r"^(def\s+)(\w+)"),
    ("Constant", r"^(const\s+)(\w+)\s*="),
    ("Type", r"^((?:pub\s+)?struct\s+)(\w+)"),
    ("Enum", r"^((?:pub\s+)?enum\s+)(\w+)"),
    ("Interface", r"^(interface\s+)(\w+)"),
)
#: Kinds and patterns of identifiers, in the order of precedence.
IDENTIFIERS = (
    ("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
    ("function", r"^\s*def\s+(\w+)"),
    ("function", r"^\s*function\s+(\w+)"),
    ("function", r"^\s*(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\("),
    ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"),
    ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"),
    ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"),
    ("class", r"^\s*class\s+(\w+)"),
    ("interface", r"^\s*interface\s+(\w+)"),
    ("type", r"^\s*type\s+(\w+)"),
    ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)"),
    ("variable", r"^\s*(?:let|const|var)\s+(\w+)"),
    ("variable", r"^\s*(\w+)\s*=\s*"),
)
#: What a file of each extension depends on.
DEPENDENCIES = {
    "rs": (r"use\s+(\w+)", r"mod\s+(\w+)"),
    "js": (r"""import\s+.*from\s+['"]\./(\w+)""", r"""require\(['"]\./(\w+)"""),
    "ts": (r"""import\s+.*from\s+['"]\./(\w+)""", r"""require\(['"]\./(\w+)"""),
    "py": (r"from\s+(\w+)\s+import", r"import\s+(\w+)"),
}
#: Which kinds a filter by type takes.
KINDS = {"functions": ("Function", "Method"), "types": ("Type", "Interface", "Enum"), "variables": ("Variable", "Constant")}
#: Lints by name, with the confidence and the text of the step that mends them.
STEPS = (("unused", 0.95, "Remove unused code"), ("redundant", 0.90, "Remove redundant code"), ("needless", 0.85, "Simplify needless patterns"), ("too_many_arguments", 0.80, "Extract context objects"))


def _sum(*conditions: Column) -> Column:
    return sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))


def _starts(t: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | t.startswith(w)
    return out


def _has(t: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def branch_points(line: Column) -> Column:
    """The decision points of one line, for a file's cyclomatic estimate."""
    t = F.trim(line)
    return _sum(
        _starts(t, "if ", "else if", "elif", "when ") | t.contains(" if "),
        _starts(t, "for ", "while ", "loop ") | _has(t, ".iter()", ".forEach", "for("),
        t.contains("=>") & ~t.contains("//"),
        _starts(t, "catch", "except"),
    ) + F.regexp_count(t, F.lit("&&")) + F.regexp_count(t, F.lit(r"\|\|"))


def simple_points(line: Column) -> Column:
    """The decision points of one line, six predicates of one point each."""
    t = F.trim(line)
    return _sum(_starts(t, "if ", "else if"), _starts(t, "for ", "while "), _starts(t, "match ", "switch "), t.contains("=>") | t.startswith("case "), _has(t, "&&", "||"), _starts(t, "catch", "except"))


def file_cyclomatic(lines: DataFrame, most: int = 50) -> DataFrame:
    """(path, cyclomatic, simple): both estimates of every file; the first is ``most`` at most."""
    return lines.groupBy("path").agg(F.least(1 + F.sum(branch_points(F.col("text"))), F.lit(most)).alias("cyclomatic"), (1 + F.sum(simple_points(F.col("text")))).alias("simple"))


def nesting(lines: DataFrame) -> DataFrame:
    """Adds ``nesting``: the depth after each line; a trailing { opens, a leading } closes, never below 0.

    The saturating sum is the running sum less its running minimum below 0.
    """
    t = F.trim("text")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_s", F.sum(F.when(t.endswith("{"), 1).when(t.startswith("}"), -1).otherwise(0)).over(w))
    return rows.withColumn("nesting", (F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).cast("int")).drop("_s")


def file_cognitive(lines: DataFrame, most: int = 60) -> DataFrame:
    """(path, cognitive): branches weighed by nesting, inner functions and deep returns, ``most`` at most."""
    t, n = F.trim("text"), F.col("nesting")
    points = (
        F.when(t.startswith("if ") | t.contains(" if "), 1 + n).otherwise(0)
        + F.when(_starts(t, "for ", "while "), 1 + n).otherwise(0)
        + F.when(_has(t, "fn ", "function", "=>"), n).otherwise(0)
        + F.when(t.contains("return") & (n > 1), 1).otherwise(0)
    )
    return nesting(lines).groupBy("path").agg(F.least(F.sum(points), F.lit(most)).cast("int").alias("cognitive"))


def churn_proxy(lines: DataFrame) -> DataFrame:
    """(path, churn): half for a low share of comments, half for debt marks."""
    t = F.trim("text")
    marks = F.sum(F.regexp_count("text", F.lit("TODO|FIXME")))
    share = F.sum(_sum(_starts(t, "//", "/*", "#"))) / F.greatest(F.count("*"), F.lit(1))
    return lines.groupBy("path").agg(F.round((1 - share) * 0.5 + F.least(marks * 0.1, F.lit(1.0)) * 0.5, 6).alias("churn"))


def function_windows(lines: DataFrame, ahead: int = 20, most: int = 255) -> DataFrame:
    """(path, line, name, cyclomatic, cognitive, line_end) of every line that defines a function, from it and the lines after it."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(0, ahead - 1)
    rows = lines.withColumn("_w", F.collect_list("text").over(w)).withColumn("name", F.regexp_extract("text", r"(?:fn|def|function)\s+(\w+)", 1)).filter(F.col("name") != "")

    def step(a, x):
        t = F.trim(x)
        branch, other = _has(x, "if ", "while ", "for ", "match "), x.contains("else")
        depth = F.when(t.endswith("{"), a["depth"] + 1).when(t.startswith("}"), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), (a["cyc"] + _sum(branch, other)).alias("cyc"), (a["cog"] + F.when(branch, 1 + a["depth"]).otherwise(0) + _sum(other)).alias("cog"))

    got = F.aggregate("_w", F.struct(F.lit(0).alias("depth"), F.lit(1).alias("cyc"), F.lit(0).alias("cog")), step)
    return rows.withColumn("_g", got).select("path", "line", "name", F.least("_g.cyc", F.lit(most)).alias("cyclomatic"), F.least("_g.cog", F.lit(most)).alias("cognitive"), (F.col("line") + 9).alias("line_end"))


def next_function(lines: DataFrame, mark: str = "#[no_mangle]", ahead: int = 3) -> DataFrame:
    """(path, line, exported): the function that a mark's line exports, within the next ``ahead`` lines."""
    w = Window.partitionBy("path").orderBy("line")
    names = [F.regexp_extract(F.lead("text", k).over(w), r"fn\s+(\w+)", 1) for k in range(1, ahead + 1)]
    found = lines.withColumn("exported", F.coalesce(*[F.when(n != "", n) for n in names]))
    return found.filter(F.trim("text").startswith(mark) & F.col("exported").isNotNull()).select("path", "line", "exported")


def symbols(lines: DataFrame) -> DataFrame:
    """(path, line, kind, name, column, visibility) of every pattern's match; columns are bytes from 0."""
    from plumbline.functions.text import visibility

    rows = [F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 2).alias("name"), F.octet_length(F.regexp_extract("text", p, 1)).alias("column")) for k, p in SYMBOLS]
    found = lines.select("path", "line", visibility(F.col("text")).alias("visibility"), F.inline(F.array(*rows))).filter(F.col("name") != "")
    return found.select("path", "line", "kind", "name", "column", "visibility")


def of_kind(found: DataFrame, kind: str | None = None, query: str | None = None) -> DataFrame:
    """Symbols of a group of kinds whose name holds a text."""
    if kind:
        found = found.filter(F.col("kind").isin(*KINDS[kind]))
    return found.filter(F.col("name").contains(query)) if query else found


def references(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(name, references): how often the words of all lines name each symbol, its definitions included."""
    words = lines.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("references"))
    return found.select("name").distinct().join(words, "name", "left").na.fill(0, ["references"])


def identifiers(lines: DataFrame) -> DataFrame:
    """(path, name, kind, line): each name once a file, where its first pattern first finds it."""
    rows = [F.struct(F.lit(k).alias("place"), F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name")) for k, (kind, p) in enumerate(IDENTIFIERS)]
    found = lines.select("path", "line", F.inline(F.array(*rows))).filter(F.col("name") != "")
    return found.groupBy("path", "name").agg(F.min_by(F.struct("kind", "line"), F.struct("place", "line")).alias("x")).select("path", "name", "x.kind", "x.line")


def dependencies(lines: DataFrame, ext: str) -> DataFrame:
    """(path, name): names of files that the lines of files with an extension depend on."""
    every = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in DEPENDENCIES[ext]])
    return lines.select("path", F.explode(every).alias("n")).select("path", F.concat("n", F.lit("." + ext)).alias("name"))


def metric_severity(metrics: Column) -> Column:
    """The severity of the largest metric that is about complexity."""
    m = F.array_max(F.map_values(F.map_filter(metrics, lambda k, _: _has(k, "complexity", "cyclomatic", "cognitive"))))
    return F.when(m > 50, "critical").when(m > 20, "high").when(m > 10, "medium").otherwise("low")


def refactor_step(lint: Column, found: Column) -> Column:
    """struct(id, confidence, impact, description) of the step that mends a lint."""
    confidence, text = F.lit(0.70), F.lit("Apply clippy suggestion")
    for name, sure, what in reversed(STEPS):
        confidence, text = F.when(lint.contains(name), sure).otherwise(confidence), F.when(lint.contains(name), what).otherwise(text)
    return F.struct(F.concat(F.lit("fix-"), lint).alias("id"), confidence.alias("confidence"), found.alias("impact"), text.alias("description"))


def relevance(name: Column, description: Column, parameters: Column, query: str) -> Column:
    """A template's points for a query: name, description and parameters."""
    q, has = query.lower(), lambda c: F.lower(c).contains(query.lower())
    return F.when(F.lower(name) == q, 10).when(has(name), 5).otherwise(0) + F.when(has(description), 3).otherwise(0) + F.size(F.filter(parameters, has))


def node_complexity(kind: Column, fields: Column) -> Column:
    """A node's complexity where no function's is known."""
    return F.when(kind == "Function", 2).when(kind == "Struct", fields + 1).otherwise(1)


def toolchain_file(path: Column, toolchain: str) -> Column:
    """Whether a file belongs to a toolchain."""
    ends = {"rust": ("rs",), "deno": ("ts", "tsx", "js", "jsx"), "python-uv": ("py",)}[toolchain]
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*ends)


def glob(path: Column, pattern: str) -> Column:
    """Glob match of a whole path: ** any folders, * within one, ? one character."""
    import re

    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return path.rlike(f"^{out}$")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|specs?|__tests__)(/|$)|[._-](test|spec)\.|(^|/)test_")


def is_vendor_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(vendor|node_modules|third_party)/|\.min\.(js|css)$|\.bundle\.js$")
