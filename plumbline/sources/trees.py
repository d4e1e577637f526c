"""Source trees, commit logs and build files as DataFrames.

Files are read by Spark from any file system it knows; the parsers are small
functions applied in Arrow batches.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import lines_of

#: Languages by extension.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "kt": "kotlin", "go": "go", "java": "java", "rb": "ruby", "wasm": "wasm", "wat": "wat", "sh": "shell", "md": "markdown", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml"}
SKIPPED = r"(^|/)(target|node_modules|dist|build|vendor|__pycache__|\.git|\.venv)(/|$)"
EXTERNAL = r"https?___|___github_com_|___gitlab_com_"


def category(path: Column) -> Column:
    """Generated output, test artifact, essential doc, build configuration, development doc or source; the first that fits."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return (
        F.when(name.rlike("deep[_-]context") & (ext == "md") | name.contains("kaizen") & (ext == "json"), "GeneratedOutput")
        .when(name.startswith("test_") & (ext == "md"), "TestArtifact")
        .when(F.lower(name) == "readme.md", "EssentialDoc")
        .when(F.lower(name).isin("makefile", "gnumakefile", "bsdmakefile") | name.isin("Cargo.toml", "pyproject.toml"), "BuildConfig")
        .when(ext == "md", "DevelopmentDoc")
        .when(ext.isin(*[e for e in LANGUAGES if e not in ("md", "toml", "json", "yaml", "yml")]), "SourceCode")
        .otherwise("DevelopmentDoc")
    )


def files(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, content, bytes, ext, language, category) below ``root`` without build folders and external clones.

    ``include`` and ``exclude`` are substrings of the path. Large files stay:
    ``skip_reason`` reports them. The path filters
    apply before a file's bytes are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = raw.filter(~F.col("path").rlike(SKIPPED) & ~F.col("path").rlike(EXTERNAL))
    if include:
        kept = kept.filter(F.col("path").contains(include))
    if exclude:
        kept = kept.filter(~F.col("path").contains(exclude))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit("other"))
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("bytes"), ext.alias("ext"), language.alias("language"), category(F.col("path")).alias("category"))


def lines(found: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, text), lines counted from 1."""
    return found.select(F.col(path).alias("path"), F.posexplode(lines_of(F.col(content))).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text")


def byte_entropy(text: Column, first: int = 1024) -> Column:
    """Shannon entropy in bits of the first bytes, by counts over their hexadecimal digits' pairs.

    Pairs are sorted and written in a row, where a pattern takes each run of
    equal ones: so a text costs a step for each different byte, not for each.
    """
    pairs = F.regexp_extract_all(F.hex(F.substring(F.encode(text, "UTF-8"), 1, first)), F.lit(".."), F.lit(0))
    n = F.size(pairs)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(pairs), ""), F.lit(r"(..)\1*"), F.lit(0))
    of = lambda r: F.length(r) / 2 * F.log2(F.length(r) / 2)
    return F.when(n == 0, 0.0).otherwise(F.log2(n.cast("double")) - F.aggregate(runs, F.lit(0.0), lambda a, r: a + of(r)) / n)


def skip_reason(path: Column, content: Column, entropy: Column) -> Column:
    """Why a file isn't parsed; null if it is."""
    n = F.octet_length(content)
    longest = F.array_max(F.transform(F.split(content, "\n"), lambda x: F.octet_length(x)))
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when(n > 1 << 20, "too_large")
        .when(n > 512_000, "large")
        .when(path.rlike(r"(^|/)(target|build|dist)/"), "build_artifact")
        .when(path.rlike(r"(^|/)(vendor|node_modules|third_party)/"), "vendor")
        .when(content.contains("\0"), "binary")
        .when(longest > 10_000, "long_line")
        .when((entropy > 6.0) | (breaks / n < 0.001), "minified")
    )


def commits(log: DataFrame) -> DataFrame:
    """log(source, line, text) of ``git log --pretty=%H|%an|%aI --numstat`` -> (hash, author, ts, path, additions, deletions).

    A commit's line has exactly three parts; counts given as ``-`` are binary
    files and dropped. Times are instants, not text.
    """
    from pyspark.sql.window import Window

    parts = F.split("text", r"\|")
    head = F.when(F.size(parts) == 3, F.struct(parts[0].alias("hash"), parts[1].alias("author"), F.to_timestamp(parts[2]).alias("ts")))
    w = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("commit", F.last(head, ignorenulls=True).over(w)).filter(F.col("text").rlike(r"^\d+\t\d+\t"))
    cells = F.split("text", "\t", 3)
    return rows.select("commit.hash", "commit.author", "commit.ts", cells[2].alias("path"), cells[0].cast("long").alias("additions"), cells[1].cast("long").alias("deletions"))


def _brace_functions(path: str, content: str) -> list[tuple]:
    """Functions of brace languages: complexity from keywords, nesting from braces, the end where the braces close."""
    out, rows = [], content.split("\n")
    start = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+|export\s+|static\s+|async\s+|default\s+)*(?:fn|function|func)\s+([A-Za-z_]\w*)")
    for k, row in enumerate(rows):
        m = start.match(row)
        if not m:
            continue
        depth, most, cyclomatic, cognitive, opened = 0, 0, 1, 0, False
        end = k
        for end in range(k, len(rows)):
            code = re.sub(r"//.*$", "", rows[end])
            hits = len(re.findall(r"\b(?:if|while|for|match|case|catch|loop)\b|&&|\|\|", code)) if end > k or "{" in code else 0
            cyclomatic += hits
            cognitive += hits * max(depth, 1)
            opened = opened or "{" in code
            depth = max(0, depth + code.count("{") - code.count("}"))
            most = max(most, depth)
            if opened and depth == 0:
                break
        out.append((path, m[1], k + 1, end + 1, cyclomatic, cognitive, most))
    return out


def _python_functions(path: str, content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    branch = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.IfExp, ast.Lambda, ast.BoolOp, ast.Match, ast.match_case)

    def deepest(node: ast.AST, depth: int) -> tuple[int, int, int]:
        count, weighted, most = 0, 0, depth
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            hit = isinstance(child, branch)
            c, w, m = deepest(child, depth + hit)
            count, weighted, most = count + hit + c, weighted + hit * (1 + depth) + w, max(most, m)
        return count, weighted, most

    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            count, weighted, most = deepest(node, 0)
            out.append((path, node.name, node.lineno, node.end_lineno, 1 + count, weighted, most))
    return out


FUNCTIONS = "path string, name string, line_start int, line_end int, cyclomatic int, cognitive int, nesting_max int"


def functions(found: DataFrame) -> DataFrame:
    """files -> one row for each function with its span and complexity; a file that doesn't parse has none."""

    def run(batches):
        for batch in batches:
            rows = [r for p, c, lang in zip(batch["path"], batch["content"], batch["language"]) for r in (_python_functions(p, c) if lang == "python" else _brace_functions(p, c))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FUNCTIONS.split(", ")])

    return found.select("path", "content", "language").mapInPandas(run, FUNCTIONS)


def growth_classes(found: DataFrame) -> DataFrame:
    """(path, name, loop_depth, recursive, sorts, growth): the growth class of each function's body, by its loops.

    The body starts after the signature, so a name in its own header is no recursion.
    """
    schema = "path string, name string, loop_depth int, recursive boolean, sorts boolean, growth int"

    def run(batches):
        for batch in batches:
            out = []
            for p, c, lang in zip(batch["path"], batch["content"], batch["language"]):
                rows = c.split("\n")
                for _, name, a, b, *_ in _python_functions(p, c) if lang == "python" else _brace_functions(p, c):
                    open_, most = [], 0
                    body = rows[a:b]
                    depth = 0
                    for row in body:
                        indent = len(row) - len(row.lstrip())
                        level = indent if lang == "python" else depth
                        while open_ and row.strip() and level <= open_[-1]:
                            open_.pop()
                        if re.match(r"\s*(for|while|loop)\b", row):
                            open_.append(level)
                            most = max(most, len(open_))
                        depth += row.count("{") - row.count("}")
                    text = "\n".join(body)
                    sorts, again = bool(re.search(r"\.sort|sorted\(|sort_by", text)), bool(re.search(rf"\b{re.escape(name)}\s*\(", text))
                    order = {0: 0, 1: 2, 2: 4, 3: 5}.get(most, 6)
                    order = max(order, 6 if again and most == 0 and len(re.findall(rf"\b{re.escape(name)}\s*\(", text)) > 1 else 2 if again else 0, 3 if sorts else 0)
                    out.append((p, name, most, again, sorts, order))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return found.select("path", "content", "language").mapInPandas(run, schema)


def makefile_rules(found: DataFrame) -> DataFrame:
    """Makefiles -> (path, line, targets, prerequisites, is_pattern, is_double_colon, recipe_lines)."""
    schema = "path string, line int, targets array<string>, prerequisites array<string>, is_pattern boolean, is_double_colon boolean, recipe_lines int"
    head = re.compile(r"^([^\s#=:][^=:]*?)\s*(::?)(?!=)\s*([^=]*)$")

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                current = None
                for k, row in enumerate(content.replace("\\\n", " ").split("\n"), 1):
                    if row.startswith("\t"):
                        if current is not None and row.strip():
                            out[current][-1] += 1
                        continue
                    m = head.match(row)
                    if m:
                        current = len(out)
                        out.append([path, k, m[1].split(), m[3].split("#")[0].split(), "%" in m[1], m[2] == "::", 0])
                    elif row.strip() and not row.lstrip().startswith("#"):
                        current = None
            yield pd.DataFrame(out, columns=["path", "line", "targets", "prerequisites", "is_pattern", "is_double_colon", "recipe_lines"])

    return found.select("path", "content").mapInPandas(run, schema)


def makefile_violations(rules: DataFrame, longest: int = 10) -> DataFrame:
    """(path, rule, severity, target): required phony targets that lack, targets that should be phony, long bodies."""
    phony = rules.filter(F.array_contains("targets", ".PHONY")).select("path", F.explode("prerequisites").alias("target")).distinct()
    targets = rules.select("path", F.explode("targets").alias("target"), "recipe_lines", "prerequisites").filter(~F.col("target").startswith("."))
    needed = rules.select("path").distinct().crossJoin(F.broadcast(rules.sparkSession.createDataFrame([("all",), ("clean",), ("test",)], "target string")))  # three rows are broadcast
    row = lambda df, rule, severity: df.select("path", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "target")
    return (
        row(needed.join(phony, ["path", "target"], "left_anti"), "minphony", "warning")
        .unionByName(row(targets.filter(F.col("target").isin("all", "clean", "test", "install", "check", "lint", "format")).join(phony, ["path", "target"], "left_anti"), "phonydeclared", "warning"))
        .unionByName(row(targets.filter(F.col("recipe_lines") > longest), "maxbodylength", "warning"))
    )


def wasm_sections(raw: DataFrame) -> DataFrame:
    """(path, valid, sections, code_bytes) of binary modules: magic number, then sections by their LEB128 sizes."""

    def run(batches):
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"]):
                at, found, code, ok = 8, 0, 0, data[:4] == b"\0asm"
                while ok and at < len(data):
                    kind, at, shift, length = data[at], at + 1, 0, 0
                    while ok and at < len(data):
                        b = data[at]
                        at, length, shift = at + 1, length | (b & 127) << shift, shift + 7
                        if b < 128:
                            break
                        ok = shift <= 35
                    found, code, at = found + 1, code + (length if kind == 10 else 0), at + length
                    ok = ok and at <= len(data)
                out.append((path, ok, found, code))
            yield pd.DataFrame(out, columns=["path", "valid", "sections", "code_bytes"])

    return raw.select("path", "content").mapInPandas(run, "path string, valid boolean, sections int, code_bytes long")
