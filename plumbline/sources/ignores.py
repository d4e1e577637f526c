"""Ignore files as a table of rules, and the files that they leave.

A rule is a line of an ignore file, compiled to a regular expression for paths
below that file's folder. For a file or folder the last rule that matches wins,
those of deeper ignore files over those above; a file in an ignored folder is
ignored whatever the rules say of it. Each path meets the rules of its own
ancestors only, a folder's rules being one array.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import lines_of

NAMES = (".gitignore", ".ignore")


def compiled(line: str) -> dict | None:
    """A rule's regular expression, whether it takes back, and whether it is for folders only; None for blanks and comments."""
    line = line.rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folder = line.endswith("/") and not line.endswith("\\/")
    line = line[: len(line) - folder]
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    out, k = [], 0
    while k < len(line):
        c = line[k]
        if line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if line[k:] == "**" and (k == 0 or line[k - 1] == "/"):
            out.append(".+")
            break
        if c == "*":
            while line.startswith("*", k + 1):
                k += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = line.find("]", k + 2 if line[k + 1 : k + 2] not in ("!", "^") else k + 3)
            if end < 0:
                return None  # an open class matches nothing
            inner = line[k + 1 : end]
            no = inner[:1] in ("!", "^")
            inner = inner[no:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("]", "\\]")
            out.append(f"(?!/)[{'^' if no else ''}{inner}]")
            k = end
        else:
            if c == "\\" and k + 1 < len(line):
                k += 1
                c = line[k]
            out.append(c if c.isalnum() or c in "_/" else "\\" + c)
        k += 1
    return {"regex": ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$", "negated": negated, "folder": folder}


def _folder(path: Column) -> Column:
    """The path's folder with its slash at the end; empty at the top."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def rules(files: DataFrame, *, path: str = "path", content: str = "content", names: tuple[str, ...] = NAMES) -> DataFrame:
    """(base, rules): for each folder with ignore files their rules, the last one first; later names come after earlier ones."""
    def run(lines: pd.Series) -> pd.DataFrame:
        found = [compiled(x) or {"regex": None, "negated": False, "folder": False} for x in lines]
        return pd.DataFrame(found, columns=["regex", "negated", "folder"])

    compile_ = F.pandas_udf(run, "regex string, negated boolean, folder boolean")
    name = F.element_at(F.split(path, "/"), -1)
    rows = files.filter(name.isin(*names)).select(_folder(F.col(path)).alias("base"), F.array_position(F.array(*[F.lit(n) for n in names]), name).alias("file"), F.posexplode(lines_of(F.col(content))).alias("line", "text"))
    rows = rows.withColumn("r", compile_(F.col("text"))).filter("r.regex is not null")
    return rows.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("file", "line", "r.regex", "r.negated", "r.folder")), asc=False).alias("rules"))


def ignored(files: DataFrame, rules_: DataFrame, *, path: str = "path") -> DataFrame:
    """(path) of the files that the rules ignore, themselves or by one of their folders."""
    parts = F.split(F.col(path), "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("entry"), (n < F.size(parts)).alias("is_folder")))
    held = files.select(F.col(path).alias("path")).distinct().select("path", F.inline(upto.alias("x")))
    entries = held.select("entry", "is_folder").distinct()
    above = F.split("entry", "/")
    bases = entries.select("entry", "is_folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(above)), lambda n: F.when(n == 1, F.lit("")).otherwise(F.concat(F.array_join(F.slice(above, 1, n - 1), "/"), F.lit("/"))))).alias("base"))
    met = bases.join(rules_, "base").withColumn("rel", F.expr("substring(entry, length(base) + 1)"))
    first = F.get(F.filter("rules", lambda r: (~r["folder"] | F.col("is_folder")) & F.call_function("rlike", F.col("rel"), r["regex"])), F.lit(0))
    said = met.withColumn("first", first).filter("first is not null").groupBy("entry", "is_folder").agg(F.max_by("first.negated", F.length("base")).alias("negated"))
    out = said.filter("not negated").select("entry", "is_folder")
    return held.join(out, ["entry", "is_folder"], "left_semi").select("path").distinct()


def discovered(files: DataFrame, *, path: str = "path", content: str = "content", names: tuple[str, ...] = NAMES, most_depth: int | None = 15) -> DataFrame:
    """The rows of ``files`` that no ignore file among them takes out, at most ``most_depth`` folders deep; their order is up to the reader."""
    gone = ignored(files, rules(files, path=path, content=content, names=names), path=path)
    kept = files.join(gone.withColumnRenamed("path", path), path, "left_anti")
    return kept.filter(F.size(F.split(path, "/")) <= most_depth) if most_depth else kept
