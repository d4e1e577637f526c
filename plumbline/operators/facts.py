"""Analytics over fact tables: commits, functions, debts, defects, diagnostics, coverage.

Every operator takes DataFrames with the column names given in its docstring
and returns a DataFrame. None collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import scoring


def churn(commits: DataFrame) -> DataFrame:
    """commits(path, hash, author, ts, additions, deletions) -> one row for each path with its project-wide churn score."""
    files = commits.groupBy("path").agg(F.count("*").alias("commit_count"), F.countDistinct("author").alias("unique_authors"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_modified"))
    most = files.agg(F.max("commit_count").alias("most_commits"), F.max(F.col("additions") + F.col("deletions")).alias("most_changes"))
    score = scoring.churn_score(F.col("commit_count"), F.col("additions") + F.col("deletions"), F.col("most_commits"), F.col("most_changes"))
    return files.crossJoin(F.broadcast(most)).withColumn("churn_score", F.round(score, 6)).drop("most_commits", "most_changes")  # one row is broadcast


def churn_summary(files: DataFrame) -> DataFrame:
    """Totals over a churn table; total_commits adds the files' counts."""
    return files.agg(F.sum("commit_count").alias("total_commits"), F.count("*").alias("total_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.round(F.avg("churn_score"), 6).alias("mean_score"), F.count(F.when(F.col("churn_score") > 0.5, 1)).alias("hotspots"), F.count(F.when(F.col("churn_score") < 0.1, 1)).alias("stable"))


def author_contributions(commits: DataFrame) -> DataFrame:
    """(author, files): how many files each author touched."""
    return commits.groupBy("author").agg(F.countDistinct("path").alias("files"))


def duplicate_line_share(lines: DataFrame) -> DataFrame:
    """lines(path, text) -> (path, n, duplicate, factor): repeats among trimmed lines over 10 bytes that are no comments.

    The factor is 0 for files of under ten such lines and 5 at most.
    """
    t = F.trim("text")
    used = lines.filter((t != "") & ~t.startswith("//") & ~t.startswith("#")).select("path", t.alias("t"))
    counts = used.groupBy("path", "t").agg(F.count("*").alias("c"))
    per = counts.groupBy("path").agg(F.sum("c").alias("n"), F.sum(F.when((F.octet_length("t") > 10) & (F.col("c") > 1), F.col("c") - 1).otherwise(0)).alias("duplicate"))
    factor = F.when(F.col("n") < 10, 0.0).otherwise(F.least(F.lit(5.0), F.col("duplicate") / F.col("n") * 100 / 30))
    return per.withColumn("factor", F.round(factor, 6))


def violations(functions: DataFrame, cyclomatic: tuple[int, int] = (10, 20), cognitive: tuple[int, int] = (15, 30)) -> DataFrame:
    """functions(path, name, cyclomatic, cognitive) -> (path, name, rule, severity, value, threshold); limits are strict."""

    def rule(column: str, limits: tuple[int, int]) -> Column:
        x, (warn, err) = F.col(column), limits
        found = lambda s, t: F.struct(F.lit(f"{column}-complexity").alias("rule"), F.lit(s).alias("severity"), x.alias("value"), F.lit(t).alias("threshold"))
        return F.when(x > err, found("error", err)).when(x > warn, found("warning", warn))

    both = F.filter(F.array(rule("cyclomatic", cyclomatic), rule("cognitive", cognitive)), lambda v: v.isNotNull())
    return functions.select("path", "name", F.inline(both))


def debt_hours(found: DataFrame) -> DataFrame:
    """Half an hour a point over an error limit, a quarter over a warning limit."""
    over = F.col("value") - F.col("threshold")
    return found.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.round(F.sum(F.when(F.col("severity") == "error", 30 * over).otherwise(15 * over)) / 60, 6).alias("debt_hours"))


def upper_tenth(functions: DataFrame, column: str) -> DataFrame:
    """One row (p90_column): the element at floor(0.9 n) of the sorted values, the last one at most, from the counts of each value."""
    counts = functions.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_value"))  # a row for each different complexity
    n = F.sum("_n").over(Window.partitionBy())
    placed = counts.select("_value", upto.alias("_upto"), F.least(F.floor(n * 0.9), n - 1).alias("_k"))
    return placed.agg(F.min(F.when(F.col("_upto") > F.col("_k"), F.col("_value"))).alias(f"p90_{column}"))


def complexity_report(functions: DataFrame) -> DataFrame:
    """One row: counts, medians, 90th percentiles, maxima and debt hours."""
    totals = functions.agg(F.count("*").alias("functions"), F.countDistinct("path").alias("files"), F.round(F.median("cyclomatic"), 6).alias("median_cyclomatic"), F.round(F.median("cognitive"), 6).alias("median_cognitive"), F.max("cyclomatic").alias("max_cyclomatic"), F.max("cognitive").alias("max_cognitive"))
    for one in (upper_tenth(functions, "cyclomatic"), upper_tenth(functions, "cognitive"), debt_hours(violations(functions))):
        totals = totals.crossJoin(F.broadcast(one))  # one row each
    return totals


def complexity_rank(functions: DataFrame) -> DataFrame:
    """(path, functions, max_cyclomatic, mean_cognitive, score) by the composite score."""
    per = functions.groupBy("path").agg(F.count("*").alias("functions"), F.max("cyclomatic").alias("max_cyclomatic"), F.avg("cognitive").alias("mean_cognitive"))
    return per.withColumn("score", F.round(scoring.composite_rank(F.col("max_cyclomatic"), F.col("mean_cognitive"), F.col("functions")), 6)).withColumn("mean_cognitive", F.round("mean_cognitive", 6))


def ranked(df: DataFrame, score: str, tie: str, limit: int, zero_is_all: bool = False) -> DataFrame:
    """The first ``limit`` rows by falling score, then the tie column, numbered from 1.

    Only the rows that stay are numbered. A limit of 0 is empty, or everything
    with ``zero_is_all``; then the numbering needs one order of all rows.
    """
    if limit > 0 or not zero_is_all:
        df = df.orderBy(F.desc(score), tie).limit(limit)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def satd_summary(debts: DataFrame, by: str) -> DataFrame:
    """Counts, files and mean severity weight of debts(category, severity, path) by a column."""
    from plumbline.functions.text import severity_weight

    return debts.groupBy(by).agg(F.count("*").alias("items"), F.countDistinct("path").alias("files"), F.round(F.avg(severity_weight(F.col("severity"))), 6).alias("mean_severity"))


def satd_density(debts: DataFrame, lines_of_code: int | Column) -> Column:
    """Debts for a thousand lines."""
    loc = F.lit(lines_of_code) if isinstance(lines_of_code, int) else lines_of_code
    return F.when(loc > 0, F.count("*") / loc * 1000).otherwise(0.0)


def coupling(edges: DataFrame) -> DataFrame:
    """edges(from, to) -> (node, afferent, efferent, instability), summed over each node's distinct neighbours."""
    e = edges.filter(F.col("from") != F.col("to")).select("from", "to").distinct()
    out, into = e.groupBy(F.col("from").alias("node")).agg(F.count("*").alias("efferent")), e.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("afferent"))
    both = out.join(into, "node", "full").na.fill(0, ["efferent", "afferent"])
    return both.withColumn("instability", F.round(F.col("efferent") / (F.col("efferent") + F.col("afferent")), 6))


def defect_summary(defects: DataFrame) -> DataFrame:
    """defects(path, severity) -> (path, defects, weight)."""
    return defects.groupBy("path").agg(F.count("*").alias("defects"), F.sum(scoring.severity_points(F.col("severity"))).alias("weight"))


def file_index(defects: DataFrame) -> DataFrame:
    """(path, ids): each file's defect ids in order."""
    return defects.groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def lint_hotspots(diagnostics: DataFrame) -> DataFrame:
    """diagnostics(file, severity, sloc) -> counts by severity, density and enforcement score of each file."""
    per = diagnostics.groupBy("file").agg(F.count("*").alias("violations"), F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.max("sloc").alias("sloc"))
    density = scoring.lint_density(F.col("violations"), F.col("sloc"))
    return per.withColumn("density", F.round(density, 6)).withColumn("enforcement_score", F.round(F.least(10 * density, F.lit(10.0)), 6)).withColumn("fix_seconds", F.col("violations") * 300)


def coverage(lines: DataFrame) -> DataFrame:
    """lines(path, line, hits) -> (path, covered, total, percent)."""
    per = lines.groupBy("path").agg(F.count(F.when(F.col("hits") > 0, 1)).alias("covered"), F.count("*").alias("total"))
    return per.withColumn("percent", F.round(100 * F.col("covered") / F.col("total"), 6))


def coverage_delta(base: DataFrame, now: DataFrame) -> DataFrame:
    """Change of percent by path, for paths on either side."""
    a, b = coverage(base).select("path", F.col("percent").alias("before")), coverage(now).select("path", F.col("percent").alias("after"))
    return a.join(b, "path", "full").select("path", "before", "after", F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 6).alias("delta"))


def gate(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(check, violations, passed) from one violations table for each check."""
    rows = [df.agg(F.lit(name).alias("check"), F.count("*").alias("violations")) for name, df in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("passed", F.col("violations") == 0)


def missing(required: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Required rows that are not present."""
    return required.join(present, key, "left_anti")


def token_budget(sections: DataFrame, budget: int, per: int, group: str) -> DataFrame:
    """sections(group, name, score, tokens) of score over 0.3, best first, while the running tokens stay in the budget."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "name").rowsBetween(Window.unboundedPreceding, 0)
    used = F.least(F.col("tokens"), F.lit(per))
    return sections.filter(F.col("score") > 0.3).withColumn("running", F.sum(used).over(w)).filter(F.col("running") <= budget)


def as_of(events: DataFrame, symbols: DataFrame, key: str, at: str, start: str, name: str) -> DataFrame:
    """Each event with the name of the last symbol of its key that starts at or before it.

    Both sides are sorted once within their key and the last seen name is
    carried along: no pairs are made.
    """
    s = symbols.select(F.col(key), F.col(start).alias("_at"), F.lit(0).alias("_side"), F.col(name).alias("symbol"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"))
    e = events.select(F.col(key), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(symbols.schema[name].dataType).alias("symbol"), "event_id")
    w = Window.partitionBy(key).orderBy("_at", "_side", "symbol").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(e).withColumn("symbol", F.last("symbol", ignorenulls=True).over(w)).filter("_side = 1").select("event_id", key, "symbol")


def in_span(symbols: DataFrame, spans: DataFrame, key: str, start: str, low: str, high: str) -> DataFrame:
    """Symbols whose start lies in a span of their key."""
    return symbols.join(spans, key).filter((F.col(start) >= F.col(low)) & (F.col(start) <= F.col(high)))
