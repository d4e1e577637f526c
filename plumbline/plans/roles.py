"""The fact tables that the operators take, projected from the driver's tables, in Spark and in SQL.

``SQL`` holds the same projections as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import table


def commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    return i.join(o, "hash")


def functions(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("name"), q.alias("cyclomatic"), (q + F.col("l_linenumber") * 2).cast("int").alias("cognitive"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("lines"))


def comments(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    text = (
        F.when(e == "error", F.concat(F.lit("// FIXME: case "), "event_id"))
        .when(e == "click", F.lit("# TODO later: slow path"))
        .when(e == "view", F.concat(F.lit("x = 1; // hack "), "user_id"))
        .when(e == "signup", F.lit("/* SECURITY: password = 'abc123' */"))
        .otherwise(F.lit("<!-- HACK: temporary workaround -->"))
    )
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("path"), text.alias("text"))


def defects(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    severity = F.when(e == "error", "critical").when(e == "purchase", "high").when(e == "signup", "medium").otherwise("low")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), severity.alias("severity"), e.alias("category"), "value", "ts")


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations and all trade edges between them, of five kinds."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("from"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("to"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "from")
    e = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(s, "l_suppkey").filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("weight"))
    kinds = F.array(*[F.lit(x) for x in ("Inherits", "Uses", "Implements", "Calls", "Imports")])
    edges = e.withColumn("edge_type", F.get(kinds, ((F.col("from") + F.col("to")) % 5).cast("int")))
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("component"))
    return nodes, edges


def purchases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers, and who bought from whom: a sparse graph that grows with the data. Suppliers' ids are negative."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("from"))
    edges = table(spark, d, "lineitem").select("l_orderkey", (-1 - F.col("l_suppkey")).alias("to")).join(o, "l_orderkey").groupBy("from", "to").agg(F.count("*").alias("weight"))
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, d, "supplier").select(-1 - F.col("s_suppkey")))
    return nodes, edges


def code_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of source, a user's events as a file."""
    e, k = F.col("event_type"), F.col("event_id")
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = (
        F.when(e == "click", say("pub fn handle_", k % 40, "(x: i32) {"))
        .when(e == "view", say("    if x > ", k % 7, " && ready || done {"))
        .when(e == "purchase", F.lit("}"))
        .when((e == "signup") & (k % 3 == 0), say("use util_", k % 5, ";"))
        .when((e == "signup") & (k % 3 == 1), say("struct Item_", k % 50, " { a: i32 }"))
        .when(e == "signup", say("const LIMIT_", k % 9, " = 3;"))
        .when(k % 4 == 0, F.lit("#[no_mangle]"))
        .when(k % 4 == 1, F.lit("// TODO: for later, else return"))
        .otherwise(say("    for value_", k % 20, " in items.iter() { // FIXME"))
    )
    return table(spark, d, "events").select(F.col("user_id").alias("path"), k.alias("line"), text.alias("text"))


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources.trees import lines

    return lines(table(spark, d, "documents"), "doc_id", "text")


def file_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' figures in the role of files' metrics."""
    i = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("path")).agg(F.count("*").alias("lines"), F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.max("l_quantity").alias("most"))
    return i.select("path", (F.col("returned") / F.col("lines") * 2).alias("churn"), (F.col("most") - 20).alias("complexity"), (F.col("lines") - F.col("parts")).cast("double").alias("repeats"), (F.col("repeats") / F.col("lines")).alias("duplication"), (F.col("orders") % 25).cast("double").alias("afferent"), (F.col("parts") % 7).cast("double").alias("efferent"), F.col("lines").alias("loc"))


SQL = {
    "commits": """commits AS (SELECT l_orderkey AS hash, l_partkey AS path, l_quantity::BIGINT AS additions, l_linenumber::BIGINT AS deletions, o_custkey AS author, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "churn": """per AS (SELECT path, count(*) AS commit_count, count(DISTINCT author) AS unique_authors, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, min(ts) AS first_seen, max(ts) AS last_modified
  FROM commits GROUP BY path),
churn AS (SELECT per.*, round(least(1.0, 0.6 * commit_count / m.c + 0.4 * (additions + deletions) / m.x), 6) AS churn_score
  FROM per, (SELECT max(commit_count) AS c, max(additions + deletions) AS x FROM per) AS m)""",
    "functions": """functions AS (SELECT l_suppkey AS path, l_orderkey || '_' || l_linenumber AS name, l_quantity::INT AS cyclomatic, (l_quantity::INT + l_linenumber * 2)::INT AS cognitive, floor(l_extendedprice / 1000)::INT AS lines FROM lineitem)""",
    "violations": """violations AS (
  SELECT path, name, 'cyclomatic-complexity' AS rule, CASE WHEN cyclomatic > 20 THEN 'error' ELSE 'warning' END AS severity, cyclomatic AS value, CASE WHEN cyclomatic > 20 THEN 20 ELSE 10 END AS threshold FROM functions WHERE cyclomatic > 10
  UNION ALL
  SELECT path, name, 'cognitive-complexity', CASE WHEN cognitive > 30 THEN 'error' ELSE 'warning' END, cognitive, CASE WHEN cognitive > 30 THEN 30 ELSE 15 END FROM functions WHERE cognitive > 15)""",
    "comments": """comments AS (SELECT event_id, user_id AS path, CASE event_type WHEN 'error' THEN '// FIXME: case ' || event_id WHEN 'click' THEN '# TODO later: slow path' WHEN 'view' THEN 'x = 1; // hack ' || user_id
  WHEN 'signup' THEN '/* SECURITY: password = ''abc123'' */' ELSE '<!-- HACK: temporary workaround -->' END AS text FROM events)""",
    "debts": """debts AS (SELECT event_id, path, comment,
  CASE WHEN regexp_matches(comment, '(?i)\\b(hack|kludge|smell)\\b') THEN 'Design' WHEN regexp_matches(comment, '(?i)\\b(fixme|broken|bug)\\b') THEN 'Defect' WHEN regexp_matches(comment, '(?i)\\btodo\\b') THEN 'Requirement'
       WHEN regexp_matches(comment, '(?i)\\b(security|vuln|cve)\\b') THEN 'Security' END AS category,
  CASE WHEN regexp_matches(comment, '(?i)\\b(hack|kludge|smell)\\b') THEN 'Medium' WHEN regexp_matches(comment, '(?i)\\b(fixme|broken|bug)\\b') THEN 'High' WHEN regexp_matches(comment, '(?i)\\btodo\\b') THEN 'Low'
       WHEN regexp_matches(comment, '(?i)\\b(security|vuln|cve)\\b') THEN 'Critical' END AS severity
  FROM (SELECT event_id, path, CASE WHEN text LIKE '//%' THEN trim(substr(text, 3)) WHEN text LIKE '#%' THEN trim(substr(text, 2)) WHEN text LIKE '/*%*/' THEN trim(substr(text, 3, len(text) - 4)) WHEN text LIKE '<!--%-->' THEN trim(substr(text, 5, len(text) - 7)) END AS comment FROM comments)
  WHERE comment IS NOT NULL)""",
    "code": """code AS (SELECT user_id AS path, event_id AS line, CASE WHEN event_type = 'click' THEN 'pub fn handle_' || (event_id % 40) || '(x: i32) {' WHEN event_type = 'view' THEN '    if x > ' || (event_id % 7) || ' && ready || done {'
  WHEN event_type = 'purchase' THEN '}' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'use util_' || (event_id % 5) || ';' WHEN event_type = 'signup' AND event_id % 3 = 1 THEN 'struct Item_' || (event_id % 50) || ' { a: i32 }'
  WHEN event_type = 'signup' THEN 'const LIMIT_' || (event_id % 9) || ' = 3;' WHEN event_id % 4 = 0 THEN '#[no_mangle]' WHEN event_id % 4 = 1 THEN '// TODO: for later, else return' ELSE '    for value_' || (event_id % 20) || ' in items.iter() { // FIXME' END AS text FROM events)""",
    "purchases": """pe AS (SELECT o_custkey AS f, -1 - l_suppkey AS t, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
pn AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT -1 - s_suppkey FROM supplier)""",
    "defects": """defects AS (SELECT event_id AS id, user_id AS path, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity, event_type AS category, value, ts FROM events)""",
    "graph": """trade AS (SELECT c_nationkey AS f, s_nationkey AS t, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS (SELECT f, t, weight, ['Inherits', 'Uses', 'Implements', 'Calls', 'Imports'][1 + (f + t) % 5] AS edge_type FROM trade),
calls AS (SELECT f, t FROM e WHERE edge_type = 'Calls'),
n AS (SELECT n_nationkey AS id, n_name AS label, n_regionkey AS component FROM nation)""",
    "paths": """walk(s, id, d) AS (SELECT id, id, 0 FROM n UNION SELECT walk.s, e.t, d + 1 FROM walk JOIN calls AS e ON e.f = walk.id WHERE d < 25),
dist AS (SELECT s, id, min(d) AS d FROM walk GROUP BY s, id)""",
    "lines": r"""doclines AS (SELECT doc_id AS path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) END AS l FROM documents))""",
    "metrics": """metrics AS (SELECT path, returned / lines * 2 AS churn, most - 20 AS complexity, (lines - parts)::DOUBLE / lines AS duplication, (orders % 25)::DOUBLE AS afferent, (parts % 7)::DOUBLE AS efferent, lines AS loc
  FROM (SELECT l_suppkey AS path, count(*) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS returned, max(l_quantity) AS most FROM lineitem GROUP BY 1))""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[x] for x in names) + "\n"
