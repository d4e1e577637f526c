"""Named queries on lines of source, symbols, filters, dependency graphs and report formats, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import code
from plumbline.operators import dag, facts, graphs
from plumbline.plans import roles
from plumbline.plans.catalogue import _all, query
from plumbline.plans.roles import with_
from plumbline.session import table
from plumbline.sinks import render

# --- lines of source

_POINTS = """(CASE WHEN t LIKE 'if %' OR t LIKE '% if %' OR t LIKE 'else if%' OR t LIKE 'elif%' OR t LIKE 'when %' THEN 1 ELSE 0 END
 + CASE WHEN t LIKE 'for %' OR t LIKE 'while %' OR t LIKE 'loop %' OR contains(t, '.iter()') OR contains(t, '.forEach') OR contains(t, 'for(') THEN 1 ELSE 0 END
 + CASE WHEN contains(t, '=>') AND NOT contains(t, '//') THEN 1 ELSE 0 END + CASE WHEN t LIKE 'catch%' OR t LIKE 'except%' THEN 1 ELSE 0 END
 + (len(t) - len(replace(t, '&&', ''))) // 2 + (len(t) - len(replace(t, '||', ''))) // 2)"""
_SIMPLE = """(CASE WHEN t LIKE 'if %' OR t LIKE 'else if%' THEN 1 ELSE 0 END + CASE WHEN t LIKE 'for %' OR t LIKE 'while %' THEN 1 ELSE 0 END + CASE WHEN t LIKE 'match %' OR t LIKE 'switch %' THEN 1 ELSE 0 END
 + CASE WHEN contains(t, '=>') OR t LIKE 'case %' THEN 1 ELSE 0 END + CASE WHEN contains(t, '&&') OR contains(t, '||') THEN 1 ELSE 0 END + CASE WHEN t LIKE 'catch%' OR t LIKE 'except%' THEN 1 ELSE 0 END)"""
_NEST = """d AS (SELECT path, line, trim(text) AS t, CASE WHEN trim(text) LIKE '%{' THEN 1 WHEN trim(text) LIKE '}%' THEN -1 ELSE 0 END AS d FROM code),
s AS (SELECT *, sum(d) OVER (PARTITION BY path ORDER BY line) AS s FROM d), nest AS (SELECT *, (s - least(0, min(s) OVER (PARTITION BY path ORDER BY line)))::INT AS nesting FROM s)
"""


@query(with_("code") + f"SELECT path, least(1 + sum({_POINTS}), 50)::BIGINT AS cyclomatic, (1 + sum({_SIMPLE}))::BIGINT AS simple FROM (SELECT path, trim(text) AS t FROM code) GROUP BY path")
def file_cyclomatic(spark, d):
    return code.file_cyclomatic(roles.code_lines(spark, d))


@query(with_("code") + ", " + _NEST + "SELECT path, line, nesting FROM nest")
def running_nesting(spark, d):
    return code.nesting(roles.code_lines(spark, d)).select("path", "line", "nesting")


@query(with_("code") + ", " + _NEST + """SELECT path, least(sum(CASE WHEN t LIKE 'if %' OR t LIKE '% if %' THEN 1 + nesting ELSE 0 END + CASE WHEN t LIKE 'for %' OR t LIKE 'while %' THEN 1 + nesting ELSE 0 END
 + CASE WHEN contains(t, 'fn ') OR contains(t, 'function') OR contains(t, '=>') THEN nesting ELSE 0 END + CASE WHEN contains(t, 'return') AND nesting > 1 THEN 1 ELSE 0 END), 60)::INT AS cognitive FROM nest GROUP BY path""")
def file_cognitive(spark, d):
    return code.file_cognitive(roles.code_lines(spark, d))


@query(with_("code") + """SELECT path, round((1 - count(*) FILTER (trim(text) LIKE '//%' OR trim(text) LIKE '/*%' OR trim(text) LIKE '#%') / count(*)) * 0.5 + least(sum(len(regexp_extract_all(text, 'TODO|FIXME'))) * 0.1, 1.0)::DOUBLE * 0.5, 6) AS churn FROM code GROUP BY path""")
def churn_proxy(spark, d):
    return code.churn_proxy(roles.code_lines(spark, d))


@query(with_("code", recursive=True) + r""", r AS MATERIALIZED (SELECT path, line, text, trim(text) AS t, row_number() OVER (PARTITION BY path ORDER BY line) AS r,
  contains(trim(text), 'if ') OR contains(trim(text), 'while ') OR contains(trim(text), 'for ') OR contains(trim(text), 'match ') AS branch FROM code),
w(path, r0, k, depth, cyc, cog) AS (
  SELECT path, r, 0::BIGINT, 0, 1, 0 FROM r WHERE regexp_matches(text, '(?:fn|def|function)\s+(\w+)')
  UNION ALL SELECT w.path, r0, k + 1, CASE WHEN t LIKE '%{' THEN depth + 1 WHEN t LIKE '}%' THEN greatest(depth - 1, 0) ELSE depth END,
    cyc + CASE WHEN branch THEN 1 ELSE 0 END + CASE WHEN contains(t, 'else') THEN 1 ELSE 0 END, cog + CASE WHEN branch THEN 1 + depth ELSE 0 END + CASE WHEN contains(t, 'else') THEN 1 ELSE 0 END
  FROM w JOIN r ON r.path = w.path AND r.r = r0 + k WHERE k < 20)
SELECT path, r.line, regexp_extract(text, '(?:fn|def|function)\s+(\w+)', 1) AS name, least(max(cyc), 255)::INT AS cyclomatic, least(max(cog), 255)::INT AS cognitive, r.line + 9 AS line_end
FROM w JOIN r USING (path) WHERE r.r = r0 GROUP BY path, r.line, text""")
def function_windows(spark, d):
    return code.function_windows(roles.code_lines(spark, d))


@query(with_("code") + r""", a AS (SELECT path, line, text, regexp_extract(lead(text, 1) OVER w, 'fn\s+(\w+)', 1) AS x, regexp_extract(lead(text, 2) OVER w, 'fn\s+(\w+)', 1) AS y, regexp_extract(lead(text, 3) OVER w, 'fn\s+(\w+)', 1) AS z FROM code WINDOW w AS (PARTITION BY path ORDER BY line))
SELECT path, line, CASE WHEN x <> '' THEN x WHEN y <> '' THEN y ELSE z END AS exported FROM a WHERE text = '#[no_mangle]' AND (x <> '' OR y <> '' OR z <> '')""")
def ffi_exports(spark, d):
    return code.next_function(roles.code_lines(spark, d))


_SYMBOLS = "sy AS (" + " UNION ALL ".join(f"SELECT path, line, '{k}' AS kind, regexp_extract(text, '{p}', 2) AS name, strlen(regexp_extract(text, '{p}', 1))::INT AS \"column\", text FROM code" for k, p in code.SYMBOLS) + "),\nsym AS (SELECT path, line, kind, name, \"column\", CASE WHEN text LIKE 'pub %' THEN 'Public' ELSE 'Internal' END AS visibility FROM sy WHERE name <> '')\n"


@query(with_("code") + ", " + _SYMBOLS + "SELECT * FROM sym")
def symbol_table(spark, d):
    return code.symbols(roles.code_lines(spark, d))


@query(with_("code") + ", " + _SYMBOLS + "SELECT kind, visibility, count(*) AS symbols FROM sym GROUP BY 1, 2")
def symbol_counts(spark, d):
    return code.symbols(roles.code_lines(spark, d)).groupBy("kind", "visibility").agg(F.count("*").alias("symbols"))


@query(with_("code") + ", " + _SYMBOLS + "SELECT path, line, name FROM sym WHERE kind IN ('Type', 'Interface', 'Enum') AND contains(name, '4')")
def symbol_filter(spark, d):
    return code.of_kind(code.symbols(roles.code_lines(spark, d)), "types", "4").select("path", "line", "name")


@query(with_("code") + ", " + _SYMBOLS + r""", t AS (SELECT unnest(regexp_extract_all(text, '\w+')) AS name FROM code), c AS (SELECT name, count(*) AS n FROM t GROUP BY 1) SELECT name, coalesce(n, 0) AS "references" FROM (SELECT DISTINCT name FROM sym) LEFT JOIN c USING (name)""")
def symbol_references(spark, d):
    lines = roles.code_lines(spark, d)
    return code.references(lines, code.symbols(lines))


@query(with_("code") + ", x AS (" + " UNION ALL ".join(f"SELECT path, line, {k} AS place, '{kind}' AS kind, regexp_extract(text, '{p}', 1) AS name FROM code" for k, (kind, p) in enumerate(code.IDENTIFIERS)) + """)
SELECT path, name, kind, line FROM (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY place, line) AS k FROM x WHERE name <> '') WHERE k = 1""")
def identifiers(spark, d):
    return code.identifiers(roles.code_lines(spark, d))


@query(with_("code") + r"SELECT path, unnest(list_transform(regexp_extract_all(text, 'use\s+(\w+)', 1) || regexp_extract_all(text, 'mod\s+(\w+)', 1), lambda n: n || '.rs')) AS name FROM code")
def file_dependencies(spark, d):
    return code.dependencies(roles.code_lines(spark, d), "rs")


# --- rules and filters


@query("SELECT doc_id, CASE WHEN m > 50 THEN 'critical' WHEN m > 20 THEN 'high' WHEN m > 10 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT doc_id, greatest(n_chars % 70, doc_id % 30) AS m FROM documents)")
def metric_severity(spark, d):
    m = F.create_map(F.lit("max_cyclomatic"), F.col("n_chars") % 70, F.lit("cognitive_sum"), F.col("doc_id") % 30, F.lit("lines"), F.lit(1000).cast("long"))
    return table(spark, d, "documents").select("doc_id", code.metric_severity(m).alias("severity"))


_LINTS = "SELECT event_type, CASE event_type WHEN 'click' THEN 'unused_variables' WHEN 'view' THEN 'redundant_clone' WHEN 'error' THEN 'too_many_arguments' WHEN 'signup' THEN 'needless_return' ELSE 'style' END AS lint FROM events"


@query(f"""SELECT 'fix-' || lint AS id, CASE lint WHEN 'unused_variables' THEN 0.95 WHEN 'redundant_clone' THEN 0.9 WHEN 'needless_return' THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence, count(*) AS impact,
  CASE lint WHEN 'unused_variables' THEN 'Remove unused code' WHEN 'redundant_clone' THEN 'Remove redundant code' WHEN 'needless_return' THEN 'Simplify needless patterns' ELSE 'Extract context objects' END AS description
  FROM ({_LINTS}) WHERE lint <> 'style' GROUP BY lint""")
def refactor_chain(spark, d):
    e = F.col("event_type")
    lint = F.when(e == "click", "unused_variables").when(e == "view", "redundant_clone").when(e == "error", "too_many_arguments").when(e == "signup", "needless_return").otherwise("style")
    counts = table(spark, d, "events").groupBy(lint.alias("lint")).agg(F.count("*").alias("n"))
    return counts.select(code.refactor_step(F.col("lint"), F.col("n")).alias("s")).select("s.*").filter("confidence >= 0.75")


@query("SELECT p_partkey AS id, (CASE WHEN lower(p_name) = 'blue gear' THEN 10 WHEN contains(lower(p_name), 'blue gear') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_type), 'blue gear') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'blue gear') THEN 1 ELSE 0 END)::INT AS points FROM part")
def template_relevance(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), code.relevance(F.col("p_name"), F.col("p_type"), F.array("p_brand"), "blue gear").alias("points"))


@query("SELECT source, count(*) FILTER (source LIKE 'src1%') AS one, count(*) FILTER (regexp_matches(source, '^src.$')) AS short FROM documents GROUP BY source")
def glob_match(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.when(code.glob(F.col("source"), "src1*"), 1)).alias("one"), F.count(F.when(code.glob(F.col("source"), "src?"), 1)).alias("short"))


# --- graphs of size


@query(with_("purchases") + "SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, round((coalesce(i, 0) + coalesce(o, 0)) / ((SELECT count(*) FROM pn) - 1), 6) AS degree_centrality FROM pn LEFT JOIN (SELECT f AS id, count(*) AS o FROM pe GROUP BY f) USING (id) LEFT JOIN (SELECT t AS id, count(*) AS i FROM pe GROUP BY t) USING (id)")
def purchase_degrees(spark, d):
    return graphs.degrees(*roles.purchases(spark, d))


@query(with_("purchases") + """, od AS (SELECT f, count(*) AS o FROM pe GROUP BY f), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS rank FROM pn)""" + "".join(f", r{k + 1} AS MATERIALIZED (SELECT pn.id, 0.15::DOUBLE + 0.85 * coalesce(sum(r{k}.rank / o), 0) AS rank FROM pn LEFT JOIN pe ON pe.t = pn.id LEFT JOIN od ON od.f = pe.f LEFT JOIN r{k} ON r{k}.id = pe.f GROUP BY pn.id)" for k in range(10)) + " SELECT id, round(rank, 6) AS rank FROM r10")
def purchase_rank(spark, d):
    n, e = roles.purchases(spark, d)
    return graphs.pagerank(n, e).select("id", F.round("rank", 6).alias("rank"))


@query(with_("purchases", recursive=True) + ", l AS (SELECT f AS a, min(t) AS b FROM pe GROUP BY f) SELECT CASE WHEN id IN (SELECT f FROM pe UNION SELECT t FROM pe) THEN 'linked' ELSE 'alone' END AS kind, count(*) AS nodes FROM pn GROUP BY 1")
def purchase_components(spark, d):
    """How many nodes are in a component of more than one."""
    n, e = roles.purchases(spark, d)
    of = graphs.components(n, e)
    sizes = of.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.when(F.col("n") > 1, "linked").otherwise("alone").alias("kind")).agg(F.sum("n").alias("nodes"))


@query(with_("graph") + """, lay AS (SELECT id, ['Presentation', 'Application', 'Domain', 'Infrastructure'][component + 1] AS layer FROM n WHERE component < 4)
SELECT f AS "from", t AS "to", a.layer AS from_layer, b.layer AS to_layer FROM e JOIN lay AS a ON a.id = f JOIN lay AS b ON b.id = t
WHERE (a.layer, b.layer) NOT IN (('Presentation', 'Application'), ('Presentation', 'Domain'), ('Application', 'Domain'), ('Application', 'Infrastructure'), ('Domain', 'Domain'), ('Infrastructure', 'Domain'))""")
def layer_violations(spark, d):
    n, e = _all(spark, d)
    names = F.array(*[F.lit(x) for x in ("Presentation", "Application", "Domain", "Infrastructure")])
    layers = n.filter("component < 4").select("id", F.get(names, F.col("component").cast("int")).alias("layer"))
    return dag.layer_violations(e.select("from", "to"), layers)


@query(with_("graph") + "SELECT DISTINCT id FROM (SELECT id FROM n WHERE component = 2 UNION ALL SELECT f FROM calls JOIN n ON n.id = t WHERE component = 2)")
def changed_dependents(spark, d):
    n, e = _all(spark, d)
    return dag.with_dependents(n.filter("component = 2"), e.filter(F.col("edge_type") == "Calls"))


@query("SELECT l_suppkey AS location, l_returnflag AS property, max_by(l_linestatus, l_extendedprice * 10 + CASE l_linestatus WHEN 'O' THEN 0.001 ELSE 0 END) AS method, max(l_extendedprice) AS confidence FROM lineitem GROUP BY 1, 2")
def merged_proofs(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("location"), F.col("l_returnflag").alias("property"), F.col("l_linestatus").alias("method"), F.col("l_extendedprice").alias("confidence"))
    return dag.merged_proofs(i)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND p = '1' THEN 'Violating' WHEN o_orderstatus = 'O' AND p = '2' THEN 'Complete' WHEN o_orderstatus = 'F' AND p = '1' THEN 'O' ELSE o_orderstatus END AS state FROM (SELECT *, substr(o_orderpriority, 1, 1) AS p FROM orders)")
def state_step(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.substring("o_orderpriority", 1, 1).alias("event"))
    return dag.transitions(s, [("O", "1", "Violating"), ("O", "2", "Complete"), ("F", "1", "O")])


@query(with_("lines") + """, t AS (SELECT path, trim(text) AS t, count(*) AS c FROM doclines WHERE trim(text) <> '' GROUP BY 1, 2) SELECT path, count(*) AS groups, sum(c)::BIGINT AS lines, round(ln(greatest(sum(c), 1)) * sqrt(count(*)), 6) AS severity FROM t WHERE c > 1 GROUP BY path""")
def clone_hotspots(spark, d):
    """Severity of a file's repeated lines: ln of the lines by the root of the groups."""
    t = roles.doc_lines(spark, d).select("path", F.trim("text").alias("t")).filter("t <> ''").groupBy("path", "t").agg(F.count("*").alias("c")).filter("c > 1")
    per = t.groupBy("path").agg(F.count("*").alias("groups"), F.sum("c").alias("lines"))
    return per.withColumn("severity", F.round(F.ln(F.greatest("lines", F.lit(1))) * F.sqrt("groups"), 6))


@query(with_("functions") + "SELECT count(DISTINCT path) AS files, count(*) AS functions, round(avg(cyclomatic), 6) AS mean_complexity, max(cyclomatic) AS max_complexity, count(*) FILTER (cyclomatic > 10) AS high FROM functions")
def project_metrics(spark, d):
    c = F.col("cyclomatic")
    return roles.functions(spark, d).agg(F.count_distinct("path").alias("files"), F.count("*").alias("functions"), F.round(F.avg(c), 6).alias("mean_complexity"), F.max(c).alias("max_complexity"), F.count(F.when(c > 10, 1)).alias("high"))


@query(with_("defects") + "SELECT CASE WHEN severity = 'critical' THEN 'Critical' WHEN severity IN ('high', 'medium') THEN 'Warning' ELSE 'Normal' END AS level, count(*) AS defects, round(count(*) / (SELECT count(*) FROM defects) * 1000, 6) AS density FROM defects GROUP BY 1")
def defect_levels(spark, d):
    s, rows = F.col("severity"), roles.defects(spark, d)
    n = rows.agg(F.count("*").alias("n"))
    level = F.when(s == "critical", "Critical").when(s.isin("high", "medium"), "Warning").otherwise("Normal").alias("level")
    return rows.groupBy(level).agg(F.count("*").alias("defects")).crossJoin(F.broadcast(n)).select("level", "defects", F.round(F.col("defects") / F.col("n") * 1000, 6).alias("density"))  # one row is broadcast


# --- report formats


@query("SELECT event_id, event_id || ',' || event_type || ',\"' || replace(props, '\"', '\"\"') || '\"' AS line FROM events WHERE contains(props, '\"')")
def report_csv(spark, d):
    return table(spark, d, "events").filter(F.col("props").contains('"')).select("event_id", render.csv_line(F.col("event_id"), F.col("event_type"), F.col("props")).alias("line"))


@query(with_("defects") + "SELECT path || ':' || id || ':1: ' || severity || ': ' || category AS line FROM defects")
def report_gcc(spark, d):
    return roles.defects(spark, d).select(render.gcc_line(F.col("path"), F.col("id"), F.lit(1), F.col("severity"), F.col("category")).alias("line"))


@query(with_("functions", "violations") + "SELECT '| ' || path || ' | ' || name || ' | ' || severity || ' |' AS line FROM violations")
def report_markdown(spark, d):
    return facts.violations(roles.functions(spark, d)).select(render.markdown_row(F.col("path"), F.col("name"), F.col("severity")).alias("line"))


@query(with_("defects") + "SELECT '<testcase name=\"' || id || '\" classname=\"' || path || '\"' || CASE WHEN severity = 'critical' THEN '><failure message=\"' || category || '\"/></testcase>' ELSE '/>' END AS line FROM defects")
def report_junit(spark, d):
    return roles.defects(spark, d).select(render.junit_case(F.col("id"), F.col("path"), F.when(F.col("severity") == "critical", F.col("category"))).alias("line"))


@query(with_("graph") + "SELECT '<edge source=\"' || f || '\" target=\"' || t || '\"/>' AS line FROM e")
def report_graphml(spark, d):
    return _all(spark, d)[1].select(render.graphml_edge(F.col("from"), F.col("to")).alias("line"))


@query("""SELECT l_suppkey AS path, 'SF:' || l_suppkey || chr(10) || string_agg('DA:' || k || ',' || h, chr(10) ORDER BY k, 'DA:' || k || ',' || h) || chr(10) || 'LF:' || count(*) || chr(10) || 'LH:' || count(*) FILTER (h > 0) || chr(10) || 'end_of_record' AS record
  FROM (SELECT l_suppkey, l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS h FROM lineitem) GROUP BY l_suppkey""")
def report_lcov(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("line"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("hits"))
    return render.lcov_record(i)


@query(with_("defects") + """SELECT '{"ruleId":"' || category || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || category || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' || id || '}}}]}' AS result FROM defects""")
def report_sarif(spark, d):
    return roles.defects(spark, d).select(render.sarif_result(F.col("category"), F.col("severity"), F.col("category"), F.col("path"), F.col("id")).alias("result"))


@query(with_("graph") + """SELECT '    ' || f || ' ' || CASE edge_type WHEN 'Calls' THEN '-->' WHEN 'Imports' THEN '-.->' WHEN 'Inherits' THEN '-->|inherits|' WHEN 'Implements' THEN '-->|implements|' ELSE '---' END || ' ' || t AS line FROM e
UNION ALL SELECT '    ' || id || '[' || label || ']' FROM n""")
def report_mermaid(spark, d):
    n, e = _all(spark, d)
    edges = e.select(render.mermaid_edge(F.col("from"), F.col("to"), F.col("edge_type")).alias("line"))
    return edges.union(n.select(render.mermaid_node(F.col("id"), F.col("label"))))


@query("SELECT page_id AS name, sha256(html) AS sha256, octet_length(encode(html))::INT AS bytes FROM pages")
def artifact_manifest(spark, d):
    return render.manifest(table(spark, d, "pages").select(F.col("page_id").alias("name"), F.col("html").alias("content")))
