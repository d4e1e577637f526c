"""Named queries on module names, READMEs, Makefiles, WebAssembly text, issues, gates and defects, each with its SQL twin.

The roles are projections that Spark and the twins spell alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import projects
from plumbline.operators import gates, makefiles
from plumbline.plans import roles
from plumbline.plans.catalogue import query
from plumbline.plans.roles import with_
from plumbline.session import table

NODES = {
    "id": "CASE WHEN p_partkey % 3 = 0 THEN 'node_node_module_x_' || p_partkey ELSE 'file_part_' || p_partkey END",
    "label": "CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END",
    "path": "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'src/p' || p_partkey || '/mod.rs' WHEN 2 THEN 'lib/b.x/c' || p_partkey || '.py' WHEN 3 THEN 'app/x' || p_partkey || '/index.ts' WHEN 4 THEN 'src/lib/net' || p_partkey || '/http.go' WHEN 5 THEN 'web' || chr(92) || 'ui' || p_partkey || '.kt' ELSE 'core/index/index.java' END",
}
READMES = {
    "path": "p_partkey",
    "title": "CASE p_partkey % 9 WHEN 0 THEN 'Overview' WHEN 1 THEN 'Our API' WHEN 2 THEN 'License and FAQ' WHEN 3 THEN 'Feature list' WHEN 4 THEN p_name WHEN 5 THEN 'Getting Started' WHEN 6 THEN 'Usage of features' WHEN 7 THEN 'Sponsors' ELSE 'Notes' END",
    "level": "1 + p_size % 3",
    "paragraphs": "p_partkey % 2",
    "lists": "p_partkey % 5",
    "text": "CASE p_partkey % 3 WHEN 0 THEN '# Installation' || chr(10) || '## Usage' WHEN 1 THEN '# License' ELSE 'plain' END",
}
TARGETS = {
    "path": "p_partkey",
    "target": "CASE p_partkey % 8 WHEN 0 THEN 'build' WHEN 1 THEN 'docker-' || p_size WHEN 2 THEN 'test-' || p_size WHEN 3 THEN 'x-deploy' WHEN 4 THEN 'helper' || p_size WHEN 5 THEN 'uninstall' WHEN 6 THEN 'fmt' ELSE 'prep' END",
    "variable": "CASE p_partkey % 4 WHEN 0 THEN 'CC' WHEN 1 THEN 'VERSION' WHEN 2 THEN 'FOO' || p_size ELSE 'OS' END",
}
ISSUES = {
    "id": "event_id",
    "url": "CASE WHEN event_type = 'error' THEN 'https://github.com/o' || user_id || '/r/issues/' || event_id ELSE 'https://example.org/' || event_id END",
    "text": "CASE WHEN event_type = 'error' THEN 'Crash in `src/mod_' || event_id || '.rs` and services::part_' || user_id || '::run, see docs/guide.md' WHEN event_type = 'view' THEN 'Slow parse of crates/a-b/lib.rs; docs/guide.md, docs/guide.md' ELSE 'no file' END",
}
BLOCKS = ("'fn a() {'", "'}'", "CASE WHEN o_orderkey % 3 = 0 THEN '#[cfg(test)]' ELSE '// TODO: one' END", "'mod tests {'", "CASE WHEN o_orderkey % 4 = 0 THEN '  fn t() { // TODO: two' ELSE '} else {' END",
          "'  }'", "CASE WHEN o_orderkey % 5 = 0 THEN '#[cfg(test)]' ELSE '}' END", "'} // HACK: x'", "'}'", "'// FIXME: last'")

# Spark would replace a braced name within one literal
MAKEFILE = ("'SRC = $(wildcard *.c)'", "CASE WHEN p_partkey % 2 = 0 THEN 'OBJ = $(SRC:.c=.o)' ELSE 'OBJ := $(SRC)' END", "CASE WHEN p_partkey % 3 = 0 THEN 'NOW := $(shell date)' ELSE 'NOW = now' END", "CASE WHEN p_partkey % 5 = 0 THEN 'CC ?= gcc' ELSE 'REV != git' END",
            "'BIN = $(OBJ) $' || '{NOW}'", "'all: $(BIN)'", "chr(9) || '$(CC) $(BIN) $(BIN) $$(HOME) $@ $(f)'", "chr(9) || 'echo $(MISS_' || p_size || ') $(OBJ) $' || '{OBJ}'")


def _role(spark, d, name: str, columns: dict[str, str]):
    return table(spark, d, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _sql(name: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {name})"


@query(r"""WITH a AS (SELECT *, CASE WHEN regexp_matches(path, '\.(py|ts|tsx|js|jsx|java|kt|kts)$') THEN '.' WHEN path LIKE '%.go' THEN '/' ELSE '::' END AS sep, regexp_replace(regexp_replace(path, '^(src|lib|app)/', ''), '\.[a-z]+$', '') AS bare FROM """ + _sql("part", NODES) + r"""),
b AS (SELECT *, replace(replace(bare, '/', sep), chr(92), sep) AS m FROM a)
SELECT id, CASE WHEN label <> '' AND label <> id THEN label WHEN path = '' THEN replace(regexp_replace(regexp_replace(regexp_replace(id, '^(node_)+', ''), '^(module_)+', ''), '^(file_)+', ''), '_', '.')
  WHEN ends_with(m, sep || 'index') THEN regexp_replace(m, '(' || CASE sep WHEN '.' THEN '\.' ELSE sep END || 'index)+$', '') WHEN ends_with(m, sep || 'mod') THEN left(m, len(m) - len(sep) - 3) ELSE m END AS name FROM b""")
def semantic_names(spark, d):
    return _role(spark, d, "part", NODES).select("id", projects.semantic_name(F.col("id"), F.col("label"), F.col("path")).alias("name"))


@query("SELECT path, (CASE WHEN t LIKE '%overview%' OR t LIKE '%architecture%' OR t LIKE '%api%' OR t LIKE '%philosophy%' OR t LIKE '%core concepts%' OR t LIKE '%design principles%' THEN 0.9 WHEN t LIKE '%features%' OR t LIKE '%usage%' OR t LIKE '%quickstart%' OR t LIKE '%getting started%' OR t LIKE '%installation%' OR t LIKE '%configuration%' THEN 0.6 WHEN t LIKE '%examples%' OR t LIKE '%troubleshooting%' OR t LIKE '%faq%' THEN 0.3 WHEN t LIKE '%badges%' OR t LIKE '%license%' OR t LIKE '%contributing%' OR t LIKE '%changelog%' OR t LIKE '%acknowledgments%' OR t LIKE '%sponsors%' THEN 0.1 WHEN level = 1 AND paragraphs > 0 THEN 0.7 WHEN lists > 0 AND t LIKE '%feature%' THEN 0.7 ELSE 0.4 END)::DOUBLE AS score FROM (SELECT *, lower(title) AS t FROM " + _sql("part", READMES) + ")")
def readme_scores(spark, d):
    return _role(spark, d, "part", READMES).select("path", projects.section_score(F.col("title"), F.col("level"), F.col("paragraphs"), F.col("lists")).alias("score"))


@query("SELECT path, target IN ('build', 'fmt') OR target LIKE 'docker%' OR target LIKE 'test-%' OR target LIKE 'build-%' OR contains(target, 'deploy') OR contains(target, 'install') AS keep_target, variable IN ('CC', 'VERSION', 'OS') AS keep_variable FROM " + _sql("part", TARGETS))
def makefile_kept(spark, d):
    return _role(spark, d, "part", TARGETS).select("path", projects.critical_target(F.col("target")).alias("keep_target"), projects.critical_variable(F.col("variable")).alias("keep_variable"))


_COUNT = "(2 * (len(string_split(text, '{}')) - 1) + floor((len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END) / 10))::BIGINT"


@query(f"SELECT doc_id, {_COUNT.format('func')} AS wat_complexity, {_COUNT.format('function')} AS script_complexity, regexp_matches(text, '@global|@inline|@external|i32|f64|memory\\.') OR (contains(text, 'export') AND contains(text, 'function')) AS is_script, regexp_matches(text, '^\\s*\\(') AND regexp_matches(text, 'module|func') AS is_wat FROM documents WHERE text IS NOT NULL")
def wasm_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter(t.isNotNull()).select("doc_id", projects.wasm_complexity(t).alias("wat_complexity"), projects.wasm_complexity(t, "function").alias("script_complexity"), projects.is_assemblyscript(t).alias("is_script"), projects.is_wat(t).alias("is_wat"))


@query(r"""WITH i AS (SELECT *, regexp_extract_all(text, '\b[a-zA-Z0-9_]+(?:::[a-zA-Z0-9_]+)+\b') AS m FROM """ + _sql("events", ISSUES) + r""")
SELECT id, regexp_extract(url, 'github\.com/([^/]+)/([^/]+)/issues/(\d+)', 1) AS owner, nullif(regexp_extract(url, '/issues/(\d+)', 1), '')::BIGINT AS number,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '`([a-zA-Z0-9_\-./]+\.[a-zA-Z0-9]+)`', 1) || regexp_extract_all(text, '\b(?:[a-zA-Z0-9_\-]+/)*[a-zA-Z0-9_\-]+\.[a-zA-Z0-9]+\b') || list_transform(m, lambda x: 'src/' || replace(x, '::', '/') || '.rs') || list_transform(m, lambda x: 'server/src/' || replace(x, '::', '/') || '.rs'))), ',') AS files FROM i""")
def issue_references(spark, d):
    of = projects.issue_of(F.col("url"))
    return _role(spark, d, "events", ISSUES).select("id", F.coalesce(of["owner"], F.lit("")).alias("owner"), of["number"].alias("number"), F.array_join(projects.issue_paths(F.col("text")), ",").alias("files"))


@query(with_("comments", "functions") + ", r AS " + _sql("part", READMES) + r"""SELECT 'security' AS "check", 'error' AS severity, path::VARCHAR AS path, 'Hardcoded password detected' AS message, NULL::DOUBLE AS value, NULL::DOUBLE AS bound FROM comments WHERE regexp_matches(text, '(?i)password\s*=\s*["''][^"'']+["'']')
UNION ALL SELECT 'security', 'error', path::VARCHAR, 'Hardcoded secret detected', NULL, NULL FROM comments WHERE regexp_matches(text, '(?i)secret\s*=\s*["''][^"'']+["'']')
UNION ALL SELECT 'sections', 'warning', path::VARCHAR, 'Missing required section: ' || s, NULL, NULL FROM r, (SELECT unnest(['Installation', 'Usage', 'Contributing', 'License']) AS s) WHERE NOT contains(text, '# ' || s)
UNION ALL SELECT 'coverage', 'error', 'project', 'below minimum', round(v, 6), 80 FROM (SELECT 100.0 * count(*) FILTER (l_returnflag <> 'R') / count(*) AS v FROM lineitem) WHERE v < 80
UNION ALL SELECT 'dead_code', 'error', 'project', 'above maximum', round(v, 6), 15 FROM (SELECT 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) AS v FROM lineitem) WHERE v > 15
UNION ALL SELECT 'entropy', 'warning', 'project', 'below minimum', round(v, 6), 6 FROM (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS v FROM (SELECT count(*) AS c FROM functions GROUP BY cyclomatic)) WHERE v < 6
UNION ALL SELECT 'provability', 'warning', 'project', 'below minimum', round(v, 6), 0.7 FROM (SELECT avg(l_discount) AS v FROM lineitem) WHERE v < 0.7""")
def gate_violations(spark, d):
    lines, i = roles.comments(spark, d), table(spark, d, "lineitem")
    share = lambda flag: i.agg((100.0 * F.count(F.when(flag, 1)) / F.count("*")).alias("value"))
    returned, n = F.col("l_returnflag") == "R", F.col("c")
    spread = roles.functions(spark, d).groupBy("cyclomatic").agg(F.count("*").alias("c")).agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("value"))
    out = gates.security(lines).union(gates.sections(_role(spark, d, "part", READMES)))
    for check in (
        gates.measured("coverage", "error", share(~returned), least=80),
        gates.measured("dead_code", "error", share(returned), most=15),
        gates.measured("entropy", "warning", spread, least=6),
        gates.measured("provability", "warning", i.agg(F.avg("l_discount").cast("double").alias("value")), least=0.7),
    ):
        out = out.union(check)
    return out


@query("""WITH a AS (SELECT 'dead_code' AS category, 'dead-function' AS rule, CASE WHEN l_quantity > 45 THEN 'High' WHEN l_quantity > 35 THEN 'Medium' ELSE 'Low' END AS severity, l_suppkey AS path FROM lineitem
UNION ALL SELECT 'duplication', 'duplication-type' || l_linenumber % 3 + 1, CASE WHEN l_linenumber % 3 = 0 AND l_quantity * 2 > 50 THEN 'High' WHEN l_linenumber % 3 = 0 OR (l_linenumber % 3 = 1 AND l_quantity * 2 > 30) THEN 'Medium' ELSE 'Low' END, l_suppkey FROM lineitem
UNION ALL SELECT 'performance', 'high-complexity', CASE l_linenumber WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 3 THEN 'Medium' ELSE 'Low' END, l_suppkey FROM lineitem
UNION ALL SELECT 'complexity', 'tdg-complexity', CASE WHEN l_returnflag = 'R' THEN 'Critical' WHEN l_returnflag = 'A' THEN 'High' WHEN l_quantity > 25 THEN 'Medium' ELSE 'Low' END, l_suppkey FROM lineitem)
SELECT category, rule, severity, count(*) AS defects, count(DISTINCT path) AS files FROM a GROUP BY 1, 2, 3""")
def adapted_defects(spark, d):
    i, q, k = table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_linenumber")
    path, kind = F.col("l_suppkey"), F.concat(F.lit("Type"), (k % 3 + 1).cast("int"))
    growth = F.when(k == 1, "Exponential").when(k == 2, "Cubic").when(k == 3, "Quadratic").otherwise("Linear")
    graded = F.when(F.col("l_returnflag") == "R", "Critical").when(F.col("l_returnflag") == "A", "Warning").otherwise("Normal")
    found = (
        gates.as_defects(i, "dead_code", F.lit("dead-function"), gates.dead_defect(q / 50), path)
        .union(gates.as_defects(i, "duplication", F.concat(F.lit("duplication-"), F.lower(kind)), gates.clone_defect(kind, q * 2), path))
        .union(gates.as_defects(i, "performance", F.lit("high-complexity"), gates.growth_defect(growth), path))
        .union(gates.as_defects(i, "complexity", F.lit("tdg-complexity"), gates.gradient_defect(graded, q / 50), path))
    )
    return found.groupBy("category", "rule", "severity").agg(F.count("*").alias("defects"), F.countDistinct("path").alias("files"))


@query(with_("code") + """, b AS (SELECT user_id AS path, event_id AS line, floor((epoch((SELECT max(ts) FROM events)) - epoch(ts)) / 86400) AS days FROM events)
SELECT round(avg(days), 6) AS mean_days, count(*) AS debts FROM code JOIN b USING (path, line) WHERE contains(text, 'TODO') OR contains(text, 'FIXME')""")
def debt_age(spark, d):
    e = table(spark, d, "events")
    blame = e.select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), "ts").crossJoin(e.agg(F.max("ts").alias("now")))  # one row
    return gates.debt_age(roles.code_lines(spark, d).filter(F.col("text").rlike("TODO|FIXME")), blame)


@query("WITH RECURSIVE f AS (SELECT o_orderkey AS path, [" + ", ".join(BLOCKS) + """] AS l FROM orders),
walk AS (SELECT path, l, 0 AS line, false AS inside, 0 AS depth FROM f
UNION ALL SELECT path, l, line + 1, CASE WHEN t = '#[cfg(test)]' THEN true ELSE inside AND NOT (now = 0 AND t LIKE '%}') END, CASE WHEN t = '#[cfg(test)]' THEN 0 WHEN inside THEN now ELSE depth END
  FROM (SELECT *, trim(l[line + 1]) AS t, greatest(0, depth + len(l[line + 1]) - len(replace(l[line + 1], '{', '')) - len(l[line + 1]) + len(replace(l[line + 1], '}', ''))) AS now FROM walk WHERE line < len(l)))
SELECT path, line::INT AS line FROM walk WHERE line > 0 AND NOT inside""")
def lines_outside_tests(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.posexplode(F.array(*[F.expr(x) for x in BLOCKS])).alias("at", "text"))
    return gates.outside_tests(rows.select("path", (F.col("at") + 1).alias("line"), "text")).select("path", "line")


@query("WITH RECURSIVE l AS (SELECT p_partkey AS path, unnest(range(1, 9))::INT AS line, unnest([" + ", ".join(MAKEFILE) + r"""]) AS text FROM part),
a AS (SELECT path, line, regexp_extract(text, '^([A-Z]+)', 1) AS name, regexp_extract(text, '^[A-Z]+ ([^ ]+) ', 1) AS op, regexp_extract(text, '^[A-Z]+ [^ ]+ (.*)$', 1) AS value FROM l WHERE regexp_matches(text, '^[A-Z]+ (=|:=|\?=|!=) ')),
u AS (SELECT path, line, text LIKE chr(9) || '%' AS recipe, unnest(regexp_extract_all(replace(text, '$$', ''), '\$[({]([A-Z_0-9]+)[:)}]', 1)) AS name FROM l WHERE text NOT LIKE 'all%'),
slow AS (SELECT path, name FROM a WHERE op = '=' AND contains(value, '$(wildcard') UNION SELECT a.path, a.name FROM slow JOIN u ON u.path = slow.path AND u.name = slow.name JOIN a ON a.path = u.path AND a.line = u.line AND a.op = '=')
SELECT path, line, 'timestampexpanded' AS rule, 'info' AS severity, name FROM a WHERE op = ':=' AND contains(value, '$(shell date')
UNION ALL SELECT path, line, 'undefinedvariable', 'warning', name FROM u WHERE name <> 'CC' AND NOT EXISTS (SELECT 1 FROM a WHERE a.path = u.path AND a.name = u.name)
UNION ALL SELECT path, line, 'portability', 'info', name FROM a WHERE op IN ('?=', '!=')
UNION ALL SELECT u.path, line, 'recursive-expansion', 'performance', u.name FROM u JOIN slow ON slow.path = u.path AND slow.name = u.name WHERE recipe GROUP BY u.path, line, u.name HAVING count(*) > 1""")
def makefile_variables(spark, d):
    # the table is one small file: it is dealt before its rows become eight lines each, which one task would match otherwise
    parts = table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = parts.select(F.col("p_partkey").alias("path"), F.posexplode(F.array(*[F.expr(x) for x in MAKEFILE])).alias("at", "text"))
    return makefiles.violations(rows.select("path", (F.col("at") + 1).alias("line"), "text"))
