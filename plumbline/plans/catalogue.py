"""Named queries over the driver's tables, each with its SQL twin.

``QUERIES`` maps a name to (function of (spark, folder), SQL or None).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names as nm
from plumbline.functions import scoring as sc
from plumbline.functions import stats, text
from plumbline.operators import clones, facts, graphs
from plumbline.plans import roles
from plumbline.plans.roles import with_
from plumbline.session import cut, table
from plumbline.sources import trees

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# --- churn


@query(with_("commits", "churn") + "SELECT path, commit_count, unique_authors, additions, deletions, first_seen, last_modified, churn_score FROM churn ORDER BY churn_score DESC, path LIMIT 10")
def churn_hotspots(spark, d):
    return facts.churn(roles.commits(spark, d)).orderBy(F.desc("churn_score"), "path").limit(10)


@query(with_("commits", "churn") + "SELECT sum(commit_count)::BIGINT AS total_commits, count(*) AS total_files, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, round(avg(churn_score), 6) AS mean_score, count(*) FILTER (churn_score > 0.5) AS hotspots, count(*) FILTER (churn_score < 0.1) AS stable FROM churn")
def churn_summary(spark, d):
    return facts.churn_summary(facts.churn(roles.commits(spark, d)))


@query(with_("commits") + "SELECT author, count(DISTINCT path) AS files FROM commits GROUP BY author")
def author_contributions(spark, d):
    return facts.author_contributions(roles.commits(spark, d))


# --- debt gradient

_TDG = """factors AS (SELECT path, count(*) AS commits, avg(additions) AS mean, stddev_pop(additions) AS sd, max(additions) AS most, count(DISTINCT author) AS imports, avg(deletions) / 10 AS instability FROM commits GROUP BY path),
parts AS (SELECT path, least(5.0, 0.4 * mean / 5 + 0.2 * sd / 3 + 0.2 * least(most / 10, 1.0) + 0.2 * least(commits * 10 / 100, 1.0)) AS complexity, least(5.0, ln(1 + commits / 3) / 2) AS churn,
  least(5.0, least(imports / 15, 2.0) + 2 * instability + CASE WHEN imports > 20 THEN 1.0 ELSE 0.0 END) AS coupling, p_size / 25 AS duplication, CASE WHEN p_type = 'PROMO' THEN 2.0 ELSE 0.0 END AS domain_risk
  FROM factors JOIN part ON path = p_partkey),
tdg AS (SELECT path, round(greatest(0.0, least(5.0, (0.30 * complexity + 0.35 * churn + 0.15 * coupling + 0.10 * domain_risk + 0.10 * duplication) * 0.915)), 6) AS value FROM parts)
"""


def _parts(spark, d) -> DataFrame:
    f = roles.commits(spark, d).groupBy("path").agg(F.count("*").alias("commits"), F.avg("additions").alias("mean"), F.stddev_pop("additions").alias("sd"), F.max("additions").alias("most"), F.countDistinct("author").alias("imports"), (F.avg("deletions") / 10).alias("instability"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_size", F.when(F.col("p_type") == "PROMO", "src/auth/x.rs").otherwise("src/x.rs").alias("file"))
    return f.join(p, "path").select("path", sc.complexity_factor(F.col("mean"), F.col("sd"), F.col("most"), F.col("commits") * 10).alias("complexity"), sc.churn_factor(F.col("commits")).alias("churn"), sc.coupling_factor(F.col("imports"), F.col("instability")).alias("coupling"), sc.domain_risk(F.col("file")).alias("domain_risk"), (F.col("p_size") / 25).alias("duplication"))


def _cols() -> dict:
    return {k: F.col(k) for k in sc.GRADIENT}


def _gradient(spark, d) -> DataFrame:
    return _parts(spark, d).withColumn("value", F.round(sc.gradient(_cols()), 6))


@query(with_("commits") + "SELECT path, round(least(5.0, ln(1 + count(*) / 3) / 2), 6) AS factor FROM commits GROUP BY path")
def tdg_churn_factor(spark, d):
    return roles.commits(spark, d).groupBy("path").agg(F.round(sc.churn_factor(F.count("*")), 6).alias("factor"))


@query(with_("commits") + ", " + _TDG + """SELECT path, value, CASE WHEN value > 2.5 THEN 'critical' WHEN value > 1.5 THEN 'warning' ELSE 'normal' END AS severity, round(2 * pow(1.8, value), 4) AS hours,
  round(CASE WHEN churn = 0 THEN 0.8 ELSE 1 END * CASE WHEN coupling = 0 THEN 0.9 ELSE 1 END * CASE WHEN duplication = 0 THEN 0.95 ELSE 1 END, 6)::DOUBLE AS confidence FROM tdg JOIN parts USING (path)""")
def tdg_score(spark, d):
    g = _gradient(spark, d)
    return g.select("path", "value", sc.gradient_severity(F.col("value")).alias("severity"), F.round(sc.gradient_hours(F.col("value")), 4).alias("hours"), F.round(sc.gradient_confidence(F.col("churn"), F.col("coupling"), F.col("duplication")), 6).alias("confidence"))


@query(with_("commits") + ", " + _TDG + """SELECT path, CASE greatest(0.30 * complexity, 0.35 * churn, 0.15 * coupling, 0.10 * domain_risk, 0.10 * duplication)
  WHEN 0.30 * complexity THEN 'complexity' WHEN 0.35 * churn THEN 'churn' WHEN 0.15 * coupling THEN 'coupling' WHEN 0.10 * domain_risk THEN 'domain_risk' ELSE 'duplication' END AS factor FROM parts""")
def tdg_primary_factor(spark, d):
    return _parts(spark, d).select("path", sc.primary_factor(_cols()).alias("factor"))


@query(with_("commits") + ", " + _TDG + """SELECT count(*) AS files, count(*) FILTER (value > 2.5) AS critical, count(*) FILTER (value > 1.5 AND value <= 2.5) AS warning, round(avg(value), 6) AS mean, round(sum(2 * pow(1.8, value)), 2) AS hours,
  max(CASE WHEN k = least(floor(n * 0.95), n - 1) THEN value END) AS p95, max(CASE WHEN k = least(floor(n * 0.99), n - 1) THEN value END) AS p99 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM tdg)""")
def tdg_summary(spark, d):
    g = _gradient(spark, d).select("value")
    v = F.col("value")
    top = g.agg(F.count("*").alias("files"), F.count(F.when(v > 2.5, 1)).alias("critical"), F.count(F.when((v > 1.5) & (v <= 2.5), 1)).alias("warning"), F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(sc.gradient_hours(v)), 2).alias("hours"))
    p95, p99 = stats.percentile(g, "value", 0.95).withColumnRenamed("value", "p95"), stats.percentile(g, "value", 0.99).withColumnRenamed("value", "p99")
    return top.crossJoin(p95).crossJoin(p99)  # one row each


@query(with_("commits") + ", " + _TDG + """SELECT b::INT AS bucket, (b * 0.5)::DOUBLE AS lower, ((b + 1) * 0.5)::DOUBLE AS upper, count(value) AS "count", round(100.0 * count(value) / greatest((SELECT count(*) FROM tdg), 1), 6) AS percentage
  FROM range(10) AS r(b) LEFT JOIN tdg ON least(floor(value / 0.5), 9) = b GROUP BY b""")
def tdg_histogram(spark, d):
    return stats.histogram(_gradient(spark, d), "value", 0.5, 10)


@query(with_("commits") + ", " + _TDG + "SELECT path, round(100.0 * (rank() OVER (ORDER BY value) - 1) / count(*) OVER (), 6) AS percentile FROM tdg")
def tdg_percentile(spark, d):
    g = cut(_gradient(spark, d).select("path", "value"))
    counts = g.groupBy("value").agg(F.count("*").alias("c"))  # ranks over the distinct values only
    below = stats.running(counts, "value").withColumnRenamed("before", "below")
    n = counts.agg(F.sum("c").alias("n"))
    return g.join(below, "value").crossJoin(F.broadcast(n)).select("path", F.round(100.0 * F.col("below") / F.col("n"), 6).alias("percentile"))


@query(with_("commits") + ", " + _TDG + "SELECT path, value FROM tdg WHERE value > 1.5 ORDER BY value DESC, path LIMIT 20")
def tdg_hotspots(spark, d):
    return _gradient(spark, d).filter("value > 1.5").select("path", "value").orderBy(F.desc("value"), "path").limit(20)


# --- complexity


@query(with_("functions", "violations") + """, t AS (SELECT count(*) AS functions, count(DISTINCT path) AS files, round(median(cyclomatic), 6) AS median_cyclomatic, round(median(cognitive), 6) AS median_cognitive, max(cyclomatic) AS max_cyclomatic, max(cognitive) AS max_cognitive FROM functions),
p AS (SELECT max(CASE WHEN a = least(floor(n * 0.9), n - 1) THEN cyclomatic END) AS p90_cyclomatic, max(CASE WHEN b = least(floor(n * 0.9), n - 1) THEN cognitive END) AS p90_cognitive
  FROM (SELECT cyclomatic, cognitive, row_number() OVER (ORDER BY cyclomatic) - 1 AS a, row_number() OVER (ORDER BY cognitive) - 1 AS b, count(*) OVER () AS n FROM functions))
SELECT t.*, p.*, v.* FROM t, p, (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, round(sum(CASE WHEN severity = 'error' THEN 30 * (value - threshold) ELSE 15 * (value - threshold) END) / 60, 6) AS debt_hours FROM violations) AS v""")
def complexity_report(spark, d):
    return facts.complexity_report(roles.functions(spark, d))


@query(with_("functions", "violations") + "SELECT * FROM violations")
def complexity_violations(spark, d):
    return facts.violations(roles.functions(spark, d))


@query(with_("functions") + "SELECT path, name, cyclomatic, cognitive FROM functions WHERE cyclomatic > 10 ORDER BY cyclomatic DESC, cognitive DESC, path, name LIMIT 10")
def complexity_hotspots(spark, d):
    return roles.functions(spark, d).filter("cyclomatic > 10").orderBy(F.desc("cyclomatic"), F.desc("cognitive"), "path", "name").limit(10).select("path", "name", "cyclomatic", "cognitive")


@query(with_("functions") + """SELECT path, functions, max_cyclomatic, round(mean_cognitive, 6) AS mean_cognitive, round(0.4 * least(max_cyclomatic, 50) / 50 * 100 + 0.4 * least(mean_cognitive, 100) / 100 * 100 + 0.2 * least(functions, 100) / 100 * 50, 6) AS score
  FROM (SELECT path, count(*) AS functions, max(cyclomatic) AS max_cyclomatic, avg(cognitive) AS mean_cognitive FROM functions GROUP BY path)""")
def complexity_rank(spark, d):
    return facts.complexity_rank(roles.functions(spark, d))


@query(with_("functions") + """SELECT path, row_number() OVER (ORDER BY m DESC, path) AS rank, m AS score FROM (SELECT path, sum(cyclomatic)::BIGINT AS m FROM functions GROUP BY path) ORDER BY m DESC, path LIMIT 25""")
def file_rank(spark, d):
    per = roles.functions(spark, d).groupBy("path").agg(F.sum("cyclomatic").alias("score"))
    return facts.ranked(per, "score", "path", 25).select("path", F.col("rank").cast("long").alias("rank"), "score")


@query(with_("functions") + """, top AS (SELECT path FROM functions GROUP BY path ORDER BY sum(cyclomatic + cognitive) DESC, path LIMIT 10)
SELECT count(*) AS functions, round(avg(cyclomatic), 6) AS mean_cyclomatic, max(cognitive) AS max_cognitive FROM functions SEMI JOIN top USING (path)""")
def top_files_summary(spark, d):
    f = roles.functions(spark, d)
    top = f.groupBy("path").agg(F.sum(F.col("cyclomatic") + F.col("cognitive")).alias("s")).orderBy(F.desc("s"), "path").limit(10)
    return f.join(F.broadcast(top.select("path")), "path", "left_semi").agg(F.count("*").alias("functions"), F.round(F.avg("cyclomatic"), 6).alias("mean_cyclomatic"), F.max("cognitive").alias("max_cognitive"))  # ten rows are broadcast


def _rule(k: str, order: str = "x") -> str:
    return f"SELECT max(x) AS value FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice {order}) - 1 AS k, count(*) OVER () AS n FROM lineitem) WHERE k = {k}"


@query(_rule("least(floor(n * 0.9), n - 1)", ""))
def percentile_rule1(spark, d):
    return stats.percentile(table(spark, d, "lineitem"), "l_extendedprice", 0.9, 1)


@query(_rule("floor((n - 1) * 0.9)", ""))
def percentile_rule2(spark, d):
    return stats.percentile(table(spark, d, "lineitem"), "l_extendedprice", 0.9, 2)


@query(_rule("n * 99 // 100", ""))
def percentile_rule3(spark, d):
    return stats.percentile(table(spark, d, "lineitem"), "l_extendedprice", 0.99, 3)


@query(_rule("n // 2", "DESC"))
def percentile_rule4(spark, d):
    return stats.percentile(table(spark, d, "lineitem"), "l_extendedprice", 0.5, 4)


@query(with_("functions") + "SELECT path, round(median(lines), 6) AS median_lines FROM functions GROUP BY path")
def median_debt(spark, d):
    return roles.functions(spark, d).groupBy("path").agg(F.round(F.median("lines"), 6).alias("median_lines"))


@query(with_("functions") + "SELECT path, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy, sum(c)::BIGINT AS n FROM (SELECT path, cyclomatic, count(*) AS c FROM functions GROUP BY 1, 2) GROUP BY path")
def complexity_entropy(spark, d):
    return stats.entropy(roles.functions(spark, d), ["path"], "cyclomatic").withColumn("entropy", F.round("entropy", 6))


@query(with_("functions") + "SELECT path, round(stddev_pop(cyclomatic) / avg(cyclomatic) * 100, 6) AS cv FROM functions GROUP BY path")
def complexity_cv(spark, d):
    return roles.functions(spark, d).groupBy("path").agg(F.round(stats.coefficient_of_variation("cyclomatic"), 6).alias("cv"))


@query("SELECT round(2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT l_quantity AS x, row_number() OVER (ORDER BY l_quantity) AS k FROM lineitem)")
def gini(spark, d):
    return stats.gini(table(spark, d, "lineitem"), "l_quantity")


@query(with_("functions") + "SELECT CASE WHEN cyclomatic <= 5 THEN '0-5' WHEN cyclomatic <= 10 THEN '6-10' WHEN cyclomatic <= 15 THEN '11-15' WHEN cyclomatic <= 20 THEN '16-20' ELSE '20+' END AS bucket, count(*) AS functions FROM functions GROUP BY 1")
def complexity_chart(spark, d):
    c = F.col("cyclomatic")
    return roles.functions(spark, d).groupBy(F.when(c <= 5, "0-5").when(c <= 10, "6-10").when(c <= 15, "11-15").when(c <= 20, "16-20").otherwise("20+").alias("bucket")).agg(F.count("*").alias("functions"))


# --- self-admitted debt and text


def _debts(spark, d, patterns=text.DEBT) -> DataFrame:
    c = roles.comments(spark, d).withColumn("comment", text.comment_text(F.col("text"))).filter(F.col("comment").isNotNull())
    return text.debt(c, "comment", patterns)


@query(with_("comments", "debts") + "SELECT event_id, category, severity FROM debts WHERE category IS NOT NULL")
def satd_classify(spark, d):
    return _debts(spark, d).select("event_id", "category", "severity")


@query(with_("comments") + r"SELECT event_id, CASE WHEN regexp_matches(text, '(?i)\b(TODO|FIXME|XXX|BUG|HACK|KLUDGE|REFACTOR):') THEN 'Requirement' ELSE 'Security' END AS category FROM comments WHERE (text LIKE '//%' OR text LIKE '#%' OR text LIKE '/*%*/' OR text LIKE '<!--%-->') AND regexp_matches(text, '(?i)\b(TODO|FIXME|XXX|BUG|HACK|KLUDGE|REFACTOR|SECURITY|VULN|CVE):')")
def satd_strict(spark, d):
    return _debts(spark, d, text.STRICT).select("event_id", "category")


_WEIGH = "CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END"


@query(with_("comments", "debts") + f"SELECT category, count(*) AS items, count(DISTINCT path) AS files, round(avg({_WEIGH}), 6) AS mean_severity FROM debts WHERE category IS NOT NULL GROUP BY category")
def satd_by_category(spark, d):
    return facts.satd_summary(_debts(spark, d), "category")


@query(with_("comments", "debts") + "SELECT count(*) AS debts, count(DISTINCT path) AS files, round(count(*) / (SELECT count(*) FROM events) * 1000, 6) AS density FROM debts WHERE category IS NOT NULL")
def satd_metrics(spark, d):
    n = table(spark, d, "events").agg(F.count("*").alias("n"))
    return _debts(spark, d).crossJoin(F.broadcast(n)).agg(F.count("*").alias("debts"), F.countDistinct("path").alias("files"), F.round(facts.satd_density(None, F.max("n")), 6).alias("density"))


@query(with_("comments") + "SELECT event_id, (CASE WHEN strpos(text, '//') > 0 THEN strpos(text, '//') WHEN strpos(text, '#') > 0 THEN strpos(text, '#') WHEN strpos(text, '/*') > 0 THEN strpos(text, '/*') WHEN strpos(text, '<!--') > 0 THEN strpos(text, '<!--') ELSE 1 END)::INT AS col FROM comments")
def satd_column(spark, d):
    return roles.comments(spark, d).select("event_id", text.comment_column(F.col("text")).alias("col"))


@query(with_("comments") + r"SELECT event_id, regexp_extract(text, '(TODO|FIXME|HACK|XXX):\s*(.+)', 1) AS marker, CASE WHEN regexp_extract(text, '(TODO|FIXME|HACK|XXX):\s*(.+)', 1) IN ('HACK', 'XXX') THEN 'high' ELSE 'medium' END AS severity FROM comments WHERE regexp_matches(text, '(TODO|FIXME|HACK|XXX):\s*(.+)') ")
def satd_markers(spark, d):
    m = text.marker(F.col("text"))
    return roles.comments(spark, d).select("event_id", m.alias("marker")).filter("marker <> ''").withColumn("severity", text.marker_severity(F.col("marker")))


@query(with_("comments") + r"SELECT event_id FROM comments WHERE regexp_matches(text, '(?i)(password|api_key|secret)\s*=\s*[''" + '"' + r"][^''" + '"' + r"]+[''" + '"' + "]')")
def literal_secrets(spark, d):
    return roles.comments(spark, d).filter(F.col("text").rlike(text.SECRET)).select("event_id")


@query("SELECT page_id, len(regexp_extract_all(html, '<!--.*?-->'))::INT AS comments FROM pages")
def markup_comments(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<!--.*?-->"), F.lit(0))).alias("comments"))


@query("SELECT user_id, required.event_type FROM (SELECT DISTINCT user_id FROM events) AS u, (SELECT unnest(['click', 'view', 'purchase', 'signup']) AS event_type) AS required ANTI JOIN events ON events.user_id = u.user_id AND events.event_type = required.event_type")
def missing_sections(spark, d):
    e = table(spark, d, "events")
    required = e.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup")])))
    return facts.missing(required, e.select("user_id", "event_type").distinct(), ["user_id", "event_type"])


@query(r"""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(substr(hex(encode(text)), 1, 2048), '..')) AS x FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY 1, 2)
SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY doc_id""")
def byte_entropy(spark, d):
    return table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", F.round(trees.byte_entropy(F.col("text")), 6).alias("entropy"))


@query(r"""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(substr(hex(encode(text)), 1, 2048), '..')) AS v FROM documents), c AS (SELECT doc_id, v, count(*) AS n FROM b GROUP BY 1, 2),
h AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM c GROUP BY doc_id), x AS (SELECT doc_id, text, octet_length(encode(text)) AS n, list_max(list_transform(string_split(text, chr(10)), lambda l: octet_length(encode(l)))) AS longest, len(text) - len(replace(text, chr(10), '')) AS breaks FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n > 1048576 THEN 'too_large' WHEN n > 512000 THEN 'large' WHEN longest > 10000 THEN 'long_line' WHEN breaks / n < 0.001 OR entropy > 6 THEN 'minified' END AS reason FROM x LEFT JOIN h USING (doc_id)""")
def parse_decision(spark, d):
    t = table(spark, d, "documents").withColumn("entropy", trees.byte_entropy(F.col("text")))
    return t.select("doc_id", trees.skip_reason(F.concat_ws("/", F.lit("src"), "source"), F.col("text"), F.col("entropy")).alias("reason"))


@query("SELECT lang, source, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def discovery_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


# --- clones


@query(with_("lines") + """, t AS (SELECT path, trim(text) AS t, count(*) AS c FROM doclines WHERE trim(text) <> '' AND trim(text) NOT LIKE '//%' AND trim(text) NOT LIKE '#%' GROUP BY 1, 2)
SELECT path, sum(c)::BIGINT AS n, sum(CASE WHEN octet_length(encode(t)) > 10 AND c > 1 THEN c - 1 ELSE 0 END)::BIGINT AS duplicate, round(CASE WHEN sum(c) < 10 THEN 0.0 ELSE least(5.0, sum(CASE WHEN octet_length(encode(t)) > 10 AND c > 1 THEN c - 1 ELSE 0 END) / sum(c) * 100 / 30) END, 6) AS factor FROM t GROUP BY path""")
def duplicate_lines(spark, d):
    return facts.duplicate_line_share(roles.doc_lines(spark, d))


@query(with_("lines") + """, w AS (SELECT path, line, list(trim(text)) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM doclines)
SELECT path, line::INT AS start, places, files FROM (SELECT path, line, count(*) OVER (PARTITION BY w) AS places, w FROM w WHERE len(w) = 5) JOIN (SELECT w, count(DISTINCT path) AS files FROM w WHERE len(w) = 5 GROUP BY w) USING (w) WHERE places > 1""")
def duplicate_windows(spark, d):
    w = clones.line_windows(roles.doc_lines(spark, d), 5)
    return w.join(clones.repeated_windows(w), "hash").select("path", "start", "places", "files")


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_files(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select("first_id", "copies")


def _fragments(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), "p_size", F.lit("end")), " ").alias("tokens"))


@query("""WITH f AS (SELECT p_partkey AS id, string_split(p_name || ' ' || p_brand || ' ' || p_type || ' size ' || p_size || ' end', ' ') AS t FROM part),
s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')))) AS s FROM f)
SELECT min(id) AS id, len(s)::INT AS shingles, count(*) AS members FROM s GROUP BY s""")
def shingle_sets(spark, d):
    s = _fragments(spark, d).select("id", F.sort_array(clones.shingles(F.col("tokens"))).alias("s"))
    return s.groupBy("s").agg(F.min("id").alias("id"), F.count("*").alias("members")).select("id", F.size("s").alias("shingles"), "members")


# --- names

_NAMES = "WITH a AS (SELECT DISTINCT p_name AS a FROM part) "


def _named(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("a")).distinct().withColumn("b", F.lit("blue gear"))


@query(_NAMES + """, g AS (SELECT a, list_distinct(list_transform(range(1, len(a)), lambda i: substr(a, i, 2))) AS g, list_distinct(list_transform(range(1, 9), lambda i: substr('blue gear', i, 2))) AS h FROM a)
SELECT a, round(len(list_intersect(g, h)) / len(list_distinct(g || h)), 6) AS likeness FROM g""")
def name_bigram(spark, d):
    return _named(spark, d).select("a", F.round(nm.jaccard(nm.bigrams(F.col("a")), nm.bigrams(F.col("b"))), 6).alias("likeness"))


@query(_NAMES + "SELECT a, levenshtein(a, 'blue gear') AS distance, round(1 - levenshtein(a, 'blue gear') / greatest(strlen(a), 9), 6) AS likeness FROM a")
def name_levenshtein(spark, d):
    return _named(spark, d).select("a", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(nm.fuzzy(F.col("a"), F.col("b")), 6).alias("likeness"))


_SOUND = """, c AS (SELECT a, regexp_replace(upper(a), '[^A-Z]', '', 'g') AS l FROM a),
k AS (SELECT a, l, regexp_replace(translate(l, 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000000'), '0+', '0', 'g') AS k FROM c),
r AS (SELECT a, l, replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), 2), '0', '') AS r FROM k)
SELECT a, rpad(l[1] || substr(r, 1, 3), 4, '0') AS sound FROM r"""


@query(_NAMES + _SOUND)
def name_soundex(spark, d):
    return _named(spark, d).select("a", nm.soundex(F.col("a")).alias("sound"))


@query()
def name_similarity(spark, d):
    s = nm.combined(F.col("a"), F.col("b"))
    return _named(spark, d).select("a", F.round(s, 6).alias("score")).filter("score >= 0.3")


@query(_NAMES + "SELECT a, round(least(1.0, 1 - levenshtein(a, 'gear') / greatest(strlen(a), 4) + CASE WHEN contains(a, 'gear') OR contains('gear', a) THEN 0.3 ELSE 0 END), 6) AS score FROM a")
def name_contained(spark, d):
    return _named(spark, d).select("a", F.round(nm.contained(F.col("a"), F.lit("gear")), 6).alias("score"))


# --- defects


def _curve(x: str, curve) -> str:
    steps = "".join(f" WHEN {x} <= {b} THEN {p} + ({x} - {a}) * ({q - p!r} / {b - a!r})" for (a, p), (b, q) in zip(curve, curve[1:]))
    return f"CASE WHEN {x} <= {curve[0][0]} THEN {curve[0][1]}{steps} ELSE {curve[-1][1]} END"


_PROB = f"""raw AS (SELECT *, 0.35 * ({_curve("churn", sc.CHURN_CURVE)}) + 0.30 * ({_curve("complexity", sc.COMPLEXITY_CURVE)}) + 0.25 * greatest(0, least(1, duplication)) + 0.10 * ({_curve("afferent", sc.COUPLING_CURVE)}) AS raw FROM metrics),
prob AS (SELECT *, 1 / (1 + exp(-10 * (raw - 0.5))) AS p FROM raw)
"""


def _probability(spark, d) -> DataFrame:
    m = roles.file_metrics(spark, d)
    return m.withColumn("p", sc.defect_probability(F.col("churn"), F.col("complexity"), F.col("duplication"), F.col("afferent")))


_RISK = "CASE WHEN p >= 0.7 THEN 'High' WHEN p >= 0.3 THEN 'Medium' ELSE 'Low' END"


@query(with_("metrics") + ", " + _PROB + f"SELECT path, round(p, 6) AS probability, {_RISK} AS risk FROM prob")
def defect_probability(spark, d):
    return _probability(spark, d).select("path", F.round("p", 6).alias("probability"), sc.risk_level(F.col("p")).alias("risk"))


def _advice_sql() -> str:
    said = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in sc.ADVICE.items()}
    limits = f"(CASE WHEN complexity > 15 THEN {said['cyclomatic']} ELSE [] END) || (CASE WHEN loc % 40 > 20 THEN {said['cognitive']} ELSE [] END)"
    return f"""f AS (SELECT path, loc, complexity, 0.35 * ({_curve("churn", sc.CHURN_CURVE)}) AS a, 0.30 * ({_curve("complexity", sc.COMPLEXITY_CURVE)}) AS b, 0.25 * greatest(0, least(1, duplication)) AS c, 0.10 * ({_curve("afferent", sc.COUPLING_CURVE)}) AS d FROM metrics),
m AS (SELECT *, greatest(a, b, c, d) AS best FROM f)
SELECT path, array_to_string((CASE WHEN best <= 0.2 THEN [] WHEN d = best THEN {said["coupling"]} WHEN c = best THEN {said["duplication"]} WHEN b = best THEN {said["complexity"]} || {limits} ELSE {said["churn"]} END)
  || (CASE WHEN a + b + c + d > 0.7 THEN {said["risk"]} ELSE [] END), '; ') AS advice FROM m"""


@query(with_("metrics") + ", " + _advice_sql())
def defect_advice(spark, d):
    m = F.col
    advice = sc.defect_advice(m("churn"), m("complexity"), m("duplication"), m("afferent"), m("complexity"), m("loc") % 40)
    return roles.file_metrics(spark, d).select("path", F.array_join(advice, "; ").alias("advice"))


@query(with_("metrics") + "SELECT path, round(CASE WHEN loc < 10 THEN 0.5 WHEN loc < 50 THEN 0.8 ELSE 1.0 END * CASE WHEN afferent = 0 AND efferent = 0 THEN 0.9 ELSE 1.0 END * CASE WHEN churn = 0 THEN 0.85 ELSE 1.0 END, 6)::DOUBLE AS confidence FROM metrics")
def defect_confidence(spark, d):
    return roles.file_metrics(spark, d).select("path", F.round(sc.defect_confidence(F.col("loc"), F.col("afferent"), F.col("efferent"), F.col("churn")), 6).alias("confidence"))


@query(with_("metrics") + ", " + _PROB + f"SELECT {_RISK} AS risk, count(*) AS files, round(avg(p), 6) AS mean FROM prob GROUP BY 1")
def risk_distribution(spark, d):
    return _probability(spark, d).groupBy(sc.risk_level(F.col("p")).alias("risk")).agg(F.count("*").alias("files"), F.round(F.avg("p"), 6).alias("mean"))


@query(with_("functions", "violations", "defects") + "SELECT severity, category, count(*) AS defects FROM (SELECT severity, category FROM defects UNION ALL SELECT CASE severity WHEN 'error' THEN 'high' ELSE 'medium' END, rule FROM violations) GROUP BY 1, 2")
def defect_union(spark, d):
    v = facts.violations(roles.functions(spark, d)).select(F.when(F.col("severity") == "error", "high").otherwise("medium").alias("severity"), F.col("rule").alias("category"))
    return roles.defects(spark, d).select("severity", "category").unionByName(v).groupBy("severity", "category").agg(F.count("*").alias("defects"))


_POINTS = "CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 5.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END"


@query(with_("defects") + f"SELECT path, count(*) AS defects, sum({_POINTS})::DOUBLE AS weight FROM defects GROUP BY path ORDER BY weight DESC, path LIMIT 10")
def defect_hotspots(spark, d):
    return facts.defect_summary(roles.defects(spark, d)).orderBy(F.desc("weight"), "path").limit(10)


@query(with_("defects") + "SELECT id, path, severity FROM defects ORDER BY CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, path, id")
def defect_order(spark, d):
    order = F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high", "critical")]), F.col("severity"))
    return roles.defects(spark, d).orderBy(order, "path", "id").select("id", "path", "severity")


@query(with_("defects") + "SELECT path, array_to_string(list_sort(list(id)), ',') AS ids FROM defects GROUP BY path")
def file_index(spark, d):
    return facts.file_index(roles.defects(spark, d)).select("path", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# --- graph


def _all(spark, d):
    return roles.graph(spark, d)


def _calls(spark, d):
    n, e = _all(spark, d)
    return n, e.filter(F.col("edge_type") == "Calls")


@query(with_("graph") + """SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, round((coalesce(i, 0) + coalesce(o, 0)) / ((SELECT count(*) FROM n) - 1), 6) AS degree_centrality
  FROM n LEFT JOIN (SELECT f AS id, count(*) AS o FROM e GROUP BY f) USING (id) LEFT JOIN (SELECT t AS id, count(*) AS i FROM e GROUP BY t) USING (id)""")
def degree_centrality(spark, d):
    return graphs.degrees(*_all(spark, d))


@query(with_("graph") + """SELECT coalesce(a.node, b.node) AS node, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent, round(coalesce(efferent, 0) / (coalesce(efferent, 0) + coalesce(afferent, 0)), 6) AS instability
  FROM (SELECT f AS node, count(DISTINCT t) AS efferent FROM e GROUP BY f) AS a FULL JOIN (SELECT t AS node, count(DISTINCT f) AS afferent FROM e GROUP BY t) AS b ON a.node = b.node""")
def coupling(spark, d):
    return facts.coupling(_all(spark, d)[1])


@query(with_("graph") + """, g AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT max(c) FROM (SELECT id, count(*) AS c FROM (SELECT f AS id FROM e UNION ALL SELECT t FROM e) GROUP BY id)) AS max_degree)
SELECT nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 6) AS density, round(2 * edges / nodes, 6) AS average_degree, max_degree FROM g""")
def graph_density(spark, d):
    return graphs.totals(*_all(spark, d))


def _rank_sql(normalised: bool) -> str:
    start, base = ("1.0 / (SELECT count(*) FROM n)", "0.15 / (SELECT count(*) FROM n)") if normalised else ("1.0", "0.15")
    sql = with_("graph") + f", od AS (SELECT f, count(*) AS o FROM e GROUP BY f), r0 AS (SELECT id, ({start})::DOUBLE AS rank FROM n)"
    for k in range(10):
        sql += f", r{k + 1} AS (SELECT n.id, ({base})::DOUBLE + 0.85 * coalesce(sum(r{k}.rank / o), 0) AS rank FROM n LEFT JOIN e ON e.t = n.id LEFT JOIN od ON od.f = e.f LEFT JOIN r{k} ON r{k}.id = e.f GROUP BY n.id)"
    return sql


@query(_rank_sql(False) + " SELECT id, round(rank, 6) AS rank FROM r10")
def pagerank_fixed(spark, d):
    n, e = _all(spark, d)
    return graphs.pagerank(n, e).select("id", F.round("rank", 6).alias("rank"))


@query(_rank_sql(True) + " SELECT component, round(sum(rank), 6) AS rank FROM r10 JOIN n USING (id) GROUP BY component")
def pagerank_module(spark, d):
    n, e = _all(spark, d)
    return graphs.pagerank(n, e, normalised=True).join(n, "id").groupBy("component").agg(F.round(F.sum("rank"), 6).alias("rank"))


@query()
def pagerank_converged(spark, d):
    n, e = _all(spark, d)
    return graphs.pagerank(n, e, rounds=100, normalised=True, dangling=True, threshold=1e-3).select("id", F.round("rank", 6).alias("rank"))


@query(with_("graph", "paths", recursive=True) + "SELECT n.id, round(coalesce(((SELECT count(*) FROM n) - 1) / sum(d), 0), 6) AS closeness FROM n LEFT JOIN dist ON s = n.id AND d > 0 GROUP BY n.id")
def closeness(spark, d):
    n, e = _calls(spark, d)
    return graphs.closeness(n, graphs.distances(n, e))


@query(with_("graph", "paths", recursive=True) + """, p AS (SELECT * FROM dist WHERE d > 0), c AS (SELECT a.id, count(*) AS c FROM p AS a JOIN p AS b ON a.id = b.s JOIN p AS x ON x.s = a.s AND x.id = b.id WHERE a.s <> b.id AND a.d + b.d = x.d GROUP BY a.id)
SELECT n.id, round(coalesce(c, 0) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)), 6) AS betweenness FROM n LEFT JOIN c USING (id)""")
def betweenness(spark, d):
    n, e = _calls(spark, d)
    return graphs.betweenness(n, graphs.distances(n, e))


@query(with_("graph", recursive=True) + """, u AS (SELECT f, t FROM calls UNION SELECT t, f FROM calls), w(id, c) AS (SELECT id, id FROM n UNION SELECT u.t, w.c FROM w JOIN u ON u.f = w.id) SELECT id, min(c) AS component FROM w GROUP BY id""")
def components(spark, d):
    n, e = _calls(spark, d)
    return graphs.components(n.select("id"), e)


@query(with_("graph", recursive=True) + ", w(id) AS (SELECT 3 UNION SELECT e.t FROM w JOIN calls AS e ON e.f = w.id) SELECT id FROM w")
def reachability(spark, d):
    n, e = _calls(spark, d)
    return graphs.reachable(n, e, n.filter("id = 3"))


@query(with_("graph") + "SELECT id FROM n WHERE id IN (SELECT f FROM e WHERE edge_type = 'Imports' UNION SELECT t FROM e WHERE edge_type = 'Imports')")
def edge_filter(spark, d):
    n, e = _all(spark, d)
    return graphs.by_type(n, e, "Imports")[0].select("id")


@query(with_("graph") + "SELECT f AS \"from\", t AS \"to\", weight FROM e WHERE f IN (SELECT id FROM n WHERE component < 3) AND t IN (SELECT id FROM n WHERE component < 3)")
def dangling_edges(spark, d):
    n, e = _all(spark, d)
    return graphs.without_dangling(e, n.filter("component < 3")).select("from", "to", "weight")


@query(with_("graph") + "SELECT f AS \"from\", t AS \"to\", edge_type FROM e ORDER BY CASE edge_type WHEN 'Inherits' THEN 1 WHEN 'Uses' THEN 2 WHEN 'Implements' THEN 3 WHEN 'Calls' THEN 4 ELSE 5 END, f, t LIMIT 40")
def edge_budget(spark, d):
    return graphs.edge_budget(_all(spark, d)[1], 40).select("from", "to", "edge_type")


@query(with_("graph") + "SELECT a.component AS from_component, b.component AS to_component, sum(weight)::BIGINT AS weight, count(*) AS edges FROM e JOIN n AS a ON a.id = f JOIN n AS b ON b.id = t WHERE a.component <> b.component GROUP BY 1, 2")
def component_edges(spark, d):
    n, e = _all(spark, d)
    return graphs.component_edges(e, n)


@query(with_("graph") + "SELECT component, count(*) AS nodes, sum(coalesce(o, 0))::BIGINT AS out_edges, max(coalesce(o, 0))::BIGINT AS most FROM n LEFT JOIN (SELECT f AS id, count(*) AS o FROM e GROUP BY f) USING (id) GROUP BY component")
def component_metrics(spark, d):
    n, e = _all(spark, d)
    out = e.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("o"))
    return n.join(out, "id", "left").na.fill(0, ["o"]).groupBy("component").agg(F.count("*").alias("nodes"), F.sum("o").alias("out_edges"), F.max("o").alias("most"))


@query(with_("graph", recursive=True) + """, w(id) AS (SELECT id FROM n WHERE component = 0 UNION SELECT e.t FROM w JOIN calls AS e ON e.f = w.id)
SELECT component, count(*) AS items, count(*) FILTER (id NOT IN (SELECT id FROM w)) AS dead, round(100.0 * count(*) FILTER (id NOT IN (SELECT id FROM w)) / count(*), 6) AS percent FROM n GROUP BY component""")
def dead_summary(spark, d):
    n, e = _calls(spark, d)
    live = graphs.reachable(n, e, n.filter("component = 0")).withColumn("live", F.lit(True))
    dead = F.count(F.when(F.col("live").isNull(), 1))
    return n.join(live, "id", "left").groupBy("component").agg(F.count("*").alias("items"), dead.alias("dead"), F.round(100.0 * dead / F.count("*"), 6).alias("percent"))


@query("SELECT s_suppkey AS path, round(0.35 * (s_suppkey % 100) + 0.30 * least(s_suppkey * 7, 1000) / 10 + 0.20 * 2 * least(s_nationkey, 50) + 0.15 * 100 * CASE WHEN s_acctbal > 5000 THEN 1.0 WHEN s_acctbal > 0 THEN 0.7 ELSE 0.4 END, 6) AS score FROM supplier")
def dead_score(spark, d):
    b = F.col("s_acctbal")
    confidence = F.when(b > 5000, "high").when(b > 0, "medium").otherwise("low")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.round(sc.dead_score(F.col("s_suppkey") % 100, F.col("s_suppkey") * 7, F.col("s_nationkey"), confidence), 6).alias("score"))


# --- joins by position


@query("SELECT event_id, user_id, symbol FROM (SELECT event_id, user_id, ts, value FROM events) AS a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS symbol FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) AS b USING (user_id, ts) WHERE symbol IS NOT NULL")
def symbol_asof(spark, d):
    e = table(spark, d, "events")
    signups = e.filter(F.col("event_type") == "signup").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("name"))
    return facts.as_of(e, signups, "user_id", "ts", "start", "name").filter(F.col("symbol").isNotNull())


@query("WITH s AS (SELECT user_id, min(ts) AS low, max(ts) AS high FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT event_id FROM events JOIN s USING (user_id) WHERE event_type = 'purchase' AND ts BETWEEN low AND high")
def span_range(spark, d):
    e = table(spark, d, "events")
    spans = e.filter(F.col("event_type") == "error").groupBy("user_id").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    return facts.in_span(e.filter(F.col("event_type") == "purchase"), spans, "user_id", "ts", "low", "high").select("event_id")


# --- lint, coverage, gates


@query("""SELECT user_id AS file, count(*) AS violations, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'click') AS warnings, (user_id + 10)::BIGINT AS sloc, round(count(*) / (user_id + 10), 6) AS density,
  round(least(10 * count(*) / (user_id + 10), 10.0), 6) AS enforcement_score, count(*) * 300 AS fix_seconds FROM events GROUP BY user_id""")
def lint_density(spark, d):
    e = F.col("event_type")
    rows = table(spark, d, "events").select(F.col("user_id").alias("file"), F.when(e == "error", "error").when(e == "click", "warning").otherwise("note").alias("severity"), (F.col("user_id") + 10).alias("sloc"))
    return facts.lint_hotspots(rows)


@query("SELECT event_type AS lint, count(*) AS found FROM events GROUP BY 1 ORDER BY found DESC, lint LIMIT 10")
def top_lints(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("lint")).agg(F.count("*").alias("found")).orderBy(F.desc("found"), "lint").limit(10)


@query(with_("functions", "violations", "comments", "debts") + """SELECT *, violations = 0 AS passed FROM (SELECT 'complexity' AS "check", count(*) AS violations FROM violations WHERE severity = 'error' UNION ALL SELECT 'satd', count(*) FROM debts WHERE severity IN ('High', 'Critical') UNION ALL SELECT 'empty', count(*) FROM documents WHERE text = '')""")
def quality_gate(spark, d):
    return facts.gate(
        ("complexity", facts.violations(roles.functions(spark, d)).filter("severity = 'error'")),
        ("satd", _debts(spark, d).filter(F.col("severity").isin("High", "Critical"))),
        ("empty", table(spark, d, "documents").filter(F.col("text") == "")),
    )


@query(with_("functions") + """SELECT round(stddev_pop(cyclomatic) / avg(cyclomatic) * 100, 6) AS cv, stddev_pop(cyclomatic) / avg(cyclomatic) * 100 >= 30 AS cv_ok, (SELECT round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) FROM (SELECT count(*) AS c FROM functions GROUP BY cyclomatic)) AS entropy,
  (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) >= 2 FROM (SELECT count(*) AS c FROM functions GROUP BY cyclomatic)) AS entropy_ok FROM functions""")
def qa_verification(spark, d):
    f = roles.functions(spark, d)
    cv = f.agg(stats.coefficient_of_variation("cyclomatic").alias("v"))
    h = f.groupBy("cyclomatic").agg(F.count("*").alias("c")).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    return cv.crossJoin(h).select(F.round("v", 6).alias("cv"), (F.col("v") >= 30).alias("cv_ok"), F.round("h", 6).alias("entropy"), (F.col("h") >= 2).alias("entropy_ok"))  # one row each


def _hits(flag: str | None = None):
    def rows(spark, d):
        t = table(spark, d, "lineitem")
        t = t.filter(F.col("l_linestatus") == flag) if flag else t
        return t.select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("line"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("hits"))

    return rows


_COVER = "SELECT l_suppkey AS path, count(*) FILTER (l_returnflag <> 'R') AS covered, count(*) AS total, round(100 * count(*) FILTER (l_returnflag <> 'R') / count(*), 6) AS percent FROM lineitem"


@query(_COVER + " GROUP BY 1")
def coverage_aggregate(spark, d):
    return facts.coverage(_hits()(spark, d))


@query(f"WITH a AS ({_COVER} WHERE l_linestatus = 'F' GROUP BY 1), b AS ({_COVER} WHERE l_linestatus = 'O' GROUP BY 1) SELECT path, a.percent AS before, b.percent AS after, round(coalesce(b.percent, 0) - coalesce(a.percent, 0), 6) AS delta FROM a FULL JOIN b USING (path)")
def coverage_delta(spark, d):
    return facts.coverage_delta(_hits("F")(spark, d), _hits("O")(spark, d))


@query("""SELECT l_suppkey AS path, round(greatest(0.0, 100 - greatest(0.0, least(avg(l_quantity) - 10, 20.0)) - greatest(0.0, least(avg(l_discount) * 100, 15.0)) - greatest(0.0, least(avg(l_tax) * 100, 15.0)) - greatest(0.0, least((avg(l_linenumber) - 3) * 5, 20.0))), 6) AS health
  FROM lineitem GROUP BY 1""")
def health_score(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("path")).agg(F.round(sc.health_score(F.avg("l_quantity"), F.avg("l_discount"), F.avg("l_tax"), F.avg("l_linenumber")), 6).alias("health"))


@query("""SELECT (l_linenumber - 1)::INT AS growth, ['O(1)', 'O(log n)', 'O(n)', 'O(n log n)', 'O(n^2)', 'O(n^3)', 'O(2^n)', 'O(n!)'][l_linenumber] AS name, count(*) AS functions FROM lineitem GROUP BY 1, 2""")
def bigo_distribution(spark, d):
    k = (F.col("l_linenumber") - 1).cast("int")
    return table(spark, d, "lineitem").groupBy(k.alias("growth"), sc.growth_name(k).alias("name")).agg(F.count("*").alias("functions"))


@query("SELECT s_suppkey AS path, round(greatest(0.0, 1 - 0.3 * (s_suppkey % 3) - 0.1 * (s_suppkey % 4) - 0.02 * (s_suppkey % 5)), 6)::DOUBLE AS quality FROM supplier")
def makefile_quality(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("path"), F.round(sc.makefile_quality(k % 3, k % 4, k % 5), 6).alias("quality"))


@query("""WITH r AS (SELECT l_linenumber AS a, p_size % 5 AS b, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT *, CASE WHEN a >= 1 AND b > 1 THEN ln(a) / ln(b) END AS x FROM r), p AS (SELECT *, CASE WHEN abs(x - round(x)) < 1e-9 THEN round(x) ELSE ceil(x) END::INT AS p FROM e)
SELECT CASE WHEN x IS NULL OR k = 2 THEN 'none' WHEN k = 1 AND abs(x - 1) < 0.01 THEN 'O(n log n)' WHEN k = 1 AND x < 1 THEN 'O(n)' WHEN p = 0 THEN 'O(log n)' WHEN p = 1 THEN 'O(n)' ELSE 'O(n^' || p || ')' END AS growth, count(*) AS functions FROM p GROUP BY 1""")
def master_theorem(spark, d):
    r = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    work = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    b = F.col("p_size") % 5
    growth = sc.master_theorem(F.col("l_linenumber"), F.when(b > 1, b), work)
    return r.groupBy(F.coalesce(growth, F.lit("none")).alias("growth")).agg(F.count("*").alias("functions"))


@query(with_("graph", recursive=True) + """, u AS (SELECT f, t FROM e UNION SELECT t, f FROM e), w(id, c) AS (SELECT id, id FROM n UNION SELECT u.t, w.c FROM w JOIN u ON u.f = w.id)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, count(DISTINCT c)::BIGINT AS components, max(size)::BIGINT AS largest FROM (SELECT c, count(*) AS size FROM (SELECT id, min(c) AS c FROM w GROUP BY id) GROUP BY c)""")
def graph_components(spark, d):
    return graphs.component_totals(*_all(spark, d))


@query("SELECT p_partkey AS path, round((p_size + 10) * log2(p_size), 6) AS volume, round(p_size / 4 * 10 / (p_size / 2), 6) AS difficulty FROM part")
def halstead(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.round(sc.halstead_volume(s, F.lit(10), s / 2, s / 2), 6).alias("volume"), F.round(sc.halstead_difficulty(F.lit(10), s / 2, s / 2), 6).alias("difficulty"))


@query("""WITH s AS (SELECT source, doc_id AS name, (doc_id % 10) / 10 AS score, n_chars // 4 AS tokens FROM documents), r AS (SELECT *, sum(least(tokens, 500)) OVER (PARTITION BY source ORDER BY score DESC, name ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM s WHERE score > 0.3)
SELECT source, name, running FROM r WHERE running <= 2000""")
def token_budget(spark, d):
    s = table(spark, d, "documents").select("source", F.col("doc_id").alias("name"), (F.col("doc_id") % 10 / 10).alias("score"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return facts.token_budget(s, 2000, 500, "source").select("source", "name", "running")


def queries() -> dict:
    from plumbline.plans import code_catalogue, fragment_catalogue, history_catalogue, program_catalogue, project_catalogue  # noqa: F401  add their queries

    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
