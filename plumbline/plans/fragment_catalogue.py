"""Named queries on fragments of code and their clones, each with its SQL twin.

Orders and their items are written out as Rust source, a customer's orders as
a file: strings and comments hold braces and comment marks, blocks are nested,
and names, numbers and statements follow the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import clones, fragments, syntax
from plumbline.plans.catalogue import query
from plumbline.session import cut, table
from plumbline.sources import lexer


def source_files(spark, d) -> DataFrame:
    """(path, language, text): a customer's orders as functions."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("priority"))
    per_cent = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    long_ = lambda c: F.col(c).cast("long").alias(c)
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_returnflag", "l_linestatus", long_("l_partkey"), long_("l_suppkey"), long_("l_quantity"), per_cent("l_tax"), per_cent("l_discount"))
    # orders are small on disk only: sent to all, they would pass through the driver
    items = i.hint("merge").join(o.select("k", "path"), "k").select("path", "k", F.struct(*i.columns[1:]).alias("item"), F.lit(None).cast("string").alias("priority"))
    heads = o.select("path", "k", F.lit(None).cast(items.schema["item"].dataType).alias("item"), "priority")

    def lines(x: Column) -> Column:
        it = x["item"]
        flag, part, supplier, quantity = it["l_returnflag"], it["l_partkey"], it["l_suppkey"], it["l_quantity"]
        line = lambda num, of, sub, text: F.struct(x["k"].alias("k"), num.alias("num"), of.alias("of"), F.lit(sub).alias("sub"), text.alias("text"))
        own = lambda sub, *parts: line(it["l_linenumber"], F.concat_ws(" ", flag, part.cast("string"), supplier.cast("string"), quantity.cast("string")), sub, say(*parts))
        assign = F.array(own(0, "    let qty_", part, " = ", quantity, " * rate_", supplier, "; /* ", it["l_linestatus"], " } */"))
        branch = F.array(own(0, "    if back_", part, " > ", quantity, " && limit < ", it["l_linenumber"], " {"), own(1, '        log("part ', part, ' // \\"', it["l_linestatus"], '\\" {");'), own(2, "    }"))
        add = F.array(own(0, "    total_", supplier, " += fee(part_", part, ", ", it["l_tax"], ") - ", it["l_discount"], ";"))
        frame = F.array(line(F.lit(0), F.lit(""), 0, say("pub fn order_", x["k"], "(limit: i32) -> i32 { // {", x["priority"], "}")), line(F.lit(99), F.lit(""), 0, F.lit("}")))
        return F.when(it.isNull(), frame).when(flag == "A", assign).when(flag == "R", branch).otherwise(add)

    # items are dealt as numbers and become text in their file's row
    every = items.unionByName(heads).groupBy("path").agg(F.collect_list(F.struct("k", "item", "priority")).alias("x"))
    text = F.array_join(F.sort_array(F.flatten(F.transform("x", lines)))["text"], "\n")
    return every.select("path", F.lit("rust").alias("language"), text.alias("text"))


_LINES = r"""items AS (
  SELECT l_orderkey AS k, l_linenumber AS num, l_returnflag AS flag, l_linestatus AS st, l_partkey::VARCHAR AS p, l_suppkey::VARCHAR AS s, l_quantity::BIGINT::VARCHAR AS q, round(l_tax * 100)::BIGINT::VARCHAR AS tax, round(l_discount * 100)::BIGINT::VARCHAR AS disc FROM lineitem),
body AS (
  SELECT k, num, flag || ' ' || p || ' ' || s || ' ' || q AS ord, 0 AS sub, '    let qty_' || p || ' = ' || q || ' * rate_' || s || '; /* ' || st || ' } */' AS text FROM items WHERE flag = 'A'
  UNION ALL SELECT k, num, flag || ' ' || p || ' ' || s || ' ' || q, 0, '    if back_' || p || ' > ' || q || ' && limit < ' || num || ' {' FROM items WHERE flag = 'R'
  UNION ALL SELECT k, num, flag || ' ' || p || ' ' || s || ' ' || q, 1, '        log("part ' || p || ' // \"' || st || '\" {");' FROM items WHERE flag = 'R'
  UNION ALL SELECT k, num, flag || ' ' || p || ' ' || s || ' ' || q, 2, '    }' FROM items WHERE flag = 'R'
  UNION ALL SELECT k, num, flag || ' ' || p || ' ' || s || ' ' || q, 0, '    total_' || s || ' += fee(part_' || p || ', ' || tax || ') - ' || disc || ';' FROM items WHERE flag NOT IN ('A', 'R')),
src AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY k, num, ord, sub, text)::INT AS line, text FROM (
    SELECT o_custkey AS path, k, num, ord, sub, text FROM body JOIN orders ON k = o_orderkey
    UNION ALL SELECT o_custkey, o_orderkey, 0, '', 0, 'pub fn order_' || o_orderkey || '(limit: i32) -> i32 { // {' || o_orderpriority || '}' FROM orders
    UNION ALL SELECT o_custkey, o_orderkey, 99, '', 0, '}' FROM orders)),
clean AS (SELECT path, line, text, regexp_replace(text, '"(?:[^"\\]|\\.)*"|//.*|/\*.*?\*/', '', 'g') AS c FROM src),
delta AS (SELECT *, len(c) - len(replace(c, '{', '')) - (len(c) - len(replace(c, '}', ''))) AS d FROM clean),
depth AS (SELECT *, sum(d) OVER (PARTITION BY path ORDER BY line) AS after FROM delta)"""


def _spans(name: str, start: str) -> str:
    return f"""{name} AS (
  SELECT s.path, s.line AS start_line, min(e.line) AS end_line FROM depth s JOIN depth e ON s.path = e.path AND e.line > s.line AND e.d < 0 AND e.after = s.after - s.d
  WHERE s.d > 0 AND ({start}) GROUP BY s.path, s.line)"""


_TOKEN = r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|[0-9][0-9A-Za-z_.]*|[A-Za-z_][0-9A-Za-z_]*|==|!=|<=|>=|&&|\|\||<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|->|=>|\.\.|[()\[\]{},;.]|[-+*/%=<>!&|^?@]"""
_FRAGMENTS = (
    _LINES
    + ",\n"
    + _spans("fn", "contains(trim(s.text), 'fn ') AND contains(s.text, '(')")
    + rf""",
span_ AS (SELECT path, start_line, end_line, 0 AS whole FROM fn WHERE end_line > start_line UNION ALL SELECT path, 1, max(line), 1 FROM src GROUP BY path),
tok AS (
  SELECT path, start_line, end_line, whole, line, i, list[i] AS t FROM (
    SELECT path, start_line, end_line, whole, line, list, unnest(range(1, len(list) + 1)) AS i FROM (
      SELECT span_.path, start_line, end_line, whole, line, regexp_extract_all(text, '{_TOKEN}') AS list FROM span_ JOIN src ON span_.path = src.path AND line BETWEEN start_line AND end_line))
  WHERE NOT (list[i] LIKE '//%' OR list[i] LIKE '/*%')),
kind AS (
  SELECT *, CASE WHEN regexp_matches(t, '^["0-9]') THEN 'l' WHEN t IN ({", ".join(f"'{k}'" for k in lexer.KEYWORDS["rust"].split())}) THEN 'k' WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'i' ELSE 'o' END AS kind FROM tok),
named AS (
  SELECT path, start_line, end_line, whole, t, 'VAR_' || row_number() OVER (PARTITION BY path, start_line, end_line, whole ORDER BY min(line * 1000 + i)) AS v FROM kind WHERE kind = 'i' GROUP BY path, start_line, end_line, whole, t),
cut AS (
  SELECT path || ':' || start_line || ':' || end_line AS id, path, start_line, end_line, whole, list(t ORDER BY line, i) AS raw, list(CASE kind WHEN 'l' THEN 'LITERAL' WHEN 'i' THEN v ELSE t END ORDER BY line, i) AS norm
  FROM kind LEFT JOIN named USING (path, start_line, end_line, whole, t) GROUP BY path, start_line, end_line, whole HAVING count(*) >= 50),
frag AS MATERIALIZED (SELECT * FROM cut WHERE whole = 0 OR path NOT IN (SELECT path FROM cut WHERE whole = 0))"""
)


@query(f"WITH {_LINES},\n{_spans('b', '''contains(s.text, 'fn ') OR (s.text LIKE '%{' AND trim(s.text) NOT LIKE '{%')''')} SELECT path, start_line, end_line FROM b WHERE end_line > start_line")
def code_blocks(spark, d):
    return fragments.spans(lexer.lexed(source_files(spark, d)), fragments.starts_block(F.col("text")))


def _fragments(spark, d) -> DataFrame:
    return fragments.of_files(lexer.lexed_files(source_files(spark, d)))


@query(f"WITH {_FRAGMENTS} SELECT id, start_line, end_line, len(norm)::INT AS tokens, array_to_string(norm, ' ') AS normalised FROM frag")
def code_fragments(spark, d):
    return _fragments(spark, d).select("id", "start_line", "end_line", F.size("tokens").alias("tokens"), F.array_join(fragments.renamed(F.col("tokens")), " ").alias("normalised"))


def _grouped(sets: str, rounds: int = 12) -> str:
    """CTEs from fragments' (id, list) to their pairs and groups: inverted index, then labels spread over the pairs."""
    spread = ",\n".join(
        f"l{k} AS MATERIALIZED (SELECT l.id, least(min(l.g), coalesce(min(n.g), min(l.g))) AS g FROM l{k - 1} l LEFT JOIN both_ways b ON b.a = l.id LEFT JOIN l{k - 1} n ON n.id = b.b GROUP BY l.id)" for k in range(1, rounds + 1)
    )
    return rf"""sh AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len({sets}) - 3), lambda i: {sets}[i] || ' ' || {sets}[i + 1] || ' ' || {sets}[i + 2] || ' ' || {sets}[i + 3] || ' ' || {sets}[i + 4]))) AS s FROM frag WHERE len({sets}) >= 5),
firsts AS MATERIALIZED (SELECT s, min(id) AS id FROM sh GROUP BY s),
numbered AS MATERIALIZED (SELECT id, s, row_number() OVER (ORDER BY id) AS k FROM firsts),
posts AS MATERIALIZED (SELECT k, len(s) AS n, hash(x) AS x FROM (SELECT k, s, unnest(s) AS x FROM numbered)),
shared AS (SELECT p.k AS a, q.k AS b, p.n AS n, q.n AS m, count(*) AS c FROM posts p JOIN posts q ON p.x = q.x AND p.k < q.k AND least(p.n, q.n) >= 0.7 * greatest(p.n, q.n) - 1e-9 GROUP BY p.k, q.k, p.n, q.n),
pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b, c / (n + m - c) AS similarity FROM shared JOIN numbered x ON x.k = shared.a JOIN numbered y ON y.k = shared.b WHERE c / (n + m - c) >= 0.7 - 1e-12),
both_ways AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
l0 AS MATERIALIZED (SELECT id, id AS g FROM firsts),
{spread},
grouped AS (SELECT sh.id, l.g AS "group" FROM sh JOIN firsts USING (s) JOIN l{rounds} l ON l.id = firsts.id),
members AS (SELECT * FROM grouped WHERE "group" IN (SELECT "group" FROM grouped GROUP BY "group" HAVING count(*) > 1))"""


def _told(spark, d) -> tuple[DataFrame, DataFrame]:
    """What ``fragments.told`` says of all fragments, and the different ones among them."""
    return fragments.told(_fragments(spark, d))


def _grouped_fragments(spark, d) -> tuple[DataFrame, DataFrame]:
    """All fragments, and with their groups those in groups of two or more."""
    each, firsts = _told(spark, d)
    return each, clones.of_copies(each, firsts, clones.groups_of(firsts))


_CLONES = f"WITH {_FRAGMENTS},\n{_grouped('norm')}\n"


@query(_CLONES + "SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def fragment_pairs(spark, d):
    return clones.similar_pairs(_told(spark, d)[1]).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_CLONES + """SELECT "group", CASE WHEN count(DISTINCT raw) = 1 THEN 'exact' WHEN count(DISTINCT norm) = 1 THEN 'renamed' ELSE 'similar' END AS kind, count(*) AS fragments, count(DISTINCT path) AS files,
  sum(end_line - start_line + 1)::BIGINT AS lines, sum(len(norm))::BIGINT AS tokens FROM members JOIN frag USING (id) GROUP BY "group\"""")
def fragment_clones(spark, d):
    return fragments.totals_of(_grouped_fragments(spark, d)[1])


@query(_CLONES + """, per AS (SELECT "group", count(*) AS n, sum(end_line - start_line + 1) AS lines FROM members JOIN frag USING (id) GROUP BY "group")
SELECT (SELECT count(DISTINCT path) FROM src) AS files, (SELECT count(*) FROM frag) AS fragments, (SELECT sum(end_line - start_line + 1) FROM frag)::BIGINT AS total_lines, count(*) AS clone_groups, max(n) AS largest_group, sum(lines)::BIGINT AS duplicate_lines,
  round(sum(lines) / (SELECT sum(end_line - start_line + 1) FROM frag), 6) AS duplication_ratio FROM per""")
def fragment_summary(spark, d):
    each, grouped = _grouped_fragments(spark, d)
    return fragments.summary_of(grouped, each, table(spark, d, "orders").select("o_custkey").distinct())


@query(_CLONES + """SELECT path, sum(end_line - start_line + 1)::BIGINT AS duplicate_lines, count(DISTINCT "group") AS clone_groups, round(greatest(ln(sum(end_line - start_line + 1)), 1.0) * sqrt(count(DISTINCT "group")), 6) AS severity
FROM members JOIN frag USING (id) GROUP BY path ORDER BY severity DESC, path LIMIT 10""")
def fragment_hotspots(spark, d):
    return fragments.hotspots_of(_grouped_fragments(spark, d)[1])


def _words(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", r"\s+").alias("tokens"))


_WORDS = r"WITH frag AS (SELECT doc_id AS id, regexp_split_to_array(text, '[\s\x0B]+') AS words FROM documents WHERE text IS NOT NULL)," + _grouped("words")


@query(_WORDS + " SELECT a, b, similarity FROM pairs")
def minhash_pairs(spark, d):
    """Pairs of documents with an exact Jaccard of 0.7 or more over five words; the name is older than the exact join."""
    return clones.similar_pairs(_words(spark, d))


@query(_WORDS + ' SELECT id, "group" FROM members')
def clone_groups(spark, d):
    return clones.clone_groups(_words(spark, d))


@query()
def minhash_bands(spark, d):
    """Buckets of the 20 bands of 10 MinHash values in which different documents meet."""
    return clones.band_buckets(_words(spark, d))


@query(f"WITH {_LINES},\n{_spans('fn', '''contains(s.text, 'fn ')''')}" + r""", p AS (
  SELECT fn.path, fn.start_line, fn.end_line, (CASE WHEN regexp_matches(c, '\bif\b') THEN 1 ELSE 0 END) + (len(c) - len(replace(c, '&&', ''))) // 2 AS points, CASE WHEN regexp_matches(c, '\bif\b') THEN 1 ELSE 0 END AS nest
  FROM fn JOIN clean ON clean.path = fn.path AND line BETWEEN start_line AND end_line)
SELECT path, start_line AS line, end_line AS "end", (1 + sum(points))::INT AS cyclomatic, (1 + sum(points))::INT AS cognitive, max(nest)::INT AS nesting_max FROM p GROUP BY path, start_line, end_line""")
def syntax_complexity(spark, d):
    return syntax.complexity(lexer.lexed_files(source_files(spark, d).withColumn("path", F.col("path").cast("string")))).select(F.col("path").cast("long").alias("path"), "line", "end", "cyclomatic", "cognitive", "nesting_max")
