"""Named queries on a program's dependency graph, ranges of its lines and what is live in it, each with its SQL twin.

The program is written out of the tables: nations are traits, suppliers are
structs that implement their nation's, parts are functions that call helpers by
size, orders are functions that call parts, make suppliers or send messages,
and main calls the urgent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import centrality, graphs, program, ranges
from plumbline.plans import roles
from plumbline.plans.catalogue import _calls, query
from plumbline.plans.roles import with_
from plumbline.session import cut, table
from plumbline.sources import lexer


def project_files(spark, d) -> DataFrame:
    """(path, language, text) of the program's files."""
    n = lambda c: F.col(c).cast("long").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lit = lambda v: v if not isinstance(v, (str, int)) else F.lit(v)

    def rows(df, path, k, num, of, *texts):
        return df.select(lit(path).alias("path"), lit(k).cast("long").alias("k"), lit(num).cast("int").alias("num"), lit(of).alias("of"), F.posexplode(F.array(*texts)).alias("sub", "text"))

    nation, supplier, part = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "part")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    size, sid, nid, order = n("p_size"), n("s_suppkey"), n("s_nationkey"), n("o_orderkey")
    sizes = part.select("p_size").distinct()
    every = [
        rows(nation, "src/nation.rs", F.col("n_nationkey"), 0, "", say("pub trait Nation_", n("n_nationkey"), " {"), F.lit("    fn ship_0(&self);"), F.lit("}")),
        rows(supplier, say("src/supplier_", sid, ".rs"), 0, 0, "", say("pub struct Supplier_", sid, " { balance: i32 }"), say("impl Nation_", nid, " for Supplier_", sid, " {"), say("    fn ship_", (F.col("s_suppkey") % 3).cast("string"), "(&self) {"), say("        helper_", (1 + F.col("s_suppkey") % 50).cast("string"), "();"), F.lit("    }"), F.lit("}")),
        rows(part, say("src/part_", (F.col("p_partkey") % 100).cast("string"), ".rs"), F.col("p_partkey"), 0, "", say("fn price_", n("p_partkey"), "(limit: i32) -> i32 {"), say("    helper_", size, "();"), F.lit("}")),
        rows(sizes, "src/util.rs", F.col("p_size"), 0, "", say("pub fn helper_", size, "() {"), say("    helper_", F.floor(F.col("p_size") / 2).cast("string"), "();"), F.lit("}")),
        rows(orders.limit(1), "src/main.rs", -1, 0, "", F.lit("fn main() {")),
        rows(orders.filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1")), "src/main.rs", F.col("o_orderkey"), 0, "", say("    order_", order, "(1);")),
        rows(orders.agg((F.max("o_orderkey") + 1).alias("k")).filter("k is not null"), "src/main.rs", F.col("k"), 0, "", F.lit("}")),
    ]
    lines = every[0]
    for more in every[1:]:
        lines = lines.unionByName(more)
    files = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", "num", "of", "sub", "text"))).alias("x"))
    return files.select("path", F.lit("rust").alias("language"), F.array_join("x.text", "\n").alias("text")).unionByName(_customer_files(spark, d))


def _customer_files(spark, d) -> DataFrame:
    """(path, language, text): a file for each customer with orders. Items are dealt as numbers and become text in their file's row."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", ((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("2")).alias("exported"))
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_returnflag", *[F.col(c).cast("long").alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    item = i.hint("merge").join(orders.select("k", "o_custkey"), "k").select("o_custkey", "k", F.struct(*i.columns[1:]).alias("item"), F.lit(None).cast("boolean").alias("exported"))
    head = orders.select("o_custkey", "k", F.lit(None).cast(item.schema["item"].dataType).alias("item"), "exported")

    def line(k, num, of, sub, text) -> Column:
        return F.struct(k.cast("long").alias("k"), num.cast("int").alias("num"), of.alias("of"), F.lit(sub).alias("sub"), text.alias("text"))

    def lines(x: Column) -> Column:
        k, it, none = x["k"], x["item"], F.lit("")
        flag, part, supplier = it["l_returnflag"], it["l_partkey"], it["l_suppkey"]
        body = F.when(flag == "A", say("    price_", part, "(limit); // helper_1() in words")).when(flag == "R", say("    let s = Supplier_", supplier, " { balance: ", it["l_quantity"], " };")).otherwise(say("    any.ship_", it["l_linenumber"] % 3, '("price_1(");'))
        frame = F.array(line(k, F.lit(1), none, 0, say("pub fn order_", k, "(limit: i32) {")), line(k, F.lit(99), none, 0, F.lit("}")))
        marks = F.array(line(k, F.lit(0), none, 0, F.lit("#[no_mangle]")), line(k, F.lit(0), none, 1, F.lit("// exported")))
        own = F.array(line(k, it["l_linenumber"] + 1, F.concat_ws(" ", part.cast("string"), supplier.cast("string")), 0, body))
        return F.when(it.isNotNull(), own).when(x["exported"], F.concat(marks, frame)).otherwise(frame)

    used = F.array_distinct(F.transform(F.filter("x", lambda x: x["item"]["l_returnflag"] == "R"), lambda x: x["item"]["l_suppkey"]))
    uses = F.transform(used, lambda s: line(F.lit(-1), F.lit(0), s.cast("string"), 0, say("use crate::supplier_", s, "::Supplier_", s, ";")))
    debug = F.array(line(F.lit(-2), F.lit(0), F.lit(""), 0, say("use std::fmt::Debug_", F.col("o_custkey") % 5, ";")))
    text = F.array_join(F.sort_array(F.concat(debug, uses, F.flatten(F.transform("x", lines))))["text"], "\n")
    every = item.unionByName(head).groupBy("o_custkey").agg(F.collect_list(F.struct("k", "item", "exported")).alias("x"))
    return every.select(say("src/customer_", F.col("o_custkey"), ".rs").alias("path"), F.lit("rust").alias("language"), text.alias("text"))


def _lexed(spark, d) -> DataFrame:
    return lexer.lexed(project_files(spark, d))


_SRC = r"""o AS (SELECT *, 'src/customer_' || o_custkey || '.rs' AS path FROM orders),
i AS (SELECT l.*, o.path, o.o_custkey FROM lineitem l JOIN o ON l_orderkey = o_orderkey),
sup AS (SELECT *, 'src/supplier_' || s_suppkey || '.rs' AS path FROM supplier),
every AS (
  SELECT 'src/nation.rs' AS path, n_nationkey AS k, 0 AS num, '' AS ord, 0 AS sub, 'pub trait Nation_' || n_nationkey || ' {' AS text FROM nation
  UNION ALL SELECT 'src/nation.rs', n_nationkey, 0, '', 1, '    fn ship_0(&self);' FROM nation UNION ALL SELECT 'src/nation.rs', n_nationkey, 0, '', 2, '}' FROM nation
  UNION ALL SELECT path, 0, 0, '', 0, 'pub struct Supplier_' || s_suppkey || ' { balance: i32 }' FROM sup
  UNION ALL SELECT path, 0, 0, '', 1, 'impl Nation_' || s_nationkey || ' for Supplier_' || s_suppkey || ' {' FROM sup
  UNION ALL SELECT path, 0, 0, '', 2, '    fn ship_' || (s_suppkey % 3) || '(&self) {' FROM sup
  UNION ALL SELECT path, 0, 0, '', 3, '        helper_' || (1 + s_suppkey % 50) || '();' FROM sup
  UNION ALL SELECT path, 0, 0, '', 4, '    }' FROM sup UNION ALL SELECT path, 0, 0, '', 5, '}' FROM sup
  UNION ALL SELECT 'src/part_' || (p_partkey % 100) || '.rs', p_partkey, 0, '', 0, 'fn price_' || p_partkey || '(limit: i32) -> i32 {' FROM part
  UNION ALL SELECT 'src/part_' || (p_partkey % 100) || '.rs', p_partkey, 0, '', 1, '    helper_' || p_size || '();' FROM part
  UNION ALL SELECT 'src/part_' || (p_partkey % 100) || '.rs', p_partkey, 0, '', 2, '}' FROM part
  UNION ALL SELECT 'src/util.rs', p_size, 0, '', s, CASE s WHEN 0 THEN 'pub fn helper_' || p_size || '() {' WHEN 1 THEN '    helper_' || (p_size // 2) || '();' ELSE '}' END FROM (SELECT DISTINCT p_size FROM part), (SELECT unnest([0, 1, 2]) AS s)
  UNION ALL SELECT DISTINCT path, -1, 0, l_suppkey::VARCHAR, 0, 'use crate::supplier_' || l_suppkey || '::Supplier_' || l_suppkey || ';' FROM i WHERE l_returnflag = 'R'
  UNION ALL SELECT DISTINCT path, -2, 0, '', 0, 'use std::fmt::Debug_' || (o_custkey % 5) || ';' FROM o
  UNION ALL SELECT path, o_orderkey, 0, '', 0, '#[no_mangle]' FROM o WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '2%'
  UNION ALL SELECT path, o_orderkey, 0, '', 1, '// exported' FROM o WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '2%'
  UNION ALL SELECT path, o_orderkey, 1, '', 0, 'pub fn order_' || o_orderkey || '(limit: i32) {' FROM o
  UNION ALL SELECT path, l_orderkey, l_linenumber + 1, l_partkey || ' ' || l_suppkey, 0, CASE l_returnflag WHEN 'A' THEN '    price_' || l_partkey || '(limit); // helper_1() in words'
    WHEN 'R' THEN '    let s = Supplier_' || l_suppkey || ' { balance: ' || l_quantity::BIGINT || ' };' ELSE '    any.ship_' || (l_linenumber % 3) || '("price_1(");' END FROM i
  UNION ALL SELECT path, o_orderkey, 99, '', 0, '}' FROM o
  UNION ALL SELECT 'src/main.rs', -1, 0, '', 0, 'fn main() {' UNION ALL SELECT 'src/main.rs', o_orderkey, 0, '', 0, '    order_' || o_orderkey || '(1);' FROM o WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%'
  UNION ALL SELECT 'src/main.rs', max(o_orderkey) + 1, 0, '', 0, '}' FROM o),
src AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY k, num, ord, sub, text)::INT AS line, text FROM every),
clean AS MATERIALIZED (SELECT path, line, text, regexp_replace(text, '"[^"]*"|//.*', '', 'g') AS c, replace(replace(replace(path, '.rs', ''), '/', '_'), '.', '_') AS file FROM src),
struct_ AS (SELECT file || '::' || regexp_extract(c, 'struct (\w+)', 1) AS id, regexp_extract(c, 'struct (\w+)', 1) AS name, path, line FROM clean WHERE c LIKE '%struct %'),
trait_ AS (SELECT file || '::' || regexp_extract(c, 'trait (\w+)', 1) AS id, regexp_extract(c, 'trait (\w+)', 1) AS name, path, line FROM clean WHERE c LIKE '%trait %'),
impl_ AS (SELECT path, line, regexp_extract(c, '^impl (\w+) for (\w+)', 1) AS trait, regexp_extract(c, '^impl (\w+) for (\w+)', 2) AS name FROM clean WHERE c LIKE 'impl %'),
block AS (SELECT path, line, name AS owner FROM impl_ UNION ALL SELECT path, line, name FROM trait_),
delta AS (SELECT *, len(c) - len(replace(c, '{', '')) - (len(c) - len(replace(c, '}', ''))) AS d FROM clean),
depth AS MATERIALIZED (SELECT *, sum(d) OVER (PARTITION BY path ORDER BY line) AS after FROM delta),
named AS (SELECT path, line, file, regexp_extract(c, 'fn (\w+)', 1) AS name, c LIKE '%;' AS declared, d, after, lag(line) OVER (PARTITION BY path ORDER BY line) AS prior FROM depth WHERE c LIKE '%fn %'),
fn AS MATERIALIZED (
  SELECT n.path, n.line, n.name, n.declared, b.owner, n.file || CASE WHEN b.owner IS NULL THEN '' ELSE '::' || b.owner END || '::' || n.name AS id,
         CASE WHEN n.declared THEN n.line ELSE (SELECT min(e.line) FROM depth e WHERE e.path = n.path AND e.line > n.line AND e.d < 0 AND e.after = n.after - n.d) END AS last
  FROM named n LEFT JOIN block b ON b.path = n.path AND n.after - (CASE WHEN n.declared THEN 0 ELSE 1 END) = 1 AND b.line = (SELECT max(line) FROM block x WHERE x.path = n.path AND x.line < n.line)),
call AS MATERIALIZED (
  SELECT path, line, regexp_extract(c, '(^|[^.\w])(\w+)\(', 2) AS name FROM clean WHERE regexp_matches(c, '(^|[^.\w])(\w+)\(') AND NOT c LIKE '%fn %'),
inside AS MATERIALIZED (SELECT f.id AS caller, c.path, c.line, c.c FROM clean c JOIN fn f ON f.path = c.path AND NOT f.declared AND c.line BETWEEN f.line AND f.last),
called AS MATERIALIZED (
  SELECT i.caller AS f, coalesce(own.id, far.id) AS t FROM inside i JOIN call USING (path, line)
  LEFT JOIN (SELECT path, name, max_by(id, line) AS id FROM fn WHERE owner IS NULL GROUP BY path, name) own ON own.path = i.path AND own.name = call.name
  LEFT JOIN (SELECT name, max_by(id, path || lpad(line::VARCHAR, 9, '0')) AS id FROM fn WHERE owner IS NULL GROUP BY name) far ON far.name = call.name
  WHERE coalesce(own.id, far.id) IS NOT NULL),
used AS (SELECT file, replace(path_, '::', '_') AS other, path_, regexp_extract(path_, '(\w+)$', 1) AS last FROM (SELECT file, regexp_extract(c, '^use (.*);', 1) AS path_ FROM clean WHERE c LIKE 'use %')),
typed AS (SELECT name, max(id) AS id FROM (SELECT * FROM struct_ UNION ALL SELECT * FROM trait_) GROUP BY name),
known AS (SELECT u.file, coalesce(t.id, u.other) AS t, t.id IS NULL AS external, path_ FROM used u LEFT JOIN typed t ON t.name = u.last)"""


@query(f"WITH {_SRC}\n" + r"""SELECT id, max(label) AS label, max(node_type) AS node_type, max(line)::INT AS line_number FROM (
  SELECT id, name AS label, 'Class' AS node_type, line FROM struct_ UNION ALL SELECT id, name, 'Trait', line FROM trait_ UNION ALL SELECT id, name, 'Function', line FROM fn
  UNION ALL SELECT DISTINCT file, regexp_extract(path, '(\w+)\.rs$', 1), 'Module', 0 FROM clean UNION ALL SELECT t, path_, 'External', 0 FROM known WHERE external) GROUP BY id""")
def project_nodes(spark, d):
    return program.build(_lexed(spark, d), external=True)[0].select("id", "label", "node_type", "line_number")


@query(f"WITH {_SRC}\n" + """SELECT f AS "from", t AS "to", edge_type, count(*) AS weight FROM (
  SELECT file AS f, t, 'Imports' AS edge_type FROM known
  UNION ALL SELECT s.id, r.id, 'Inherits' FROM impl_ JOIN typed s ON s.name = impl_.name JOIN typed r ON r.name = impl_.trait
  UNION ALL SELECT f, t, 'Calls' FROM called) GROUP BY 1, 2, 3""")
def project_edges(spark, d):
    return program.build(_lexed(spark, d), external=True)[1]


def _rounds(n: int = 16) -> str:
    """The fixpoint's rounds, each from all that the one before has reached."""
    return ",\n".join(
        f"""r{k} AS MATERIALIZED (SELECT id, min(how) AS how FROM (
  SELECT id, how * 100 AS how FROM r{k - 1} UNION ALL SELECT t, 101 FROM called JOIN r{k - 1} ON f = r{k - 1}.id
  UNION ALL SELECT m.id, 102 FROM methods m WHERE m.type IN (SELECT type FROM news JOIN r{k - 1} ON caller = r{k - 1}.id) AND m.method IN (SELECT method FROM sends JOIN r{k - 1} ON caller = r{k - 1}.id)) GROUP BY id),
s{k} AS MATERIALIZED (SELECT id, CASE WHEN how IN (0, 100, 200) THEN how // 100 ELSE how - 100 END AS how FROM r{k})""".replace(f"FROM r{k - 1}", f"FROM s{k - 1}").replace(f"JOIN r{k - 1} ON", f"JOIN s{k - 1} ON").replace(f"= r{k - 1}.id", f"= s{k - 1}.id")
        for k in range(1, n + 1)
    )


@query(f"WITH {_SRC},\n" + r"""news AS MATERIALIZED (SELECT DISTINCT caller, regexp_extract(c, '(Supplier_\d+) \{', 1) AS type FROM inside WHERE regexp_matches(c, '= Supplier_\d+ \{')),
sends AS MATERIALIZED (SELECT DISTINCT caller, regexp_extract(c, '\.(\w+)\(', 1) AS method FROM inside WHERE regexp_matches(c, '\.\w+\(')),
methods AS MATERIALIZED (SELECT DISTINCT owner AS type, name AS method, id FROM fn WHERE owner IS NOT NULL AND NOT declared),
s0 AS MATERIALIZED (SELECT id, min(how) AS how FROM (
  SELECT id, 1 AS how FROM fn WHERE NOT declared AND (contains(name, 'main') OR path = 'src/main.rs')
  UNION ALL SELECT min_by(f.id, f.line), 0 FROM clean c JOIN fn f ON f.path = c.path AND f.line BETWEEN c.line AND c.line + 3 WHERE c.text LIKE '#[no_mangle]%' GROUP BY c.path, c.line) GROUP BY id),
""" + _rounds() + r""",
mentioned AS (SELECT name FROM call UNION SELECT method FROM sends)
SELECT f.id, CASE WHEN how IS NOT NULL THEN 'live' WHEN m.name IS NOT NULL THEN 'unknown' ELSE 'dead' END AS verdict,
  CASE how WHEN 0 THEN 'export' WHEN 1 THEN 'call' WHEN 2 THEN 'dispatch' ELSE CASE WHEN m.name IS NOT NULL THEN 'unreached' ELSE 'no references' END END AS evidence,
  (CASE WHEN how <= 1 THEN 0.95 WHEN how = 2 THEN 0.8 WHEN m.name IS NOT NULL THEN 0.6 ELSE 0.9 END)::DOUBLE AS confidence
FROM (SELECT id, max(name) AS name FROM fn WHERE NOT declared GROUP BY id) f LEFT JOIN s16 ON s16.id = f.id LEFT JOIN (SELECT DISTINCT name FROM mentioned) m ON m.name = f.name""")
def project_liveness(spark, d):
    return program.liveness(_lexed(spark, d))


@query(f"WITH {_SRC} SELECT i.trait, f.name AS method, f.owner AS type, f.id FROM fn f JOIN impl_ i ON i.path = f.path AND i.name = f.owner WHERE NOT f.declared")
def dispatch_table(spark, d):
    return program.dispatch_table(program.with_ids(program.items(_lexed(spark, d))))


@query("""WITH s AS (SELECT l_suppkey AS key, l_partkey AS a, l_partkey + (l_quantity::BIGINT * l_quantity::BIGINT * l_linenumber) % 700 AS b FROM lineitem),
p AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS at FROM lineitem)
SELECT p.key, p.at, max_by(a, a * 1000000 - b) AS "start", -max_by(-b, a * 1000000 - b) AS "end", count(*) AS depth FROM p JOIN (SELECT DISTINCT key, a, b FROM s) x ON x.key = p.key AND p.at BETWEEN a AND b GROUP BY p.key, p.at""")
def innermost_spans(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("at"), F.col("l_quantity").cast("long").alias("q"), "l_linenumber")
    spans = i.select("key", F.col("at").alias("start"), (F.col("at") + F.col("q") * F.col("q") * F.col("l_linenumber") % 700).alias("end"))
    return ranges.innermost(i, spans, "key", "at")


@query(f"WITH {_SRC}\n" + """SELECT b.path, b.line AS block_line, f.id, f.line FROM (SELECT path, line, owner, (SELECT min(e.line) FROM depth e WHERE e.path = block.path AND e.line > block.line AND e.d < 0 AND e.after = 0) AS last FROM block) b
JOIN fn f ON f.path = b.path AND f.line BETWEEN b.line AND b.last""")
def symbols_in_spans(spark, d):
    """The functions that start inside the blocks of types and traits."""
    found = program.with_ids(program.items(_lexed(spark, d)))
    found = cut(found)
    blocks = found.filter("kind in ('Impl', 'Trait')").select("path", F.col("line").alias("start"), "end")
    near = ranges.covering(found.filter("kind = 'Function'").select("path", "line", "id"), blocks)
    return near.select("path", F.col("start").alias("block_line"), "id", "line")


@query(f"WITH {_SRC} SELECT DISTINCT min_by(f.id, f.line) AS id FROM clean c JOIN fn f ON f.path = c.path AND f.line BETWEEN c.line AND c.line + 3 WHERE c.text LIKE '#[no_mangle]%' GROUP BY c.path, c.line")
def ffi_exports_by_range(spark, d):
    said = program.facts(_lexed(spark, d), "items", "mark")
    return program.exports(said, program.with_ids(program.items(said)))


@query(f"WITH {_SRC}\n" + """, f AS (SELECT DISTINCT id FROM fn WHERE NOT declared)
SELECT id, 'memory_safety' AS property, 'borrow_checker' AS method, 0.95::DOUBLE AS confidence FROM f UNION ALL SELECT id, 'thread_safety', 'type_system', 0.9::DOUBLE FROM f""")
def function_proofs(spark, d):
    return program.proofs_that(program.proofs(_lexed(spark, d)), least=0.9)


# --- centralities


def _levels(depth: int) -> str:
    """Nodes gn(id) and edges ge(f, t): shortest paths from every node by distance (f0, f1 ...), then what each owes back (b ...)."""
    forward = ["f0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS paths FROM gn)"]
    for k in range(1, depth + 1):
        earlier = " AND ".join(f"NOT EXISTS (SELECT 1 FROM f{j} o WHERE o.s = x.s AND o.id = x.id)" for j in range(k))
        forward.append(f"f{k} AS MATERIALIZED (SELECT s, id, paths FROM (SELECT s, t AS id, sum(paths) AS paths FROM f{k - 1} JOIN ge ON f = id GROUP BY s, t) x WHERE {earlier})")
    back = [f"b{depth} AS MATERIALIZED (SELECT s, id, paths, 0.0::DOUBLE AS owed FROM f{depth})"]
    for k in range(depth - 1, -1, -1):
        back.append(f"b{k} AS MATERIALIZED (SELECT v.s, v.id, v.paths, coalesce(sum(v.paths / w.paths * (1 + w.owed)), 0.0) AS owed FROM f{k} v LEFT JOIN (SELECT f, t, b.* FROM ge JOIN b{k + 1} b ON b.id = t) w ON w.f = v.id AND w.s = v.s GROUP BY v.s, v.id, v.paths)")
    levels = " UNION ALL ".join(f"SELECT s, id, owed, {k} AS d FROM b{k}" for k in range(depth + 1))
    return ",\n".join([*forward, *back, f"""owed AS MATERIALIZED ({levels}),
through AS (SELECT id, sum(owed) AS betweenness FROM owed WHERE s <> id GROUP BY id),
reach AS (SELECT s AS id, sum(d) AS far, count(*) AS reached FROM owed WHERE d > 0 GROUP BY s),
central AS (SELECT gn.id, coalesce(betweenness, 0.0) AS betweenness, coalesce(((SELECT count(*) FROM gn) - 1) / far, 0.0) AS closeness, coalesce(reached, 0)::BIGINT AS reached FROM gn LEFT JOIN through USING (id) LEFT JOIN reach USING (id))"""])


@query(f"WITH {_SRC},\nge AS MATERIALIZED (SELECT DISTINCT f, t FROM called WHERE f <> t), gn AS MATERIALIZED (SELECT DISTINCT id FROM fn),\n{_levels(10)}\nSELECT id, round(betweenness, 6) AS betweenness, round(closeness, 6) AS closeness, reached FROM central")
def call_centrality(spark, d):
    nodes, edges = program.build(_lexed(spark, d))
    found = centrality.dependencies(nodes.filter("node_type = 'Function'"), edges.filter("edge_type = 'Calls'"))
    return found.select("id", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"), "reached")


@query()
def purchase_neighbourhoods(spark, d):
    """Sketched over who bought from whom, either way."""
    n, e = roles.purchases(spark, d)
    return centrality.neighbourhoods(n, e.select("from", "to").union(e.select("to", "from")))


@query(with_("graph") + f", ge AS MATERIALIZED (SELECT f, t FROM calls), gn AS MATERIALIZED (SELECT id FROM n),\n{_levels(12)},\nod AS (SELECT f, count(*) AS o FROM ge GROUP BY f), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM gn) AS rank FROM gn)"
  + "".join(f", r{k + 1} AS MATERIALIZED (SELECT gn.id, 0.15::DOUBLE / (SELECT count(*) FROM gn) + 0.85 * coalesce(sum(r{k}.rank / o), 0) AS rank FROM gn LEFT JOIN ge ON ge.t = gn.id LEFT JOIN od ON od.f = ge.f LEFT JOIN r{k} ON r{k}.id = ge.f GROUP BY gn.id)" for k in range(10))
  + """ SELECT id, round((coalesce(i, 0) + coalesce(o, 0)) / ((SELECT count(*) FROM gn) - 1) + betweenness / (((SELECT count(*) FROM gn) - 1) * ((SELECT count(*) FROM gn) - 2)) + closeness + rank, 6) AS score
  FROM central JOIN r10 USING (id) LEFT JOIN (SELECT f AS id, count(*) AS o FROM ge GROUP BY f) USING (id) LEFT JOIN (SELECT t AS id, count(*) AS i FROM ge GROUP BY t) USING (id) ORDER BY score DESC, id LIMIT 10""")
def central_nations(spark, d):
    n, e = _calls(spark, d)
    return centrality.most_central(n, e, 10)


@query(with_("purchases") + ", bw AS MATERIALIZED (SELECT f AS a, t AS b FROM pe UNION ALL SELECT t, f FROM pe), l0 AS MATERIALIZED (SELECT id, id AS g FROM pn)"
  + "".join(f", l{k} AS MATERIALIZED (SELECT l.id, least(min(l.g), coalesce(min(n.g), min(l.g))) AS g FROM l{k - 1} l LEFT JOIN bw ON bw.a = l.id LEFT JOIN l{k - 1} n ON n.id = bw.b GROUP BY l.id)" for k in range(1, 13)) + " SELECT id, g AS component FROM l12")
def purchase_component_ids(spark, d):
    return graphs.components(*roles.purchases(spark, d))
