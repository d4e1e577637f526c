"""Line folds, symbols, joins of the dependency graph, report formats, sources and streams on small examples."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import code, scoring, text
from plumbline.operators import clones, dag, graphs
from plumbline.sinks import render
from plumbline.sources import trees
from plumbline.streaming import watch

SOURCE = """pub fn first(x: i32) {
    if x > 1 && y || z {
        for i in 0..3 {
            return i;
        }
    } else {
        match x { _ => 1 }
    }
}
}
struct Point { a: i32 }
#[no_mangle]

pub fn second() {
    // TODO: later
    while true { }
}""".split("\n")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("a.rs", k + 1, t) for k, t in enumerate(SOURCE)], "path string, line int, text string")


def depths(rows):
    depth, out = 0, []
    for t in map(str.strip, rows):
        depth = depth + 1 if t.endswith("{") else max(0, depth - 1) if t.startswith("}") else depth
        out.append(depth)
    return out


def test_nesting_never_goes_below_zero(lines):
    got = {r.line: r.nesting for r in code.nesting(lines).collect()}
    assert [got[k + 1] for k in range(len(SOURCE))] == depths(SOURCE)


def test_file_cognitive(lines):
    want = 0
    for t, n in zip(map(str.strip, SOURCE), depths(SOURCE)):
        want += (1 + n) * (t.startswith("if ") or " if " in t) + (1 + n) * t.startswith(("for ", "while "))
        want += n * any(x in t for x in ("fn ", "function", "=>")) + ("return" in t and n > 1)
    assert code.file_cognitive(lines).first().cognitive == want


def test_function_windows(lines):
    got = {r.name: r for r in code.function_windows(lines).collect()}
    for name, at in (("first", 0), ("second", 13)):
        cyc, cog, depth = 1, 0, 0
        for x in SOURCE[at : at + 20]:
            if any(w in x for w in ("if ", "while ", "for ", "match ")):
                cyc, cog = cyc + 1, cog + 1 + depth
            if "else" in x:
                cyc, cog = cyc + 1, cog + 1
            t = x.strip()
            depth = depth + 1 if t.endswith("{") else max(0, depth - 1) if t.startswith("}") else depth
        assert (got[name].cyclomatic, got[name].cognitive, got[name].line_end) == (cyc, cog, at + 10)


def test_symbols_and_references(lines):
    found = code.symbols(lines)
    assert sorted((r.kind, r.name, r.column, r.visibility) for r in found.collect()) == [("Function", "first", 7, "Public"), ("Function", "second", 7, "Public"), ("Type", "Point", 7, "Internal")]
    assert {r.name: r.references for r in code.references(lines, found).collect()} == {"first": 1, "second": 1, "Point": 1}
    assert code.of_kind(found, "functions", "sec").count() == 1
    assert code.next_function(lines).first().exported == "second"


def test_names_rules_and_filters(spark):
    paths = ["src/a.rs", "src/deep/b_test.rs", "vendor/x.js", "a/app.min.js", "tests/t.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", code.glob(F.col("p"), "src/*.rs").alias("one"), code.glob(F.col("p"), "**/*.rs").alias("deep"), code.is_test_path(F.col("p")).alias("test"), code.is_vendor_path(F.col("p")).alias("vendor"), code.toolchain_file(F.col("p"), "rust").alias("rust")).collect()
    assert [r.one for r in got] == [True, False, False, False, False]
    assert [r.deep for r in got] == [r.rust for r in got] == [True, True, False, False, False]
    assert [r.test for r in got] == [False, True, False, False, True] and [r.vendor for r in got] == [False, False, True, True, False]
    assert spark.range(1).select(code.node_complexity(F.lit("Struct"), F.lit(3)).alias("x")).first().x == 4


def test_dag_joins(spark):
    symbols = spark.createDataFrame([("n1", "Shape", "Trait", 1), ("n2", "Circle", "Struct", 2), ("n3", "Circle", "Struct", 3), ("n4", "area", "Function", 4)], "id string, name string, kind string, order int")
    impls = spark.createDataFrame([("Circle", "Shape"), ("Square", "Shape")], "type_name string, trait_name string")
    assert [tuple(r) for r in dag.inherits(impls, symbols).collect()] == [("n3", "n1", "Inherits")]
    uses = spark.createDataFrame([("geo::Circle",), ("geo::area",), ("std::io",)], "use_path string")
    assert {r.use_path: r.id for r in dag.resolved(uses, symbols).collect()} == {"geo::Circle": "n3", "geo::area": "n4", "std::io": "external::std::io"}
    nodes = spark.createDataFrame([("m1", "src/a.rs"), ("m2", "src/b.rs")], "id string, file_path string")
    names = spark.createDataFrame([("src/a.rs", "b.rs"), ("src/a.rs", "none.rs")], "path string, name string")
    assert [tuple(r) for r in dag.by_basename(names, nodes).collect()] == [("m1", "m2")]
    metrics = spark.createDataFrame([("a", 0.1, 0.2, 0.9), ("b", 0.1, 0.2, 0.3)], "id string, degree double, betweenness double, closeness double")
    assert [r.id for r in dag.central(metrics, 0.5).collect()] == ["a"]
    files = spark.createDataFrame([("src/a.rs",), ("src/c.rs",)], "path string")
    values = spark.createDataFrame([("src/a.rs", 1.0), ("src/a.rs", 3.0)], "path string, value double")
    assert {r.path: r.value for r in dag.with_metric(files, values, "path", "value").collect()} == {"src/a.rs": 3.0, "src/c.rs": 0.0}


def test_graph_loops_run_until_nothing_is_new(spark):
    n = spark.range(12)
    e = spark.createDataFrame([(k, k + 1) for k in range(11)], "from long, to long")
    assert graphs.distances(n, e, n.filter("id = 0")).agg(F.max("distance")).first()[0] == 11
    assert graphs.components(n, e).agg(F.max("component")).first()[0] == 0


def test_report_formats(spark):
    df = spark.createDataFrame([("b", 'say "x", y', 2), ("a", None, 1)], "k string, v string, n int")
    assert [r[0] for r in df.select(render.csv_line(F.col("k"), F.col("v"), F.col("n"))).collect()] == ['b,"say ""x"", y",2', "a,,1"]
    assert render.document(df.select("k", render.markdown_row(F.col("k"), F.col("n")).alias("l")), "l", ["k"], head="# r\n").first().text == "# r\n| a | 1 |\n| b | 2 |"
    rows = df.select(render.sarif_result(F.col("k"), F.lit("high"), F.col("k"), F.lit("f.rs"), F.col("n")).alias("r"))
    doc = json.loads(render.sarif(rows, "r", "plumbline").first().text)
    assert [x["ruleId"] for x in doc["runs"][0]["results"]] == ["a", "b"] and doc["runs"][0]["results"][0]["level"] == "error"
    hits = spark.createDataFrame([("f", 2, 0), ("f", 1, 3)], "path string, line int, hits int")
    assert render.lcov_record(hits).first().record == "SF:f\nDA:1,3\nDA:2,0\nLF:2\nLH:1\nend_of_record"
    assert spark.range(1).select(render.mermaid_node(F.lit("a.b"), F.lit('x["y"] & z')).alias("t")).first().t == "    a_b[x('y')  and  z]"
    kept = spark.createDataFrame([("one", "abc"), ("two", "x")], "name string, content string")
    listed = render.manifest(kept)
    now = spark.createDataFrame([("one", "abd"), ("new", "x")], "name string, content string")
    assert {r.name: r.problem for r in render.damaged(now, listed).collect()} == {"one": "changed", "two": "missing", "new": "unlisted"}


def test_clone_pairs_are_exact(spark):
    """Against the Jaccard of all pairs of shingle sets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.split("text", r"\s+").alias("tokens"))
    sets = {}
    for r in docs.collect():
        s = frozenset(tuple(r.tokens[i : i + 5]) for i in range(len(r.tokens) - 4))
        if s:
            sets[s] = min(r.id, sets.get(s, r.id))
    want = {}
    for a, i in sets.items():
        for b, j in sets.items():
            if i < j and len(a & b) >= 0.7 * len(a | b):
                want[i, j] = len(a & b) / len(a | b)
    got = {(r.a, r.b): r.similarity for r in clones.similar_pairs(docs).collect()}
    assert got == pytest.approx(want)
    renamed = spark.createDataFrame([(["let", "x", "=", "3", "+", "x"],), (["let", "y", "=", "4", "+", "y"],)], "t array<string>").select(clones.normalised(F.col("t")).alias("n")).collect()
    assert renamed[0].n == renamed[1].n


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f(x):\n    if x:\n        return 1\n    return f(x - 1)\n")
    (tmp_path / "src" / "b.rs").write_text("pub fn g() {\n    if a && b {\n    }\n}\n")
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "c.rs").write_text("fn h() {}\n")
    (tmp_path / "Makefile").write_text("all: x\n\techo\n.PHONY: all\n")
    found = trees.files(spark, str(tmp_path)).cache()
    assert {r.path.rpartition("/")[2]: (r.language, r.category) for r in found.collect()} == {"a.py": ("python", "SourceCode"), "b.rs": ("rust", "SourceCode"), "Makefile": ("other", "BuildConfig")}
    assert {(r.name, r.cyclomatic, r.line_end) for r in trees.functions(found.filter("language IN ('python', 'rust')")).collect()} == {("f", 2, 4), ("g", 3, 4)}
    rules = trees.makefile_rules(found.filter("category = 'BuildConfig'"))
    assert {(r.rule, r.target) for r in trees.makefile_violations(rules).collect()} == {("minphony", "clean"), ("minphony", "test")}
    log = ["h1|Ann|2026-01-02T03:04:05+00:00", "3\t1\tsrc/a.py", "-\t-\tlogo.png", "h2|Bo|2026-01-03T03:04:05+00:00", "5\t0\tb.rs"]
    commits = trees.commits(spark.createDataFrame([("r", k, t) for k, t in enumerate(log)], "source string, line int, text string"))
    assert sorted((r.hash, r.author, r.path, r.additions, r.deletions) for r in commits.collect()) == [("h1", "Ann", "src/a.py", 3, 1), ("h2", "Bo", "b.rs", 5, 0)]
    module = b"\0asm\x01\0\0\0" + bytes([1, 2, 9, 9, 10, 3, 1, 2, 3])
    wasm = trees.wasm_sections(spark.createDataFrame([("m", module), ("bad", b"nope")], "path string, content binary"))
    assert {r.path: (r.valid, r.sections, r.code_bytes) for r in wasm.collect()} == {"m": (True, 2, 3), "bad": (False, 0, 0)}


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"path": "a", "name": f"f{k}", "cyclomatic": 10 + k, "cognitive": 1, "tdg": 0.5, "ts": f"2026-01-01T00:00:{k:02d}"} for k in range(20)]
    (folder / "one.json").write_text("\n".join(map(json.dumps, rows)))
    stream = watch.needs_work(watch.metrics_stream(spark, str(folder)))
    q = watch.last_few(stream, 3).writeStream.format("memory").queryName("few").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("few").first().names == ["f17", "f18", "f19"]
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    seen = files.filter("path = 'a'").withColumn("hash", F.sha2("content", 256))
    assert [r.path for r in watch.unseen(files, seen).collect()] == ["b"]


def test_text_and_scores(spark):
    one = spark.range(1)
    long = "// " + "x" * (1 << 21) + " todo"
    assert one.select(F.length(text.comment_text(F.lit(long))).alias("n")).first().n == len(long) - 3
    assert one.select(text.adjusted_severity(F.lit("High"), F.lit("security"), F.lit(1)).alias("s")).first().s == "Critical"
    assert one.select(text.node_id(F.lit("./src/a-b.rs")).alias("s")).first().s == "src_a_b"
    assert one.select(text.imports_in(F.array(F.lit("use a;"), F.lit("let b"))).alias("n"), text.exports_in(F.array(F.lit("pub fn a"), F.lit("export x"))).alias("m")).first() == (1, 2)
    assert [one.select(scoring.churn_factor_by_age(F.lit(x)).alias("v")).first().v for x in (1, 10, 60, 365)] == [3.0, 2.0, 1.0, 0.5]
    assert one.select(scoring.size_rank(F.lit("py"), F.lit(400)).alias("v")).first().v == pytest.approx(0.55)


def test_diagnostics(spark, tmp_path):
    from plumbline.sources.diagnostics import diagnostics

    span = lambda file, first, line: {"file_name": file, "is_primary": first, "line_start": line, "column_start": 1, "line_end": line, "column_end": 5}
    message = lambda level, lint, *spans: {"reason": "compiler-message", "message": {"message": "m", "level": level, "code": lint and {"code": lint}, "spans": spans}}
    rows = [
        message("warning", "unused", span("server/src/a.rs", False, 1), span("server/src/a.rs", True, 7)),
        message("help", None, span("b.rs", False, 3)),
        message("error", "E1", span("Cargo.toml", True, 1)),
        message("error", "E2"),
        {"reason": "build-finished"},
    ]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)) + "\nno json\n")
    got = {(r.file, r.line, r.lint, r.severity, r.machine_applicable) for r in diagnostics(spark, str(tmp_path / "d.json")).collect()}
    assert got == {("src/a.rs", 7, "unused", "warning", False), ("b.rs", 3, "unknown", "suggestion", False)}


def test_blocks_of_tests(spark):
    from plumbline.operators.gates import outside_tests

    text = ["a", "}", "#[cfg(test)]", "} x {", "}", "b", "#[cfg(test)]", "{ {", "} }", "}", "c"]
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(text, 1)], "path string, line int, text string")
    assert sorted(r.line for r in outside_tests(rows).collect()) == [1, 2, 5, 6, 9, 10, 11]
    assert outside_tests(rows.limit(0)).count() == 0


def test_makefile_variables(spark):
    from plumbline.operators import makefiles

    text = ["A = $(shell ls)", "B = $(A) x", "C := $(shell date)", "D ?= 1", "all: $(B)", "\techo $(B) ${B} $$(HOME) $@ $(i) ${E:-x}"]
    rows = spark.createDataFrame([("m", k, t) for k, t in enumerate(text, 1)], "path string, line int, text string")
    got = {(r.line, r.rule, r.name) for r in makefiles.violations(rows).collect()}
    assert got == {(3, "timestampexpanded", "C"), (4, "portability", "D"), (6, "undefinedvariable", "E"), (6, "recursive-expansion", "B")}
    assert makefiles.violations(rows.limit(0)).count() == 0
