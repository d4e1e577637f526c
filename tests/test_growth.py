"""What is joined and dealt by the queries that ran out of memory or disk: plans, and results beside them."""

import re

from pyspark.sql import functions as F

from plumbline.operators import blame, clones, fragments, graphs, makeexpand, program, ranges, simjoin
from plumbline.plans import fragment_catalogue, history_catalogue
from plumbline.session import cut
from plumbline.sources import lexer
from plumbline.streaming.incremental import ChurnStore

SF = "/root/testdata/sf0.001"
RUST = "static A: i32 = 1;\nfn plain(x: i32) {\n    call(x);\n}\nconst fn fixed() {\n    2;\n}\nfn wild() {\n    unsafe {\n        go();\n    }\n}\nfn shared() {\n    let x = Rc::new(1);\n}\nfn outer() {\n    fn inner() {\n        unsafe { 1 };\n    }\n}\n"


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_similar_sets_send_no_side_to_all(spark, capsys):
    sets = cut(spark.range(300).select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x + F.col("id")).alias("s")))
    assert "BroadcastHashJoin" not in plan(simjoin.similar_sets(sets, 0.7), capsys)


def test_source_files_send_no_orders_to_all(spark, capsys):
    assert "Broadcast" not in plan(fragment_catalogue.source_files(spark, SF), capsys)


def test_fragments_join_no_lines(spark, capsys, monkeypatch):
    body = "\n".join(f"    let a_{k} = b({k}) + c;" for k in range(10))
    text = f"fn one() {{\n{body}\n    fn two() {{\n{body}\n    }}\n}}\nfn short() {{\n}}\n"
    files = spark.createDataFrame([(1, "rust", text), (2, "rust", body), (3, "rust", "fn short() {}")], "path long, language string, text string")
    written = []
    monkeypatch.setattr(fragments, "cut", lambda df: written.append(df) or cut(df))
    found = fragments.fragments(lexer.lexed(files))
    assert len(written) == 1  # the lines; functions' tokens are not written as well
    assert not re.search(r"Join \[path#\d+L?, line", plan(found, capsys))
    assert {(x.id, len(x.tokens)) for x in found.collect()} == {("1:1:24", 212), ("1:12:23", 106), ("2:1:10", 100)}


def test_proofs_join_only_lines_that_matter(spark, capsys):
    files = spark.createDataFrame([("a.rs", "rust", RUST)], "path string, language string, text string")
    found = program.proofs(lexer.lexed(files))
    assert "explode(tokens" not in plan(found, capsys)
    got = {(x.id.rsplit("::", 1)[-1], x.property) for x in found.collect()}
    assert got == {("plain", "memory_safety"), ("plain", "thread_safety"), ("fixed", "memory_safety"), ("fixed", "thread_safety"), ("fixed", "termination"), ("shared", "memory_safety")}


def test_entropy_takes_runs_and_not_single_bytes(spark):
    import math
    from collections import Counter

    from plumbline.sources import trees

    texts = ["", "a", "aaaa", "ab" * 700, "héé\n\x00\x00\"", "".join(map(chr, range(1, 200))), None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    entropy = trees.byte_entropy(F.col("text"))
    assert "run" not in str(entropy)  # no state is carried from byte to byte
    for row in df.select("text", entropy.alias("e")).collect():
        b = row.text.encode()[:1024] if row.text is not None else b""
        want = None if row.text is None else math.log2(len(b)) - sum(c * math.log2(c) for c in Counter(b).values()) / len(b) if b else 0.0
        assert row.e is None if want is None else abs(row.e - want) < 1e-9


def test_lines_of_tests_are_sorted_once_without_their_texts(spark, capsys):
    import random

    from plumbline.operators.gates import outside_tests

    draw = random.Random(5)
    files = {f: [draw.choice(["#[cfg(test)]", "{", "}", "} {", "x }", "{ }", "a", "{ {", "} }", " #[cfg(test)] }"]) for _ in range(40)] for f in range(40)}
    want = set()
    for f, lines in files.items():
        inside, depth = False, 0
        for k, t in enumerate(lines, 1):
            if t.strip().startswith("#[cfg(test)]"):
                inside, depth = True, 0
            elif inside:
                depth = max(0, depth + t.count("{") - t.count("}"))
                inside = not (depth == 0 and t.strip().endswith("}"))
            if not inside:
                want.add((f, k))
    rows = cut(spark.createDataFrame([(f, k, t) for f, lines in files.items() for k, t in enumerate(lines, 1)], "path int, line int, text string"))
    found = outside_tests(rows).select("path", "line")
    said = plan(found, capsys)
    assert said.count(" Sort [") == 1
    assert {tuple(r) for r in found.collect()} == want


def test_components_keep_no_edges_for_repeats(spark, capsys, monkeypatch):
    written = []
    monkeypatch.setattr(graphs, "cut", lambda df: written.append(df) or cut(df))
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (4, 3), (3, 3)], "from int, to int")
    found = graphs.components(spark.createDataFrame([(k,) for k in range(1, 6)], "id int"), edges)
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}
    assert "Aggregate" not in plan(written[0], capsys)


def test_ages_are_looked_up_once_a_line(spark, monkeypatch):
    asked, line_ages = [], blame.line_ages
    monkeypatch.setattr(blame, "line_ages", lambda points, *rest: asked.append(points) or line_ages(points, *rest))
    history_catalogue.debt_line_age(spark, SF)
    assert asked[0].count() == asked[0].select("path", "line").distinct().count()


def test_known_commits_are_not_dealt_to_be_told_apart(spark, tmp_path, capsys):
    store, wrote = ChurnStore(spark, str(tmp_path)), []
    rows = spark.createDataFrame([("p", k % 3, "a", k, 1) for k in range(9)], "path string, hash int, author string, additions int, deletions int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    store.add(rows, 0)
    store._write = lambda df, kind, batch: wrote.append(df)
    store.add(rows, 1)
    assert not re.search(r"keys=\[path#\d+, hash#\d+\]", plan(wrote[1], capsys))
    assert wrote[1].count() == 0


def test_points_look_into_few_sizes(spark):
    spans = spark.range(1, 1025).select(F.lit("f").alias("path"), F.lit(5).alias("start"), (F.col("id") + 4).alias("end"))
    assert ranges._binned(spans).select("_level").distinct().count() <= 6
    points = spark.range(0, 1100, 7).select(F.lit("f").alias("path"), F.col("id").alias("line"))
    found = ranges.covering(points, spans)
    want = points.join(spans, "path").filter("line between start and end")
    assert sorted(map(tuple, found.select("line", "end").collect())) == sorted(map(tuple, want.select("line", "end").collect()))


def test_expansion_writes_known_values_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(makeexpand, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = [("m", f"V{k}", f"$(V{k - 1}) {k}" if k else "0") for k in range(6)] + [("m", "P", "$(V"), ("m", "Q", "$(P)2)"), ("m", "N", "$(V$(V0))"), ("m", "C", "$(C) $(V1)"), ("m", "B", "$(CC) $(NONE)x")]
    found = {r.name: (r.value, r.circular) for r in makeexpand.expanded(spark.createDataFrame(rows, "path string, name string, value string")).collect()}
    assert found["V5"] == ("0 1 2 3 4 5", False)
    assert (found["Q"], found["N"]) == (("0 1 2", False), ("0", False))  # one reference is made of two texts, one has another one in it
    assert (found["C"], found["B"]) == (("$(C) 0 1", True), ("$(CC) x", False))
    assert sum(df.filter("name = 'V0'").count() for df in written) == 1


def test_clone_groups_search_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(clones, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = [(k, ("a b c d e f g h i j k l m n o p q r s t u v w x y z " + "end" * (k // 2)).split()) for k in range(4)] + [(9, "1 2 3 4 5 6".split())]
    groups = clones.clone_groups(spark.createDataFrame(rows, "id int, tokens array<string>"))
    assert [df.columns for df in written].count(["from", "to"]) == 1
    assert {tuple(r) for r in groups.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_makefile_lines_are_matched_once(spark, capsys):
    from plumbline.operators import makefiles

    rows = [("m", 1, "A = $(shell ls)"), ("m", 2, "B = $(A)"), ("m", 3, "all: $(B)"), ("m", 4, "\techo $(B) ${B} $(E)"), ("n", 1, "\techo $(A)"), ("n", 2, None)]
    lines = spark.createDataFrame(rows, "path string, line int, text string")
    found = makefiles.violations(lines)
    assert not re.search("(?i)rlike|regexp_extract", plan(found, capsys))
    assert {(r.path, r.line, r.rule, r.name) for r in found.collect()} == {("m", 4, "undefinedvariable", "E"), ("m", 4, "recursive-expansion", "B"), ("n", 1, "undefinedvariable", "A")}


def test_reachable_reads_its_edges_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graphs, "cut", lambda df: written.append(df.columns) or cut(df))
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(6, 2), (8, 9)], "`from` long, `to` long")
    assert {r.id for r in graphs.reachable(spark.range(12), edges, spark.createDataFrame([(1,), (77,)], "id long")).collect()} == {1, 2, 3, 4, 5, 6}
    assert written.count(["from", "to"]) == 1
