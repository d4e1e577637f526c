"""What a file's own row says is found there: plans without shuffles, facts without tokens, and results as from the whole scan."""

import random

from pyspark.sql import functions as F

from plumbline.operators import fragments, program, simjoin, syntax
from plumbline.plans import program_catalogue
from plumbline.sources import lexer

SF = "/root/testdata/sf0.001"
RUST = "pub trait T {\n    fn m(&self);\n}\nimpl T for S {\n    fn m(&self) {\n        if a && b {\n            x(1);\n        } else if c {\n            y!(if d { 1 });\n        }\n    }\n}\n#[no_mangle]\nfn out() {\n    loop { z() }\n}\n"


def plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def files(spark, *texts):
    return spark.createDataFrame([(f"{k}.rs", "rust", t) for k, t in enumerate(texts)], "path string, language string, text string")


def test_blocks_and_fragments_shuffle_nothing(spark, capsys):
    """F7, F14."""
    blocks = fragments.spans(lexer.lexed(files(spark, RUST)), fragments.starts_block(F.col("text")))
    assert not {"Exchange", "Window"} & set(plan(blocks, capsys).replace("(", " ").split())
    assert sorted((r.start_line, r.end_line) for r in blocks.collect()) == [(1, 3), (4, 12), (5, 11), (6, 8), (8, 10), (14, 16)]
    found = fragments.of_files(lexer.lexed_files(files(spark, RUST)), min_tokens=10)
    assert "Exchange" not in plan(found, capsys)
    assert {r.id for r in found.collect()} == {"0.rs:5:11", "0.rs:14:16"}


def test_ends_are_told_over_batches(spark):
    """a file of more lines than a batch holds, between others."""
    long = "fn a() {\n" + "    x();\n" * 20 + "}\n"
    got = lexer.lexed(files(spark, RUST, long, RUST).coalesce(1), rows=4).filter("line = 1").select("path", "end_line").collect()
    assert {tuple(r) for r in got} == {("0.rs", 3), ("1.rs", 22), ("2.rs", 3)}


def test_the_reader_cuts_texts_as_the_scan_does():
    """F15, F16."""
    rng = random.Random(3)
    bits = [*"(){}[]\"'`/*#.;:,=<>!&|-+?@$~\\ \n\t\r_aé1", "//", "/*", "*/", "\n", "fn ", "..", "'a'", '"s"', '"""', "\r\n", "->", "/=", "0x1f.2", "# c"]
    plain = lambda rows: [(*r[:3], "".join(r[3]), *r[4:]) for r in rows]
    for language in ("rust", "python", "c", "kotlin", "typescript"):
        read, scan = lexer.reader(language), lexer.scanner(language)
        for _ in range(2000):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
            assert plain(read(text)) == plain(lexer._scanned(text, *scan)), (language, text)


def test_copies_are_compared_once(spark):
    """F1, F2, F4."""
    body = "fn {0}(x: i32) {{\n    let {1} = x + 1;\n}}\n"
    each, firsts = fragments.told(fragments.of_files(lexer.lexed_files(files(spark, *[body.format(f"f{k}", f"v{k}") for k in range(6)], "fn g() { other(1, 2) }\nfn h() {\n    h(1);\n}\n")), min_tokens=8))
    assert each.count() == 7 and "names" not in each.columns
    assert {(r.id, r.tokens[1]) for r in firsts.collect()} == {("0.rs:1:3", "VAR_1"), ("6.rs:2:4", "VAR_1")}


def test_sets_whose_sketches_differ_are_no_candidates(spark):
    """all share the rarest elements, but few are alike."""
    rng = random.Random(5)
    sets = [(k, [1, 2, 3, 4, 5, 6, *rng.sample(range(1000, 1040), 14)]) for k in range(60)]
    sets += [(100 + k, [*s[:-1], 2000]) for k, s in sets[:5]]
    ranked = simjoin.prefixes(spark.createDataFrame(sets, "id long, s array<long>"), 0.7)
    pairs = {tuple(r) for r in simjoin.candidates(ranked, 0.7, 4).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.7}
    assert want <= pairs and len(pairs) <= 2 * len(want) + 5


def test_complexity_deals_no_tokens(spark, capsys, monkeypatch):
    """F5."""
    written = []
    cut = syntax.cut
    monkeypatch.setattr(syntax, "cut", lambda df: written.append(df) or cut(df))
    got = syntax.complexity(lexer.lexed_files(files(spark, RUST)))
    assert "Exchange" not in plan(written[0], capsys) and "Window" not in plan(got, capsys)
    assert {(r.line, r.cyclomatic, r.cognitive, r.nesting_max) for r in got.collect()} == {(5, 4, 4, 3), (14, 2, 2, 1)}


def test_facts_hold_no_tokens(spark, capsys, monkeypatch):
    """F8, F9, F11, F12, F13, F15, F16."""
    written = []
    cut = program.cut
    monkeypatch.setattr(program, "cut", lambda df: written.append(df) or cut(df))
    lexed = lexer.lexed(files(spark, RUST, "// no struct, no code\n"))
    nodes, edges = program.build(lexed)
    assert "tokens" not in written[0].columns and "Exchange" not in plan(written[0], capsys)
    assert "Exchange" not in plan(written[1], capsys)  # items with their ends, without a join
    assert {r.label for r in nodes.collect()} == {"T", "m", "out", "0", "1"}
    assert {r.id for r in program.exports(lexed, program.with_ids(program.items(lexed))).collect()} == {"0::out"}


def test_project_files_deal_numbers_and_not_texts(spark, capsys):
    """F8, F9, F11, F12, F13, F15, F16."""
    shown = plan(program_catalogue._customer_files(spark, SF), capsys)
    assert shown.count("Exchange hashpartitioning(o_custkey") == 1 and "customer_" not in shown.split("Exchange hashpartitioning(o_custkey")[1]
