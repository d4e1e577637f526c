"""The lexer, blocks by braces and indentation, renaming, and the exact similarity join against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clones, fragments, simjoin
from plumbline.sources import lexer

RUST = r'''use std::io; // not a brace {
/* a comment
   over lines { */
pub fn first<'a>(x: i32) -> i32 {
    let s = "} // no end \" {";
    let c = '}';
    if x >= 10_000 && s.len() != 0..3 {
        return x;
    }
    x
}
fn declared(x: i32);
fn short() { 1 }
fn below(x: i32)
{
    inner(|y| { y + 1 });
    fn nested() {
        2
    }
}
'''
PYTHON = '''import os

def first(a,
          b):
    """def not_me():
    return 1
"""
    if a:
        return "# no comment"

    return b
# a comment at the left
class Thing:
    def method(self):
        x = [
1, 2]
        return x

    async def other(self):
        def inner(): 
            return 3
        return inner
last = first(1, 2)
'''


def lines_of(text, language):
    return list(lexer.lexed_lines(text, *lexer.scanner(language)))


def test_lexer_keeps_strings_and_comments_apart():
    got = lines_of(RUST, "rust")
    assert [r["line"] for r in got] == list(range(1, RUST.count("\n") + 1))
    assert [t["t"] for t in got[0]["tokens"]] == ["use", "std", "::", "io", ";"]
    assert got[1]["tokens"] == got[2]["tokens"] == [] and got[2]["inside"] and not got[3]["inside"]
    assert [(t["t"], t["k"]) for t in got[4]["tokens"]] == [("let", "k"), ("s", "i"), ("=", "o"), (r'"} // no end \" {"', "l"), (";", "d")]
    assert [(t["t"], t["k"]) for t in got[5]["tokens"]][3] == ("'}'", "l")
    assert [t["t"] for t in got[6]["tokens"]] == ["if", "x", ">=", "10_000", "&&", "s", ".", "len", "(", ")", "!=", "0..3", "{"]
    assert sum(r["delta"] for r in got) == 0 and lines_of("", "rust") == []
    assert [t["t"] for t in lines_of("a->b::c..d?", "rust")[0]["tokens"]] == ["a", "->", "b", "::", "c", "..", "d", "?"]
    assert [t["t"] for t in lines_of("x = `a ${b}\n` + 'it\\'s'", "javascript")[0]["tokens"]] == ["x", "=", "`a ${b}\n`"]
    long = "/* " + "{ \\\" " * 50_000 + "*/ x " + '"' + "\\\\" * 50_000 + '" y'
    assert [t["t"] for t in lines_of(long, "c")[0]["tokens"] if t["k"] == "i"] == ["x", "y"]


def files(spark, data):
    return spark.createDataFrame(data, "path string, language string, text string")


def test_functions_by_braces_and_indentation(spark):
    lexed = lexer.lexed(files(spark, [("a.rs", "rust", RUST), ("b.py", "python", PYTHON), ("none", "rust", None), ("empty", "python", "")])).cache()
    got = {(r.path, r.start_line, r.end_line) for r in fragments.spans(lexed, fragments.starts_function(F.col("text"), F.col("language"))).collect()}
    assert got == {("a.rs", 4, 11), ("a.rs", 14, 20), ("a.rs", 17, 19), ("b.py", 3, 11), ("b.py", 14, 17), ("b.py", 19, 22), ("b.py", 20, 21)}
    blocks = {(r.start_line, r.end_line) for r in fragments.spans(lexed.filter("path = 'a.rs'"), fragments.starts_block(F.col("text"))).collect()}
    assert blocks == {(4, 11), (7, 9), (14, 20), (17, 19)}
    whole = fragments.fragments(lexed, min_tokens=1).filter("language = 'rust'").collect()
    assert {r.id for r in whole} == {"a.rs:4:11", "a.rs:14:20", "a.rs:17:19"}
    assert {r.id for r in fragments.fragments(lexer.lexed(files(spark, [("c.rs", "rust", "let a = 1;\nlet b = 2;")])), min_tokens=10).collect()} == {"c.rs:1:2"}
    assert fragments.fragments(lexed.limit(0)).count() == 0


def test_renamed_copies_are_one_group(spark):
    body = "fn {0}({1}: i32) {{\n    let {2} = {1} + {3};\n    {0}({2}, {1});\n}}\n"
    data = [("x.rs", "rust", body.format("f", "a", "b", "1") + body.format("f", "a", "b", "1")), ("y.rs", "rust", body.format("g", "p", "q", "22")), ("z.rs", "rust", "fn other() {\n    while true { call(call(call(1))) }\n    loop { break; }\n}\n")]
    found = fragments.fragments(lexer.lexed(files(spark, data)), min_tokens=10).cache()
    groups = clones.clone_groups(found.select("id", fragments.renamed(F.col("tokens")).alias("tokens"))).cache()
    assert {r.id for r in groups.collect()} == {"x.rs:1:4", "x.rs:5:8", "y.rs:1:4"}
    total = fragments.group_totals(groups, found).collect()
    assert [(r.kind, r.fragments, r.files, r.lines) for r in total] == [("renamed", 3, 2, 12)]
    summary = fragments.duplication_summary(groups, found, files(spark, data)).collect()[0]
    assert (summary.files, summary.fragments, summary.total_lines, summary.duplicate_lines, summary.clone_groups, summary.duplication_ratio) == (3, 4, 16, 12, 1, 0.75)
    assert [(r.path, r.duplicate_lines) for r in fragments.hotspots(groups, found).collect()] == [("x.rs", 8), ("y.rs", 4)]
    none = fragments.duplication_summary(groups.limit(0), found.limit(0), files(spark, [])).collect()[0]
    assert (none.total_lines, none.duplication_ratio) == (0, 0.0)


@pytest.mark.parametrize("threshold, hot", [(0.55, 3), (0.7, 2), (0.7, 1000), (0.9, 1)])
def test_similarity_join_is_exact(spark, threshold, hot):
    rng = random.Random(int(threshold * 100) + hot)
    sets = {frozenset(rng.sample(range(40), rng.randint(1, 12))) for _ in range(150)}
    for s in list(sets)[:60]:  # near ones
        sets.add(frozenset([*list(s)[1:], rng.randint(0, 60)]))
        sets.add(s | {1000 + rng.randint(0, 5)})
    family = frozenset(range(500, 540))
    sets |= {family - {k} for k in range(500, 520)}
    rows = list(enumerate(map(sorted, sets)))
    got = {(r.a, r.b): r.similarity for r in simjoin.similar_sets(spark.createDataFrame([*rows, (10_000, [])], "id long, s array<long>"), threshold, hot=hot).collect()}
    want = {}
    for (a, x), (b, y) in combinations(rows, 2):
        j = len(set(x) & set(y)) / len(set(x) | set(y))
        if j >= threshold - 1e-12:
            want[a, b] = j
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_minhash_bands_meet_for_equal_halves(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(300)]
    data = [(0, base), (1, [*base[:-1], "other"]), (2, [f"v{k}" for k in range(300)]), (3, ["short"])]
    got = clones.band_buckets(spark.createDataFrame(data, "id long, tokens array<string>")).collect()
    assert len(got) >= 10 and all(r.members == 2 for r in got)
