"""Small column expressions and cuts against plain Python."""

import math

from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.operators import facts, graphs, makefiles


def test_master_theorem(spark):
    rows = [(a, b, k) for a in range(0, 10) for b in range(0, 5) for k in range(3)]
    got = {(r.a, r.b, r.k): r.g for r in spark.createDataFrame(rows, "a int, b int, k int").select("a", "b", "k", scoring.master_theorem(F.col("a"), F.col("b"), F.col("k")).alias("g")).collect()}

    def want(a, b, k):
        if a < 1 or b < 2 or k > 1:
            return None
        p = next(p for p in range(10) if b**p >= a)
        if k == 1 and a == b:
            return "O(n log n)"
        if k == 1 and a < b:
            return "O(n)"
        return {0: "O(log n)", 1: "O(n)"}.get(p, f"O(n^{p})")

    assert got == {x: want(*x) for x in rows}


def test_advice(spark):
    rows = [(0.0, 1.0, 0.0, 0.0, 20, 30), (1.0, 50.0, 1.0, 20.0, 16, 21), (0.1, 10.0, 0.0, 0.0, 16, 3), (0.0, 1.0, 1.0, 0.0, 0, 0)]
    got = [r.a for r in spark.createDataFrame(rows, "ch double, co double, du double, cp double, cy int, cg int").select(scoring.defect_advice(*[F.col(c) for c in ("ch", "co", "du", "cp", "cy", "cg")]).alias("a")).collect()]
    say = scoring.ADVICE
    assert got == [[], [*say["churn"], *say["risk"]], [*say["complexity"], *say["cyclomatic"]], [*say["duplication"]]]


def test_upper_tenth(spark):
    for n in (1, 2, 9, 10, 11, 50):
        values = [(k * 7) % 23 for k in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "c int")
        assert facts.upper_tenth(df, "c").first()[0] == sorted(values)[min(math.floor(n * 0.9), n - 1)]
    assert facts.upper_tenth(spark.createDataFrame([], "c int"), "c").first()[0] is None


def test_budget_and_order(spark):
    ranks = spark.createDataFrame([(k, g, r) for k, (g, r) in enumerate([("a", 0.5), ("a", 0.4), ("b", 0.8), ("c", 0.1), ("d", 0.7)])], "id int, `group` string, rank double")
    assert {r["group"] for r in graphs.group_budget(ranks, 3).collect()} == {"a", "b"}
    assert {r["group"] for r in graphs.group_budget(ranks, 1).collect()} == set()  # the first has two
    found = spark.createDataFrame([("m", 5, "r", "info", "x"), ("m", 9, "r", "error", "y"), ("m", 1, "r", "warning", "z"), ("m", 2, "r", "error", "w")], "path string, line int, rule string, severity string, name string")
    assert [r.name for r in makefiles.ordered(found, 3).collect()] == ["w", "y", "z"]
    nodes, edges = spark.createDataFrame([(k,) for k in range(6)], "id int"), spark.createDataFrame([(0, 1), (2, 1), (4, 5)], "`from` int, `to` int")
    assert tuple(graphs.component_totals(nodes, edges).first()) == (6, 3, 3, 3)
