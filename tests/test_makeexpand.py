"""Expansion of Makefile variables, by hand and, for plain values, as make itself prints them where it is there."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.operators import makeexpand, makefiles

LINES = r"""A = $(B) and ${C}
B = one.c two.c
C := x$$y
OBJ = $(B:.c=.o)
DIR = $(B:%.c=out/%.x)
D1 = $(NOPE:-fallback) $(B:+there) $(NOPE:+never)
NAME = B
VIA = $($(NAME)) $(OB$(J))
J = J
LOOP = $(LOOP) x
ROUND = $(TRIP)
TRIP = $(ROUND)
AFTER = a $(LOOP)
D = late
TEXT = $D $(shell ls $(B))
ADD = 1
ADD += 2
MAYBE ?= 3
ADD ?= no
EMPTY =
COMP = $(CC) -c $(NOPE)
SLOW = $(shell find .)
SLOWER = $(SLOW) $(B)""".split("\n")


@pytest.fixture(scope="module")
def assigned(spark):
    return makefiles.variables(spark.createDataFrame([("m", k, t) for k, t in enumerate(LINES)], "path string, line int, text string")).cache()


def test_values(spark, assigned):
    got = {r.name: (r.value, r.circular) for r in makeexpand.expanded(makeexpand.definitions(assigned)).collect()}
    want = {
        "A": "one.c two.c and x$y", "B": "one.c two.c", "C": "x$y", "OBJ": "one.o two.o", "DIR": "out/one.x out/two.x", "D1": "fallback there ", "NAME": "B", "VIA": "one.c two.c one.o two.o", "J": "J", "D": "late",
        "TEXT": "late $(shell ls one.c two.c)", "ADD": "1 2", "MAYBE": "3", "EMPTY": "", "COMP": "$(CC) -c ", "SLOW": "$(shell find .)", "SLOWER": "$(shell find .) one.c two.c",
    }
    assert {k: v for k, (v, circular) in got.items() if not circular} == want
    assert {k for k, (_, circular) in got.items() if circular} == {"LOOP", "ROUND", "TRIP", "AFTER"}


@pytest.mark.skipif(not shutil.which("make"), reason="no make here")
def test_values_as_make_has_them(spark, assigned, tmp_path):
    names = ["A", "C", "OBJ", "DIR", "VIA", "ADD", "MAYBE", "EMPTY"]
    (tmp_path / "Makefile").write_text("\n".join(x for x in LINES if not x.startswith(("LOOP", "AFTER", "ROUND", "TRIP", "D1"))) + "\nall:\n" + "".join(f"\t@printf '%s\\n' '$({n})'\n" for n in names))
    told = subprocess.run(["make", "-s", "all"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split("\n")
    got = {r.name: r.value for r in makeexpand.expanded(makeexpand.definitions(assigned)).collect()}
    assert [got[n] for n in names] == told[: len(names)]


def test_recipes_and_rules(spark, assigned):
    texts = spark.createDataFrame([("m", 1, "$(CC) -o $@ $< $^ $+ $* $(OBJ) $$HOME $(GONE)", "bin/app.o", ["a", "b", "a"]), ("m", 2, "none", "t", [])], "path string, id int, text string, target string, prerequisites array<string>")
    values = makeexpand.expanded(makeexpand.definitions(assigned))
    got = {r.id: r.text for r in makeexpand.expanded_texts(texts, values).collect()}
    assert got == {1: " -o bin/app.o a a b a b a bin/app one.o two.o $HOME ", 2: "none"}
    assert {(r.id, r.name) for r in makeexpand.undefined(texts, values).collect()} == {(1, "GONE")}
    rules = spark.createDataFrame([("m", 7, ["$(SLOWER)", "x$(B)"]), ("m", 8, ["$(B)"])], "path string, line int, prerequisites array<string>")
    assert {(r.line, r.name) for r in makeexpand.costly_prerequisites(rules, assigned).collect()} == {(7, "SLOWER")}
    assert makeexpand.expanded(makeexpand.definitions(assigned.limit(0))).count() == 0
    assert makeexpand.expanded(makeexpand.definitions(assigned.filter(F.col("name") == "B"))).first().value == "one.c two.c"
