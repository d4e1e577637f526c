"""Complexity of Rust functions from their tokens' nesting, as a syntax tree would give it.

A control expression ends at the brace that returns to the depth where it
began, for an ``if`` the last of its else branches. What lies in how many
control expressions is a running count of their starts and ends, taken along a
file's own tokens, so the tree is never built and no token is shuffled: what
leaves a file's row is a sum for each line with a point.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.program import has_item, items, with_ids
from plumbline.operators.ranges import innermost
from plumbline.session import cut

CONTROL = frozenset(("if", "match", "while", "for", "loop"))
_OPENS, _CLOSES = frozenset("([{"), frozenset(")]}")
_LOOKED_AT = CONTROL | _OPENS | _CLOSES | {"=>", "&&", "||", "?", "!", "async"}
_POINTS = "array<struct<line:int,points:int,weight:int,nesting_max:int,is_async:int>>"


def _line_sums(lines: list[int], texts: list[str], kinds: list[str]) -> list[tuple]:
    """(line, points, weight, nesting_max, is_async) of the lines of a file's tokens that have any of it."""
    texts, kinds = ["", "", *texts, ""], ["", "", *kinds, ""]  # two before and one after
    depth = nesting = macros = 0
    open_: dict[int, list[str]] = {}  # what waits for its end, by the depth before it
    out: dict[int, list[int]] = {}
    for n, line in enumerate(lines, 2):
        t = texts[n]
        if t not in _LOOKED_AT:
            continue
        k, prev, prev_k, next_ = kinds[n], texts[n - 1], kinds[n - 1], texts[n + 1]
        operand = prev_k in ("i", "l") or prev in (")", "]")
        # an if after an operand guards a match arm, a for after a type or before < is none over a range
        control = k == "k" and t in CONTROL and not (t == "if" and operand) and not (t == "for" and (prev_k == "i" or prev == ">" or next_ == "<"))
        point = not macros and (
            control
            or t == "=>"
            or (t in ("&&", "||") and (operand or prev in ("}", "?", "self")))
            or (t == "?" and next_ != "Sized")
            or (t == "!" and prev_k == "i" and next_ in _OPENS and texts[n - 2] not in ("", "{", "}", ";"))
            or (t == "async" and next_ in ("{", "move"))
        )
        if point or control or t == "async":
            sums = out.setdefault(line, [0, 0, 0, 0])
            if point:
                sums[0] += 1
                sums[1] += 1 + max(nesting - 1, 0)
            if control:
                sums[2] = max(sums[2], nesting + 1)
            elif t == "async" and next_ not in ("{", "move"):
                sums[3] = 1
        if control:
            open_.setdefault(depth, []).append("if" if t == "if" else "block")
            nesting += 1
        elif k == "d" and t in _OPENS:
            if prev == "!" and prev_k == "o":
                open_.setdefault(depth, []).append("macro")
                macros += 1
            depth += 1
        elif k == "d":
            depth -= 1
            waiting = open_.get(depth)
            if waiting:
                ended = {"macro"} if t != "}" else {"macro", "block"} if next_ == "else" else {"macro", "block", "if"}
                left = [what for what in waiting if what not in ended]
                macros -= sum(what == "macro" for what in waiting)
                nesting -= sum(what != "macro" and what in ended for what in waiting)
                open_[depth] = left
    return [(line, *sums) for line, sums in out.items()]


def points(lines: Column) -> Column:
    """Array of (line, points, weight, nesting_max, is_async): what a file's lines have of points, their weight and nesting, and async functions."""
    def run(batch: pa.Array) -> pa.Array:
        flat = batch.flatten()
        of_file, of_line = pc.fill_null(pc.list_value_length(batch), 0).to_pylist(), pc.fill_null(pc.list_value_length(flat.field("tokens")), 0).to_pylist()
        numbers, tokens = flat.field("line").to_pylist(), flat.field("tokens").flatten()
        texts, kinds = tokens.field("t").to_pylist(), tokens.field("k").to_pylist()
        found, sizes, line, token = [], [], 0, 0
        for n in of_file:
            own = [x for x, m in zip(numbers[line : line + n], of_line[line : line + n]) for _ in range(m)]
            sums = _line_sums(own, texts[token : token + len(own)], kinds[token : token + len(own)])
            found.extend(sums)
            sizes.append(len(sums))
            line, token = line + n, token + len(own)
        names = ("line", "points", "weight", "nesting_max", "is_async")
        columns = [pa.array(x, pa.int32()) for x in (zip(*found) if found else [[]] * 5)]
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), pa.StructArray.from_arrays(columns, names))

    return F.arrow_udf(run, _POINTS)(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["tokens"].alias("tokens"))))


def complexity(lexed: DataFrame) -> DataFrame:
    """(id, path, line, end, cyclomatic, cognitive, nesting_max) of every Rust function with a body.

    ``lexed``: files as ``sources.lexer.lexed_files`` gives them, or lines,
    which are put together first. One point each for if, match, while, for and
    loop, for a match's arms, for &&, ||, ?, async blocks, and macros used as
    expressions, whose arguments are not looked into; an async function starts
    with two. A point's cognitive weight grows by the nesting over one.
    """
    files = lexed.filter("language = 'rust'")
    if "lines" not in files.columns:
        line = F.struct("line", "text", "tokens", "delta", "low", "opened", "end_line")
        files = files.groupBy("path", "language").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    # of a file's lines only those that may hold an item are written, and the sums
    files = cut(files.select("path", "language", points(F.col("lines")).alias("sums"), F.filter("lines", lambda x: has_item(x["text"])).alias("lines")))
    rows = files.select("path", F.inline("sums"))
    found = cut(with_ids(items(files.select("path", "language", F.inline("lines")))).filter("kind = 'Function' and not declared").select("id", "path", "line", "end"))
    at = innermost(rows.select("path", "line"), found.select("path", F.col("line").alias("start"), "end"))
    mine = rows.join(at.select("path", "line", "start"), ["path", "line"]).withColumn("is_async", F.when(F.col("line") == F.col("start"), F.col("is_async")).otherwise(0))
    sums = mine.groupBy("path", F.col("start").alias("line")).agg(F.sum("points").alias("points"), F.sum("weight").alias("weight"), F.max("nesting_max").alias("nesting_max"), F.max("is_async").alias("is_async"))
    return found.join(sums, ["path", "line"], "left").na.fill(0, ["points", "weight", "nesting_max", "is_async"]).select("id", "path", "line", "end", (1 + F.col("is_async") + F.col("points")).cast("int").alias("cyclomatic"), (1 + F.col("is_async") + F.col("weight")).cast("int").alias("cognitive"), F.col("nesting_max").cast("int").alias("nesting_max"))
