"""Fragments of code: functions and blocks by matching braces or by indentation, and what groups of clones add up to.

Where a line's block would end is told by the lexer, so a block is found in
its first line alone. A fragment is a slice of its file's lines.
"""

from __future__ import annotations

from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def starts_function(text: Column, language: Column) -> Column:
    """The lines, trimmed, that start a function, by language."""
    has = text.contains
    script = has("function ") | has("=> {") | (has("(") & has(") {"))
    return (
        F.when(language == "rust", has("fn ") & has("("))
        .when(language.isin("typescript", "javascript"), script)
        .when(language == "python", text.rlike(r"^(async )?def ") & has("("))
        .when(language == "kotlin", has("fun ") & has("("))
        .otherwise(has("(") & (has(") {") | text.endswith("{")))
    )


def starts_block(text: Column) -> Column:
    """The lines that start a block of any kind: functions, types, and lines that end by an opening brace."""
    words = ("fn ", "function", "def ", "class ", "struct ", "impl ")
    found = text.endswith("{") & ~text.startswith("{")
    for w in words:
        found = found | text.contains(w)
    return found


def begins(start: Column, language: Column, line: Column) -> Column:
    """Whether a block of more than one line begins in a line of the lexer, for which ``start`` holds."""
    tokens = line["tokens"]
    ended = (line["delta"] == line["low"]) & ((line["opened"] > 0) | (F.get(tokens, F.size(tokens) - 1)["t"] == ";"))
    return (line["end_line"] > line["line"]) & (F.size(tokens) > 0) & start & ((language == "python") | ~F.coalesce(ended, F.lit(False)))


def spans(lexed: DataFrame, start: Column) -> DataFrame:
    """(path, start_line, end_line) of the blocks of more than one line that begin in lines for which ``start`` holds.

    ``lexed``: what ``sources.lexer.lexed`` returns. ``start`` may use its
    columns. Blocks may lie in one another. Declarations that end by a
    semicolon and blocks that close in their own line are none.
    """
    own = {c: F.col(c) for c in ("line", "tokens", "delta", "low", "opened", "end_line")}
    return lexed.filter(begins(start, F.col("language"), own)).select("path", F.col("line").alias("start_line"), "end_line")


def fragments(lexed: DataFrame, *, min_tokens: int = 50) -> DataFrame:
    """``of_files`` for files that ``sources.lexer.lexed`` gives line by line."""
    line = F.struct("line", "text", "tokens", "delta", "low", "opened", "end_line")
    return of_files(cut(lexed.groupBy("path", "language").agg(F.sort_array(F.collect_list(line)).alias("lines"))), min_tokens=min_tokens)


def of_files(files: DataFrame, *, min_tokens: int = 50) -> DataFrame:
    """(id, path, language, start_line, end_line, tokens) of the functions of ``min_tokens`` tokens or more.

    ``files``: what ``sources.lexer.lexed_files`` returns. A file without such
    a function is a fragment itself if it has as many tokens. A token is its
    text and its kind. All is found within a file's own row.
    """
    def of(lines: Column) -> Column:
        # lines are numbered from 1 without gaps, so a line's place is its number
        found = F.filter(lines, lambda x: begins(starts_function(x["text"], F.col("language")), F.col("language"), x))
        cuts = F.transform(found, lambda x: F.struct(x["line"].alias("start_line"), x["end_line"].alias("end_line"), F.flatten(F.slice(lines, x["line"], x["end_line"] - x["line"] + 1)["tokens"]).alias("tokens")))
        return F.filter(cuts, lambda c: F.size(c["tokens"]) >= min_tokens)

    whole = F.struct(F.lit(1).alias("start_line"), F.size("lines").alias("end_line"), F.flatten(F.col("lines")["tokens"]).alias("tokens"))
    # bound to a lambda's variable: inlined, the cuts would be made again for each use
    kept = F.get(F.transform(F.array(of(F.col("lines"))), lambda cuts: F.when(F.size(cuts) > 0, cuts).otherwise(F.array(whole))), F.lit(0))
    out = files.select("path", "language", F.inline_outer(kept)).filter(F.size("tokens") >= min_tokens)  # outer: for a filter before it the cuts would be made twice
    return out.select(F.concat_ws(":", F.col("path").cast("string"), "start_line", "end_line").alias("id"), "path", "language", "start_line", "end_line", "tokens")


def renamed(tokens: Column) -> Column:
    """The tokens' texts, literals as LITERAL and identifiers as VAR_n by first use, so that renamed copies agree."""
    def run(batch: pa.Array) -> pa.Array:
        flat = batch.flatten()
        size = pc.list_value_length(batch)
        said, of = [], iter(zip(flat.field("t").to_pylist(), flat.field("k").to_pylist()))
        for n in pc.fill_null(size, 0).to_pylist():
            names: dict[str, str] = {}
            for t, k in islice(of, n):
                if k == "i":
                    t = names.get(t) or names.setdefault(t, f"VAR_{len(names) + 1}")
                elif k == "l":
                    t = "LITERAL"
                said.append(t)
        places = pa.array([0, *accumulate(pc.fill_null(size, 0).to_pylist())], pa.int32())
        return pa.ListArray.from_arrays(places, pa.array(said, pa.string()), mask=pc.is_null(batch))

    return F.arrow_udf(run, "array<string>")(tokens)


def _lines() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def _digest(texts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\n", texts)))


def described(found: DataFrame) -> DataFrame:
    """(id, path, lines, tokens, raw, norm, names) of fragments: digests of their tokens and of their renamed tokens, and these."""
    own = found.select("id", "path", _lines().alias("lines"), F.size("tokens").alias("tokens"), _digest(F.col("tokens")["t"]).alias("raw"), renamed(F.col("tokens")).alias("names"))
    return own.withColumn("norm", _digest(F.col("names")))


def told(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What fragments say of themselves, without their names, and (id, norm, tokens) of what is to be compared.

    That is the different renamed tokens, each under the least id that has
    them, so of copies only one is looked at.
    """
    said = cut(described(found))
    texts = said.select("norm", "names").distinct().hint("merge")  # no aggregate of texts: a task sends each of them once
    firsts = cut(said.groupBy("norm").agg(F.min("id").alias("id")).join(texts, "norm").select("id", "norm", F.col("names").alias("tokens")))
    return said.drop("names"), firsts


def group_totals(groups: DataFrame, fragments: DataFrame) -> DataFrame:
    """(group, kind, fragments, files, lines, tokens) of clone groups (id, group).

    exact: all members have the same tokens; renamed: the same but for names
    and literals; similar: neither.
    """
    return totals_of(groups.join(described(fragments), "id"))


def totals_of(grouped: DataFrame) -> DataFrame:
    """``group_totals`` of fragments as ``described``, with their groups."""
    found = grouped.groupBy("group").agg(F.count("*").alias("fragments"), F.count_distinct("path").alias("files"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"), F.min("raw").alias("r1"), F.max("raw").alias("r2"), F.min("norm").alias("n1"), F.max("norm").alias("n2"))
    kind = F.when(F.col("r1") == F.col("r2"), "exact").when(F.col("n1") == F.col("n2"), "renamed").otherwise("similar")
    return found.select("group", kind.alias("kind"), "fragments", "files", "lines", "tokens")


def duplication_summary(groups: DataFrame, fragments: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, fragments, clone groups, the largest group, lines in fragments and in clones, and their ratio."""
    each = fragments.select("id", _lines().alias("lines"))
    return summary_of(groups.join(each, "id"), each, files)


def summary_of(grouped: DataFrame, each: DataFrame, files: DataFrame) -> DataFrame:
    """``duplication_summary`` of fragments(lines) and, with their groups, of those in clones."""
    all_ = each.agg(F.count("*").alias("fragments"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    per = grouped.groupBy("group").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    dup = per.agg(F.count("*").alias("clone_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"), F.coalesce(F.sum("lines"), F.lit(0)).alias("duplicate_lines"))
    one = files.agg(F.count("*").alias("files")).crossJoin(all_).crossJoin(dup)  # one row each
    return one.withColumn("duplication_ratio", F.round(F.when(F.col("total_lines") > 0, F.col("duplicate_lines") / F.col("total_lines")).otherwise(0.0), 6))


def hotspots(groups: DataFrame, fragments: DataFrame, most: int = 10) -> DataFrame:
    """(path, duplicate_lines, clone_groups, severity): the files with most of it; ln of the lines, 1 at least, times the root of the groups."""
    return hotspots_of(groups.join(fragments.select("id", "path", _lines().alias("lines")), "id"), most)


def hotspots_of(grouped: DataFrame, most: int = 10) -> DataFrame:
    """``hotspots`` of fragments(path, lines) in clones, with their groups."""
    per = grouped.groupBy("path").agg(F.sum("lines").alias("duplicate_lines"), F.count_distinct("group").alias("clone_groups"))
    severity = F.round(F.greatest(F.ln("duplicate_lines"), F.lit(1.0)) * F.sqrt("clone_groups"), 6)
    return per.withColumn("severity", severity).orderBy(F.desc("severity"), "path").limit(most)
