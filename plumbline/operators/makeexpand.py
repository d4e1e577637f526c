"""Expanding Makefile variables by rounds of substitution.

A variable whose value refers to nothing is known. A round puts the known
values in where others refer to them, with their modifiers, so rounds are as
many as references lie deep in one another, also references inside names. What
is left when nothing changes any more refers to itself, or to one that does.
Each round is a join on (path, name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.makefiles import BUILTIN, costly
from plumbline.session import cut

#: A reference without another one in it, an automatic variable, text, or a lone dollar. Function calls hold blanks and stay as text.
PIECES = r"\$\([^()$\s]*\)|\$\{[^{}$\s]*\}|\$[A-Za-z]|\$[@<^*?+%]|[^$]+|\$"
REFERENCE = r"\$\([^()$\s]*\)|\$\{[^{}$\s]*\}|\$[A-Za-z]"
#: Stands for an escaped dollar while references are looked for.
DOLLAR = "\x01"


def definitions(assigned: DataFrame) -> DataFrame:
    """(path, name, value) from makefiles.variables: += adds to what is there, ?= sets what isn't, the others set."""
    def step(now: Column, x: Column) -> Column:
        return F.when((x["operator"] == "+=") & now.isNotNull(), F.concat(now, F.lit(" "), x["value"])).when((x["operator"] == "?=") & now.isNotNull(), now).otherwise(x["value"])

    found = assigned.groupBy("path", "name").agg(F.array_sort(F.collect_list(F.struct("line", "operator", "value"))).alias("x"))
    return found.select("path", "name", F.aggregate("x", F.lit(None).cast("string"), step).alias("value"))


def modified(value: Column, modifier: Column) -> Column:
    """``:-x`` is x where the value is empty, ``:+x`` where it is not; ``:a=b`` changes the words' ends, ``%`` standing for the rest."""
    left, right = F.regexp_extract(modifier, "^:([^=]*)=(.*)$", 1), F.regexp_extract(modifier, "^:([^=]*)=(.*)$", 2)
    pattern, to = F.when(left.contains("%"), left).otherwise(F.concat(F.lit("%"), left)), F.when(left.contains("%"), right).otherwise(F.concat(F.lit("%"), right))
    part = lambda c, k: F.get(F.split(c, "%", 2), F.lit(k))
    head, tail = part(pattern, 0), part(pattern, 1)

    def word(w: Column) -> Column:
        fits = F.startswith(w, head) & F.endswith(w, tail) & (F.length(w) >= F.length(head) + F.length(tail))
        stem = F.substring(w, F.length(head) + 1, F.length(w) - F.length(head) - F.length(tail))
        new = F.when(to.contains("%"), F.concat(part(to, 0), stem, part(to, 1))).otherwise(to)
        return F.when(fits, new).otherwise(w)

    words = F.array_join(F.transform(F.filter(F.split(value, r"\s+"), lambda w: w != ""), word), " ")
    rest = F.expr("substring(modifier, 3)")
    return (
        F.when(modifier.startswith(":-"), F.when(value == "", rest).otherwise(value))
        .when(modifier.startswith(":+"), F.when(value == "", F.lit("")).otherwise(rest))
        .when(modifier.rlike("^:[^=]*="), words)
        .otherwise(value)
    )


def _substituted(texts: DataFrame, keys: list[str], values: DataFrame, builtin: tuple[str, ...] = (), *, all_named: bool = True) -> DataFrame:
    """texts(keys, text) after one round, and ``odd``: whether putting values in has made references that were not there.

    values(path, name, known): references to names of a known value are put
    in, those to names of none stay. If the values name all there is,
    references to other names are put in as empty, built-in ones by their
    names; else they stay too.
    """
    pieces = texts.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("k", "piece"))
    inside = F.when(F.col("piece").rlike(r"^\$[({]"), F.expr("substring(piece, 3, length(piece) - 3)")).when(F.col("piece").rlike("^\\$[A-Za-z]$"), F.expr("substring(piece, 2)"))
    pieces = pieces.withColumn("of", F.regexp_extract(inside, r"^([^:]*)", 1))
    met = pieces.join(values.select("path", F.col("name").alias("of"), "known", F.lit(True).alias("defined")), ["path", "of"], "left")
    met = met.withColumn("modifier", F.regexp_extract(inside, r"^[^:]*(.*)$", 1))
    # a built-in's value is not known here: its name stays
    other = F.when(F.col("of").isin(*builtin), modified(F.concat(F.lit(DOLLAR + "("), "of", F.lit(")")), F.col("modifier"))).otherwise(modified(F.lit(""), F.col("modifier"))) if all_named else F.col("piece")
    value = F.when(F.col("of").isNull(), F.col("piece")).when(F.col("known").isNotNull(), modified(F.col("known"), F.col("modifier"))).when(F.col("defined"), F.col("piece")).otherwise(other)
    stays = F.col("of").isNotNull() & (F.col("known").isNull() & F.col("defined").isNotNull() if all_named else F.col("known").isNull())
    together = met.select(*keys, "k", value.alias("value"), stays.alias("stays")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "value", "stays"))).alias("x"))
    new = together.select(*keys, F.array_join("x.value", "").alias("text"), F.filter("x", lambda p: p["stays"])["value"].alias("_left"))
    return new.select(*keys, "text", (F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0)) != F.col("_left")).alias("odd"))


def expanded(defined: DataFrame, builtin: tuple[str, ...] = BUILTIN) -> DataFrame:
    """(path, name, value, circular) of definitions(path, name, value): whole values, ``$$`` as ``$``; circular ones as far as they go.

    What is neither defined nor built in is empty, but for a default of its own.
    A value that is known is written once. After the first round only values
    that have just become known are joined, to what is still open; all are, if
    a reference has come up that no text had before.
    """
    is_open = F.col("text").rlike(REFERENCE)
    flagged = lambda df: df.select("path", "name", "text", is_open.alias("open"), "odd")
    now = cut(flagged(defined.select("path", "name", F.replace("value", F.lit("$$"), F.lit(DOLLAR)).alias("text"), F.lit(False).alias("odd"))))
    known, fresh, first = [], now.filter("not open"), True
    while True:
        known.append(fresh)
        rows = now.filter("open")
        every = first or bool(rows.filter("odd").limit(1).count())
        if not every and not fresh.limit(1).count():
            break
        said = fresh
        if every:
            said = reduce(DataFrame.unionByName, known).unionByName(rows)
        values = said.select("path", "name", F.when(~F.col("open"), F.col("text")).alias("known"))
        now = cut(flagged(_substituted(rows.select("path", "name", "text"), ["path", "name"], values, builtin, all_named=every)))
        fresh, first = now.filter("not open"), False
    out = reduce(DataFrame.unionByName, known).unionByName(rows)
    return out.select("path", "name", F.replace("text", F.lit(DOLLAR), F.lit("$")).alias("value"), F.col("open").alias("circular"))


def expanded_texts(texts: DataFrame, values: DataFrame, rounds: int = 8) -> DataFrame:
    """texts(path, id, text, target, prerequisites) with variables and automatic variables put in.

    ``$@`` is the target, ``$<`` the first prerequisite, ``$^`` each once,
    ``$+`` all, ``$*`` the target without its ending. Nested names take a round each.
    """
    known = cut(values.select("path", "name", F.when(~F.col("circular"), F.replace("value", F.lit("$"), F.lit(DOLLAR))).alias("known")))
    now = texts.select("path", "id", F.replace("text", F.lit("$$"), F.lit(DOLLAR)).alias("text"))
    for _ in range(rounds):
        now = cut(now.filter(~F.col("text").rlike(REFERENCE)).unionByName(_substituted(now.filter(F.col("text").rlike(REFERENCE)), ["path", "id"], known).drop("odd")))
        if not now.filter(F.col("text").rlike(REFERENCE)).limit(1).count():
            break
    both = now.join(texts.select("path", "id", "target", "prerequisites"), ["path", "id"])
    put = lambda t, sign, value: F.replace(t, F.lit(sign), F.coalesce(value, F.lit("")))
    text = F.col("text")
    for sign, value in (("$@", F.col("target")), ("$<", F.get("prerequisites", F.lit(0))), ("$^", F.array_join(F.array_distinct("prerequisites"), " ")), ("$+", F.array_join("prerequisites", " ")), ("$*", F.regexp_replace("target", r"\.[^./]*$", ""))):
        text = put(text, sign, value)
    return both.select("path", "id", F.replace(text, F.lit(DOLLAR), F.lit("$")).alias("text"))


def undefined(texts: DataFrame, defined: DataFrame, builtin: tuple[str, ...] = BUILTIN) -> DataFrame:
    """(path, id, name): what texts(path, id, text) refer to that is neither defined nor built in; references with a default are none."""
    refs = texts.select("path", "id", F.explode(F.regexp_extract_all(F.replace("text", F.lit("$$"), F.lit("")), F.lit(REFERENCE), F.lit(0))).alias("ref"))
    names = refs.filter(~F.col("ref").contains(":-")).select("path", "id", F.regexp_extract("ref", r"^\$[({]?([^:)}]*)", 1).alias("name")).distinct()
    return names.filter(~F.col("name").isin(*builtin)).join(defined.select("path", "name").distinct(), ["path", "name"], "left_anti")


def costly_prerequisites(rules: DataFrame, assigned: DataFrame) -> DataFrame:
    """(path, line, name): variables that cost each time they are expanded, in rules(path, line, prerequisites)."""
    used = rules.select("path", "line", F.explode("prerequisites").alias("text")).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))).alias("ref"))
    return used.select("path", "line", F.regexp_extract("ref", r"^\$[({]?([^:)}]*)", 1).alias("name")).distinct().join(costly(assigned), ["path", "name"], "left_semi")
