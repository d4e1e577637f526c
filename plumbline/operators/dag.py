"""Dependency graphs from symbols, layers and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which layer may depend on which.
ALLOWED = (("Presentation", "Application"), ("Presentation", "Domain"), ("Application", "Domain"), ("Application", "Infrastructure"), ("Domain", "Domain"), ("Infrastructure", "Domain"))


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """edges(from, to) between layers(id, layer) that no rule allows; ends without a layer are left alone."""
    allowed = edges.sparkSession.createDataFrame(list(ALLOWED), "from_layer string, to_layer string")  # six rows are broadcast
    of = lambda end: layers.select(F.col("id").alias(end), F.col("layer").alias(f"{end}_layer"))
    return edges.join(of("from"), "from").join(of("to"), "to").join(F.broadcast(allowed), ["from_layer", "to_layer"], "left_anti").select("from", "to", "from_layer", "to_layer")


def _last(symbols: DataFrame, kind: str) -> DataFrame:
    """(name, id) of the kind's symbols, the last of equal names by order."""
    return symbols.filter(F.col("kind") == kind).groupBy("name").agg(F.max_by("id", "order").alias("id"))


def inherits(impls: DataFrame, symbols: DataFrame) -> DataFrame:
    """impls(type_name, trait_name) x symbols(id, name, kind, order) -> Inherits edges from the type to the trait."""
    types, traits = _last(symbols, "Struct"), _last(symbols, "Trait")
    both = impls.join(types.select(F.col("name").alias("type_name"), F.col("id").alias("from")), "type_name").join(traits.select(F.col("name").alias("trait_name"), F.col("id").alias("to")), "trait_name")
    return both.select("from", "to", F.lit("Inherits").alias("edge_type"))


def resolved(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses(use_path) -> (use_path, id): the whole path among types, then functions, then its last part so, else an id of its own."""
    last = F.element_at(F.split("use_path", "::"), -1)
    out, tries = uses.withColumn("last", last), []
    for k, (kind, on) in enumerate((("Struct", "use_path"), ("Function", "use_path"), ("Struct", "last"), ("Function", "last"))):
        out = out.join(_last(symbols, kind).select(F.col("name").alias(on), F.col("id").alias(f"_{k}")), on, "left")
        tries.append(F.col(f"_{k}"))
    return out.select("use_path", F.coalesce(*tries, F.concat(F.lit("external::"), "use_path")).alias("id"))


def by_basename(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names(path, name) x nodes(id, file_path) -> edges(from, to) to the last node whose file has that name."""
    files = nodes.groupBy(F.element_at(F.split("file_path", "/"), -1).alias("name")).agg(F.max("id").alias("to"))
    return names.join(files, "name").join(nodes.select(F.col("file_path").alias("path"), F.col("id").alias("from")), "path").select("from", "to")


def with_metric(files: DataFrame, metrics: DataFrame, key: str, value: str) -> DataFrame:
    """Every file with its largest metric; 0 where it has none."""
    best = metrics.groupBy(key).agg(F.max(value).alias(value))
    return files.join(best, key, "left").na.fill(0, [value])


def with_dependents(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of changed nodes and of those with an edge to one."""
    to = edges.join(changed.select(F.col("id").alias("to")), "to", "left_semi").select(F.col("from").alias("id"))
    return changed.select("id").union(to).distinct()


def merged_proofs(proofs: DataFrame) -> DataFrame:
    """proofs(location, property, method, confidence): the surest of each location and property, ties by method."""
    best = F.max_by(F.struct("method", "confidence"), F.struct("confidence", "method"))
    return proofs.groupBy("location", "property").agg(best.alias("x")).select("location", "property", "x.method", "x.confidence")


def central(metrics: DataFrame, least: float, columns: tuple[str, ...] = ("degree", "betweenness", "closeness")) -> DataFrame:
    """Rows with any centrality of ``least`` or more."""
    return metrics.filter(F.greatest(*columns) >= least)


def transitions(states: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """states(id, state, event) after one step by rules (state, event, next); a pair without a rule stays."""
    table = states.sparkSession.createDataFrame(rules, "state string, event string, next string")  # the rules are broadcast
    return states.join(F.broadcast(table), ["state", "event"], "left").select("id", F.coalesce("next", "state").alias("state"))
