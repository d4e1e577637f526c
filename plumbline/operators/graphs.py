"""Graph operators over edges(from, to[, weight, edge_type]) and nodes(id).

Loops are rounds of joins and aggregations that end when nothing is new; each round's table is
checkpointed, so neither the plan nor a lost executor's work grows with the
rounds.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from").alias("id")).union(edges.select(F.col("to").alias("id"))).distinct()


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")


def by_type(nodes: DataFrame, edges: DataFrame, edge_type: str) -> tuple[DataFrame, DataFrame]:
    """The edges of a type and the nodes they touch; all nodes only if the graph has no edges at all."""
    kept = edges.filter(F.col("edge_type") == edge_type)
    any_edge = edges.limit(1).agg(F.count("*").alias("any_edge"))
    touched = nodes_of(kept).withColumn("touched", F.lit(True))
    found = nodes.join(touched, "id", "left").crossJoin(F.broadcast(any_edge)).filter(F.col("touched") | (F.col("any_edge") == 0))  # one row is broadcast
    return found.drop("touched", "any_edge"), kept


def edge_budget(edges: DataFrame, most: int = 400) -> DataFrame:
    """The first edges by type priority (inherits, uses, implements, calls, imports), then ends."""
    order = F.array(*[F.lit(x) for x in ("Inherits", "Uses", "Implements", "Calls", "Imports")])
    return edges.orderBy(F.array_position(order, F.col("edge_type")), "from", "to").limit(most)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree_centrality); centrality is 0 in a graph of one node."""
    out = edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("in_degree"))
    n = nodes.agg(F.count("*").alias("n"))
    both = nodes.select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out_degree", "in_degree"]).crossJoin(F.broadcast(n))
    return both.select("id", "in_degree", "out_degree", F.round(F.when(F.col("n") > 1, (F.col("in_degree") + F.col("out_degree")) / (F.col("n") - 1)).otherwise(0.0), 6).alias("degree_centrality"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, density, average_degree, max_degree)."""
    d = degrees(nodes, edges).agg(F.count("*").alias("nodes"), (F.sum(F.col("in_degree") + F.col("out_degree")) / 2).cast("long").alias("edges"), F.max(F.col("in_degree") + F.col("out_degree")).alias("max_degree"))
    n, e = F.col("nodes"), F.col("edges")
    return d.select("nodes", "edges", F.round(F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0), 6).alias("density"), F.round(2 * e / n, 6).alias("average_degree"), "max_degree")


def component_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, components, largest): how many weak components there are, and the nodes of the largest."""
    sizes = components(nodes.select("id"), edges).groupBy("component").agg(F.count("*").alias("n"))
    per = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return per.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges")))).select("nodes", "edges", "components", "largest")  # one row each


def pagerank(nodes: DataFrame, edges: DataFrame, *, rounds: int = 10, damping: float = 0.85, normalised: bool = False, dangling: bool = False, threshold: float | None = None, seeds: DataFrame | None = None, cut_every: int = 5) -> DataFrame:
    """(id, rank).

    Plain: ranks start at 1 and stay unnormalised, sinks lose their mass.
    ``normalised``: start and base are shares of 1 / n. ``dangling``: sinks
    spread their mass evenly. ``seeds`` start at twice the share.
    ``threshold``: stop once the ranks move less in sum.
    """
    out = edges.groupBy("from").agg(F.count("*").alias("out"))
    links = cut(edges.select("from", "to").join(out, "from"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    start = 1.0 / n if normalised else 1.0
    base = (1 - damping) / n if normalised else 1 - damping
    rank = nodes.select("id", F.lit(start).alias("rank"))
    if seeds is not None:
        rank = nodes.join(seeds.select("id", F.lit(True).alias("seed")), "id", "left").select("id", F.when(F.col("seed"), 2 * start).otherwise(start).alias("rank"))
    sinks = nodes.select("id").join(out.select(F.col("from").alias("id")), "id", "left_anti") if dangling else None
    rank = cut(rank)
    for k in range(rounds):
        got = links.join(rank, links["from"] == rank["id"]).groupBy("to").agg(F.sum(F.col("rank") / F.col("out")).alias("got")).withColumnRenamed("to", "id")
        new = nodes.select("id").join(got, "id", "left")
        value = F.lit(base) + damping * F.coalesce("got", F.lit(0.0))
        if dangling:
            lost = rank.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            new, value = new.crossJoin(F.broadcast(lost)), value + damping * F.col("lost") / n  # one row is broadcast
        new = new.select("id", value.alias("rank"))
        if threshold is None:
            rank = cut(new) if (k + 1) % cut_every == 0 else new
            continue
        new = cut(new)
        moved = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new
        if moved < threshold:
            break
    return rank


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, id, distance) of every node that a source reaches, the source itself at 0, by breadth-first rounds until none is new.

    The table has a row for each pair: give ``sources`` on a large graph.
    """
    start = (sources or nodes).select(F.col("id").alias("source"), "id", F.lit(0).alias("distance"))
    seen, front, steps = cut(start), start, edges.select("from", "to").filter(F.col("from") != F.col("to")).distinct()
    for k in count(1):
        front = front.join(steps, front["id"] == steps["from"]).select("source", F.col("to").alias("id")).distinct().join(seen.select("source", "id"), ["source", "id"], "left_anti").withColumn("distance", F.lit(k))
        front = cut(front)
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def reachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(id) of the nodes that any entry reaches, entries included; cycles end with the frontier."""
    front = seen = cut(entries.join(nodes.select("id"), "id", "left_semi").select("id").distinct())
    steps = cut(edges.select("from", "to"))  # each round reads them
    for k in count(1):
        front = cut(front.join(steps, front["id"] == steps["from"]).select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front)) if k % 4 == 0 else seen.union(front)
    return seen


def closeness(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(n - 1) / sum of distances to the nodes that a node reaches; 0 if it reaches none."""
    n = nodes.agg(F.count("*").alias("n"))
    far = paths.filter("distance > 0").groupBy(F.col("source").alias("id")).agg(F.sum("distance").alias("far"))
    return nodes.select("id").join(far, "id", "left").crossJoin(F.broadcast(n)).select("id", F.round(F.coalesce((F.col("n") - 1) / F.col("far"), F.lit(0.0)), 6).alias("closeness"))


def betweenness(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Share of ordered pairs with the node on a shortest path, from the table of distances."""
    p = paths.filter("distance > 0")
    a, b = p.select("source", F.col("id").alias("via"), F.col("distance").alias("d1")), p.select(F.col("source").alias("via"), F.col("id").alias("target"), F.col("distance").alias("d2"))
    on = a.join(b, "via").filter(F.col("source") != F.col("target")).join(p.select("source", F.col("id").alias("target"), "distance"), ["source", "target"]).filter(F.col("d1") + F.col("d2") == F.col("distance"))
    counts = on.groupBy(F.col("via").alias("id")).agg(F.count("*").alias("c"))
    n = nodes.agg(F.count("*").alias("n"))
    return nodes.select("id").join(counts, "id", "left").crossJoin(F.broadcast(n)).select("id", F.round(F.when(F.col("n") > 2, F.coalesce("c", F.lit(0)) / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0), 6).alias("betweenness"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that a node reaches when directions don't count.

    Repeated edges change nothing; they are not looked for, as a task would
    have to keep all of its edges in memory.
    """
    once = cut(edges.select("from", "to"))
    both = once.union(once.select("to", "from"))
    label = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        got = both.join(label, both["from"] == label["id"]).groupBy(F.col("to").alias("id")).agg(F.min("component").alias("low"))
        new = label.join(got, "id", "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"))
        # a label's own label: halves the rounds along a path
        up = new.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        new = cut(new.join(up, "component", "left").select("id", F.least("component", F.coalesce("upper", "component")).alias("component")))
        if not new.join(label.withColumnRenamed("component", "old"), "id").filter(F.col("component") != F.col("old")).limit(1).count():
            return new
        label = new


def hubs(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The k nodes of the highest degree and rank together, ties by id."""
    found = degrees(nodes, edges).join(pagerank(nodes, edges, normalised=True), "id")
    score = F.round(F.col("degree_centrality") + F.col("rank"), 6)
    return found.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def pruned(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nodes of the highest fixed-round rank, and the edges between them."""
    ranks = pagerank(nodes, edges).select("id", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(k)
    kept = nodes.join(F.broadcast(ranks.select("id")), "id", "left_semi")  # k rows are broadcast
    return kept, without_dangling(edges, kept)


def component_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """members(id, component): weights between different components."""
    m = members.select("id", "component")
    out = edges.join(m.withColumnRenamed("component", "from_component"), edges["from"] == m["id"]).drop("id")
    out = out.join(m.withColumnRenamed("component", "to_component"), out["to"] == m["id"]).drop("id")
    return out.filter(F.col("from_component") != F.col("to_component")).groupBy("from_component", "to_component").agg(F.sum("weight").alias("weight"), F.count("*").alias("edges"))


def group_budget(ranks: DataFrame, most: int) -> DataFrame:
    """ranks(id, group, rank): whole groups by falling rank sum while their nodes fit in ``most``."""
    per = ranks.groupBy("group").agg(F.count("*").alias("size"), F.round(F.sum("rank"), 9).alias("score"))
    per = per.orderBy(F.desc("score"), "group").limit(most)  # a group has a node at least, so no more fit
    w = Window.orderBy(F.desc("score"), "group").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("running", F.sum("size").over(w)).filter(F.col("running") <= most)
