"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words by weight, at most ``most`` times
its own words; what others can't take is shared again by weight. A document
expects target / words of its source copies, or, with document weights, copies
in proportion to its weight, ``most`` at most. The whole part of that is
certain. The fraction p is left to a sample of fixed size: documents are ranked
by the odds of a random number over the odds of p, and taken in that order
while the source's words last. So a document is taken with nearly its own
probability, while the size of the sample, in words, doesn't vary.

Where the next document in order doesn't fit any more, those after it that fit
are taken, and at last one more, or one for another, if that brings the words
nearer to the target. At least ``spare`` documents on both sides of the place
where the words run out, or all that there are, are looked at for this.

No task gets a source: ranks are put in ``BINS`` bins, whose words are summed
for each source. Only the bin in which a source's words run out, and those
beside it that hold the spare documents, are put in order, in one task for each
source; about a four-thousandth of its documents.

Defined results
---------------
* A null text has no words. A document without words takes none. A very long text is one row like any other.
* A null source is a source, the last one. A source without words has target 0.
* The random number comes from seed, doc_id and text, so reruns agree however rows are dealt. Repeated rows of
  a source count each, tie, and take their places one after the other; which one is which can't be told.
* A document that the rest of the target can't hold has inclusion 0 and comes last.
* ``mixed`` keeps all columns, whatever their names, and writes a document as often as it is taken.
* An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.base import carried, documents, looked_up, stored, text_of, unpacked

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
NEVER = 2 * BINS


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(_key, source, source_size, target) from documents' (_key, source, size).

    Sources by code point, null last, have the weights in turn. With sources in
    the order of how soon they are full, the first k are held at ``most`` times
    their words where the level of the others would lift them higher.
    """
    found = sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    order, soon = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("_full", "_key")
    found = found.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    found = found.withColumn("_cap", (most * F.col("source_size")).cast("double")).withColumn("_full", F.col("_cap") / F.col("_w"))
    all_rows, below = soon.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), soon.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))
    found = found.withColumn("_level", left / F.sum("_w").over(soon.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_full", "_key", "_level"))).over(all_rows)["_level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return found.select("_key", "source", "source_size", target.alias("target"))


def _joined(rows: DataFrame, few: DataFrame, n: int, most_broadcast: int = 100_000) -> DataFrame:
    """``rows`` with what is known of their source, ``n`` rows: broadcast while that is small."""
    return rows.join(F.broadcast(few), "_key") if n <= most_broadcast else looked_up(rows, few, ["_key"], "inner")


def expected(rows: DataFrame, goals: DataFrame, n_sources: int, *, most: int) -> DataFrame:
    """``rows`` with ``expects``, the copies of each, in proportion to ``weight`` and ``most`` at most.

    Documents that reach ``most`` stay there and the rest is shared anew, until no other one does.
    """
    held, before = rows.withColumn("_held", F.lit(False)), -1
    while True:
        free = F.when(F.col("_held"), 0).otherwise(F.col("size") * F.col("weight"))
        sums = held.groupBy("_key").agg(F.sum(free).alias("_free"), F.sum(F.when(F.col("_held"), F.col("size") * most).otherwise(0)).alias("_fixed"))
        level = F.when(F.col("_free") > 0, (F.col("target") - F.col("_fixed")) / F.col("_free")).otherwise(0.0)
        sums = goals.join(sums, "_key").select("_key", level.alias("_share"))
        held = _joined(held, sums, n_sources)
        copies = F.when(F.col("_held"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("_share") * F.col("weight"))))
        held = stored(held.withColumn("expects", copies).withColumn("_held", F.col("expects") >= most).drop("_share"))
        now = held.filter("_held").count()
        if now == before or now == 0:
            return held.drop("_held")
        before = now


def place(u: Column, p: Column) -> Column:
    """The rank of a document in (0, 1]: odds of ``u`` over odds of ``p``, as a share; 1 where ``p`` is 0."""
    a, b = u * (1 - p), (1 - u) * p
    return F.when(p <= 0, 1.0).otherwise(a / (a + b))


def cuts(ranked: DataFrame, rest: DataFrame, spare: int) -> DataFrame:
    """For each source (_key) whose ``rest`` words run out: the first and last of the bins around that place, and the words before them."""
    w = Window.partitionBy("_key").orderBy("bin")
    bins = ranked.groupBy("_key", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    bins = stored(bins.withColumn("run", F.sum("words").over(w)).withColumn("docs_run", F.sum("docs").over(w)).join(rest, "_key"))
    over = bins.filter(F.col("run") > F.col("rest")).groupBy("_key").agg(F.min(F.struct("bin", (F.col("docs_run") - F.col("docs")).alias("docs_before"), "docs_run")).alias("at"))
    near = bins.join(over, "_key").withColumn("before", F.col("run") - F.col("words"))
    start = near.filter(F.col("docs_run") > F.col("at.docs_before") - spare).groupBy("_key").agg(F.min(F.struct("bin", "before")).alias("start"))
    last = near.filter(F.col("docs_run") >= F.col("at.docs_run") + spare).groupBy("_key").agg(F.min("bin").alias("last"))
    return start.join(last, "_key", "left").select("_key", F.col("start.bin").alias("first"), F.col("start.before").alias("before"), F.coalesce("last", F.lit(NEVER)).alias("last"))


def closed(group: pd.DataFrame) -> pd.DataFrame:
    """Takes documents around the cut of one source in order, while they fit."""
    group = group.sort_values(["place", "doc_id", "size"], na_position="last", kind="stable")
    size = group["size"].to_numpy(np.int64)
    left = float(group["rest"].iloc[0] - group["before"].iloc[0])
    chosen = np.cumsum(size) <= left
    left -= float(size[chosen].sum())
    for k in np.flatnonzero(~chosen & (size <= left)):
        if size[k] <= left:
            chosen[k] = True
            left -= float(size[k])
    # one document more, or one for another, if that comes nearer
    others, mine = np.flatnonzero(~chosen), np.flatnonzero(chosen)
    if len(others):
        mine = mine[np.argsort(size[mine], kind="stable")]
        given = np.concatenate([[0], size[mine]])
        for side in (-1, 0):
            at = np.clip(np.searchsorted(given, size[others] - left) + side, 0, len(given) - 1)
            off = np.abs(size[others] - given[at] - left)
            if side == -1 or off.min() < best[0]:
                best = (off.min(), others[off.argmin()], at[off.argmin()])
        if best[0] < left:
            chosen[best[1]] = True
            if best[2]:
                chosen[mine[best[2] - 1]] = False
    return group.assign(chosen=chosen.astype("int32"))[["row_id", "doc_id", "_key", "size", "whole", "chosen"]]


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 42, spare: int = 1000, row_id: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each document, and its ``row_id`` where one is named."""
    key = F.when(F.col(f"`{source}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")))
    draw = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").cast("string"), text_of(f"`{text}`"))
    rows = docs.select(
        (F.col(f"`{row_id}`").cast("long") if row_id else F.lit(None).cast("long")).alias("row_id"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        key.alias("_key"),
        F.regexp_count(text_of(f"`{text}`"), F.lit(WORD)).cast("long").alias("size"),
        ((F.shiftrightunsigned(draw, 11) + 0.5) / float(1 << 53)).alias("u"),
        (F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)).alias("weight"),
    )
    rows = stored(rows)
    goals = stored(targets(rows, weights=weights, most=most))
    n_sources = goals.count()
    if weight:
        rows = expected(rows, goals, n_sources, most=most)
    else:
        share = goals.select("_key", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("expects"))
        rows = _joined(rows, share, n_sources)
    rows = rows.withColumn("whole", F.floor("expects").cast("long"))
    rest = goals.join(rows.groupBy("_key").agg(F.sum(F.col("whole") * F.col("size")).alias("sure")), "_key").select("_key", F.greatest(F.lit(0.0), F.col("target") - F.col("sure")).alias("rest"))
    rest = stored(rest)
    open_ = (F.col("whole") < most) & (F.col("size") > 0)
    p = F.when(F.col("size") <= F.col("rest"), F.col("expects") - F.col("whole")).otherwise(0.0)
    rows = _joined(rows, rest, n_sources).withColumn("place", F.when(open_, place(F.col("u"), p)))
    rows = stored(rows.select("row_id", "doc_id", "_key", "size", "whole", "rest", "place", F.floor(F.col("place") * BINS).cast("int").alias("bin")))
    at = stored(cuts(rows.filter("bin is not null"), rest, spare))
    state = rows.join(F.broadcast(at), "_key", "left") if n_sources <= 100_000 else looked_up(rows, at, ["_key"])
    near = F.coalesce((F.col("bin") >= F.col("first")) & (F.col("bin") <= F.col("last")), F.lit(False))
    sure = F.coalesce(F.col("bin") < F.coalesce("first", F.lit(NEVER)), F.lit(False)).cast("int")
    far = state.filter(~near).select("row_id", "doc_id", "_key", "size", "whole", sure.alias("chosen"))
    kinds = dict(rows.dtypes)
    edge = state.filter(near).select("row_id", "doc_id", "_key", "size", "whole", "rest", "before", "place").groupBy("_key").applyInPandas(closed, f"row_id long, doc_id {kinds['doc_id']}, _key string, size long, whole long, chosen int")
    copies = (F.col("whole") + F.col("chosen")).cast("long")
    out = _joined(far.unionByName(edge), goals, n_sources)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", *(["row_id"] if row_id else []))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the documents, all their columns, each as often as it is taken."""
    rows = stored(docs.select(carried(docs)).withColumn("_id", F.monotonically_increasing_id()))
    found = mix_sources(rows.select("_row.*", F.col("_id").alias("_mixed_id")), row_id="_mixed_id", **how).filter("copies > 0").select(F.col("row_id").alias("_id"), "copies")
    return rows.join(found, "_id").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*unpacked(docs.columns))


def op12_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
