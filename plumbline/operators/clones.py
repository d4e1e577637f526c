"""Clone detection over fragments(id, tokens ARRAY<STRING>) and over lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.graphs import components, nodes_of
from plumbline.operators.simjoin import similar_sets
from plumbline.session import cut


def normalised(tokens: Column) -> Column:
    """Literals as LITERAL, identifiers as VAR_n by first use within the fragment, so renamed copies agree."""
    words = F.filter(tokens, lambda t: t.rlike(r"^[A-Za-z_]\w*$"))
    order = F.array_distinct(words)
    return F.transform(tokens, lambda t: F.when(t.rlike(r"""^(["'].*|\d.*)$"""), F.lit("LITERAL")).when(t.rlike(r"^[A-Za-z_]\w*$"), F.concat(F.lit("VAR_"), F.array_position(order, t).cast("string"))).otherwise(t))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct hashes of every k tokens in a row; empty for fewer tokens.

    The tokens are bound to a lambda variable first: inlined, the expression
    that makes them would run again for each of its elements.
    """
    none = F.expr("cast(array() as array<bigint>)")

    def of(t: Column) -> Column:
        n = F.size(t)
        return F.when(n >= k, F.array_distinct(F.transform(F.slice(t, 1, F.greatest(n - (k - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get(t, i + j) for j in range(1, k)])))).otherwise(none)

    return F.get(F.transform(F.array(tokens), of), F.lit(0))


def signature(of: Column, hashes: int = 200) -> Column:
    """MinHash signature: for each of ``hashes`` seeded multipliers the least product (modulo 2^64) of a shingle hash; empty sets have the largest."""
    def run(sets: pd.Series) -> pd.Series:
        rng = np.random.default_rng(42)
        by, plus = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
        size = sets.map(len).to_numpy()
        out = np.full((len(sets), hashes), (1 << 63) - 1, dtype=np.int64)
        if size.sum():
            x = np.concatenate(sets[size > 0].to_list()).astype(np.int64).view(np.uint64)
            x = x ^ (x >> np.uint64(32))
            at = np.concatenate([[0], np.cumsum(size[size > 0])[:-1]])
            for k, (m, c) in enumerate(zip(by, plus)):
                out[size > 0, k] = (np.minimum.reduceat(x * m + c, at) >> np.uint64(1)).view(np.int64)
        return pd.Series(list(out))

    return F.pandas_udf(run, "array<long>")(of)


def alike(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def _sets(fragments: DataFrame, k: int) -> DataFrame:
    """(id, s, digest): the sorted shingles of fragments of k tokens or more, and the digest that equal sets share."""
    sets = fragments.filter(F.size("tokens") >= k).select("id", F.sort_array(shingles(F.col("tokens"), k)).alias("s"))
    return sets.withColumn("digest", F.sha2(F.concat_ws(",", F.col("s").cast("array<string>")), 256))


def band_buckets(fragments: DataFrame, *, k: int = 5, hashes: int = 200, bands: int = 20) -> DataFrame:
    """(band, bucket, members) of the buckets with two or more different shingle sets: an estimate of what is alike, without any pair."""
    firsts = _sets(fragments, k).groupBy("digest").agg(F.min_by("s", "id").alias("s"))
    rows = hashes // bands
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice(F.col("sig"), b * rows + 1, F.lit(rows))))
    return firsts.select(signature(F.col("s"), hashes).alias("sig")).select(F.posexplode(keys).alias("band", "bucket")).groupBy("band", "bucket").agg(F.count("*").alias("members")).filter("members > 1")


def similar_pairs(fragments: DataFrame, *, k: int = 5, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity): all pairs whose shingle sets have a Jaccard of the threshold or more, found exactly.

    Fragments of one shingle set are one member of the search, named by their
    least id, so copies add no pairs. Sets without shingles and fragments of
    null id are left out.
    """
    firsts = _sets(fragments.filter("id is not null"), k).groupBy("digest").agg(F.min("id").alias("id"), F.min_by("s", "id").alias("s"))
    return similar_sets(cut(firsts.select("id", "s")), threshold)


def groups_of(fragments: DataFrame, **how) -> DataFrame:
    """(id, group) of every fragment with shingles: equal sets and similar ones, joined up. Groups may have one member."""
    pairs = similar_pairs(fragments, **how)
    sets = cut(_sets(fragments, how.get("k", 5)).select("id", "digest")).hint("merge")
    firsts = sets.groupBy("digest").agg(F.min("id").alias("first"))
    edges = cut(pairs.select(F.col("a").alias("from"), F.col("b").alias("to")))  # the search runs once, not for ends and edges each
    merged = components(nodes_of(edges), edges)
    return sets.join(firsts, "digest").join(merged.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("group"))


def _of_two(of: DataFrame) -> DataFrame:
    sizes = of.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    return of.hint("merge").join(sizes, "group").drop("n")


def clone_groups(fragments: DataFrame, **how) -> DataFrame:
    """(id, group) of every fragment in a group of two or more."""
    return _of_two(groups_of(fragments, **how)).select("id", "group")


def of_copies(each: DataFrame, firsts: DataFrame, groups: DataFrame) -> DataFrame:
    """each(norm, ...) with ``group``, in groups of two or more, from the groups (id, group) of firsts(id, norm), one for each norm."""
    named = firsts.select("id", "norm").hint("merge").join(groups, "id").select("norm", "group")
    return _of_two(cut(each.hint("merge").join(named, "norm")))


def group_summary(groups: DataFrame, fragments: DataFrame) -> DataFrame:
    """(group, fragments, tokens, severity) by ln(tokens) * sqrt(members)."""
    per = groups.join(fragments.select("id", F.size("tokens").alias("t")), "id").groupBy("group").agg(F.count("*").alias("fragments"), F.sum("t").alias("tokens"))
    return per.withColumn("severity", F.round(F.ln(F.greatest("tokens", F.lit(1))) * F.sqrt("fragments"), 6))


def line_windows(lines: DataFrame, m: int, last: bool = True) -> DataFrame:
    """lines(path, line, text) -> (path, start, hash) of every m lines in a row; ``last`` keeps the one that ends the file."""
    w = Window.partitionBy("path").orderBy("line")
    ahead = lines.withColumn("w", F.collect_list(F.trim("text")).over(w.rowsBetween(0, m - 1))).withColumn("left", F.count("*").over(w.rowsBetween(0, m)))
    return ahead.filter(F.col("left") > (m - 1 if last else m)).select("path", F.col("line").alias("start"), F.xxhash64("w").alias("hash"))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(hash, places, files) of windows that occur more than once."""
    return windows.groupBy("hash").agg(F.count("*").alias("places"), F.countDistinct("path").alias("files")).filter("places > 1")
