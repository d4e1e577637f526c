"""Exact set similarity join by prefix filter.

Every set's elements are ordered by how many sets hold them, rarest first.
Two sets of n and m elements with a Jaccard of t share at least
t / (1 + t) * (n + m), so the first element that they share in that order is
among the first n - ceil(t n) + 1 of each: only these prefixes meet. Sizes and
places rule out most of what meets. An element that is in many prefixes is
split: there sets meet by it together with each later element of a prefix
longer by one, since they must share a second one as well. Elements in one set
only are counted, but never shuffled again. What meets is then held by sketches
of 256 places, each odd or even by how many elements fall on it: two of them
differ in no more places than their sets do in elements, so a pair whose
sketches differ in too many is none, and no set is fetched for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def _needed(n: Column, m: Column, t: float) -> Column:
    """The least overlap of sets of n and m elements with a Jaccard of ``t``."""
    return F.ceil(F.lit(t / (1 + t)) * (n + m) - 1e-9)


def _prefix(n: Column, t: float) -> Column:
    return n - F.ceil(F.lit(t) * n - 1e-9) + 1


_SKETCH = ("o0", "o1", "o2", "o3")


def sketch(s: Column) -> list[Column]:
    """o0 to o3: 64 places each, odd where an odd number of elements falls on them."""
    def of(word: int) -> Column:
        step = lambda acc, x: F.when(x.bitwiseAND(F.lit(3)) == word, acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)).cast("int")))).otherwise(acc)
        return F.aggregate(F.transform(s, lambda e: F.xxhash64(e)), F.lit(0).cast("long"), step).alias(f"o{word}")

    return [of(word) for word in range(4)]


def _apart(a: str, b: str) -> Column:
    """In how many places the sketches of two sets differ."""
    bits = [F.bit_count(F.col(f"o{w}_{a}").bitwiseXOR(F.col(f"o{w}_{b}"))) for w in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def prefixes(sets: DataFrame, t: float) -> DataFrame:
    """(id, n, lone, shared, o0 ... o3): a set's size, how many of its elements are in no other set, the others, rarest first, and its sketch."""
    sets = sets.hint("merge")  # no side is sent to all: what is small on disk, as dictionaries are, is large in memory
    posts = sets.select("id", F.explode("s").alias("e"))
    held = posts.groupBy("e").agg(F.count("*").alias("f")).filter("f > 1")
    ranked = posts.join(held, "e").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("x"))
    return ranked.join(sets.select("id", F.size("s").alias("n"), *sketch(F.col("s"))), "id").select("id", "n", (F.col("n") - F.size("x")).alias("lone"), F.col("x.e").alias("shared"), *_SKETCH)


def candidates(ranked: DataFrame, t: float, hot: int = 100) -> DataFrame:
    """(a, b) of the sets that share elements enough in their prefixes and whose sketches are near enough, a < b."""
    length = F.greatest(F.lit(0), _prefix(F.col("n"), t) - F.col("lone")).cast("int")
    posts = ranked.select("id", "n", F.posexplode(F.slice("shared", F.lit(1), length)).alias("k", "e"), "lone", *_SKETCH).select("id", "n", (F.col("lone") + F.col("k")).alias("place"), "e", *_SKETCH)
    often = cut(posts.groupBy("e").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("e"))
    posts = posts.join(often.withColumn("often", F.lit(True)), "e", "left")
    single = posts.filter("often is null").select("id", "n", "place", "e", F.lit(None).cast("long").alias("e2"), *_SKETCH)
    longer = ranked.select("id", "n", "lone", F.slice("shared", F.lit(1), F.when(length > 0, length + 1).otherwise(0)).alias("x"), *_SKETCH)
    wide = posts.filter("often").select("id", "n", "place", "e").join(longer.select("id", "lone", "x", *_SKETCH), "id")
    later = F.expr("slice(x, place - lone + 2, size(x))")
    double = wide.select("id", "n", "place", "e", F.posexplode(later).alias("k", "e2"), *_SKETCH).select("id", "n", (F.col("place") + 1 + F.col("k")).alias("place"), "e", "e2", *_SKETCH)
    keyed = cut(single.unionByName(double).withColumn("seen", F.when(F.col("e2").isNull(), 1).otherwise(2)).withColumn("e2", F.coalesce("e2", F.lit(0)))).hint("merge")
    left, right = (keyed.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("place").alias(f"p_{c}"), "seen", "e", "e2", *[F.col(o).alias(f"{o}_{c}") for o in _SKETCH]) for c in ("a", "b"))
    need = _needed(F.col("n_a"), F.col("n_b"), t)
    rest = F.col("seen") + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) - 1
    near = F.least("n_a", "n_b") >= F.lit(t) * F.greatest("n_a", "n_b") - 1e-9
    alike = _apart("a", "b") <= F.col("n_a") + F.col("n_b") - 2 * need
    return left.join(right, ["seen", "e", "e2"]).filter((F.col("a") < F.col("b")) & near & (rest >= need) & alike).select("a", "b").distinct()


def similar_sets(sets: DataFrame, threshold: float = 0.7, *, hot: int = 100) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of sets(id, s ARRAY<BIGINT>) whose Jaccard is the threshold or more.

    The sets must differ from one another (equal ones are for the caller to
    put together) and have no element twice; ids must not be null. Sets
    without elements are like no other. ``hot`` is how many prefixes may hold
    an element before it is split.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be over 0.5: below, different sets of two elements may share one only")
    ranked = cut(prefixes(sets, threshold)).hint("merge")
    pairs = candidates(ranked, threshold, hot)
    of = lambda c: ranked.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"s_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    same = F.size(F.array_intersect("s_a", "s_b"))
    found = both.select("a", "b", (same / (F.col("n_a") + F.col("n_b") - same)).alias("similarity"))
    return found.filter(F.col("similarity") >= threshold - 1e-12)
