"""Near copies by SimHash and the exact Jaccard of word shingles, for the pipeline's stage.

Two texts link if the sets of their 5-word shingles have a Jaccard of
``THRESHOLD`` = 0.8 or more. Texts of the same shingles are one node. The
SimHash operator links the nodes whose fingerprints, here of 5-word shingles,
differ in 3 bits at most, which joins the closest copies. Pairs at 0.8 differ in
more bits, up to about 11, for which too many masks were needed. So nodes that are still
apart are candidates too where they share one of ``BANDS`` MinHash bands of
``ROWS`` values: a pair at the threshold is missed with probability
(1 - 0.8^6)^40 = 5e-6, a closer one more seldom. Every link is confirmed on the
shingles themselves.

A node carries four bits of each of its MinHash values. Candidates at the
threshold differ in 45 of the 240 places on average; those that differ in over
``APART`` = 82 are left out before any text is read, wrongly with probability
5e-9. That drops most pairs that merely share a passage. Before all pairs of a
bucket are tried, those are left out whose odd sketches differ in more places
than the sets themselves may: a place holds whether an odd number of shingles
falls on it, so that no two sets differ in fewer shingles than their sketches
in places. Nothing is dropped wrongly there. In a bucket, first all
members are held against one of them; only members that are in different
components by then are held against each other, so a large group costs one
comparison a member and bucket, not its square, unless its links are spread.

Defined results
---------------
* Words are lower-cased and separated by blanks. Fewer than five words: the
  whole sequence is the one shingle. Texts without words are copies of each other.
* Of each component the row of the smallest ``doc_id`` stays. Rows of null id
  link others but stay. Repeated rows of one id become one.
* A text of any length is read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.base import looked_up, stored, text_of
from plumbline.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
PLANES = 4
APART = 82
#: The places of an odd sketch.
PLACES = 1024
SEED = 42


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles, ascending."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values (uint32) of a set that is not empty."""
    rng = np.random.default_rng(SEED)
    times, plus = (rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) for _ in range(2))
    times |= np.uint32(1)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 512):
        np.minimum(least, (half[at : at + 512] * times + plus).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """One hash for each band of MinHash values, as signed longs."""
    import xxhash

    whole = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(whole)], dtype=np.uint64).view(np.int64).tolist()


def planes(least: np.ndarray) -> list[int]:
    """The lowest bits of the MinHash values, 64 of one place in a long, by place."""
    bits = np.zeros((PLANES, -(-len(least) // 64) * 64), dtype=np.uint8)
    for k in range(PLANES):
        bits[k, : len(least)] = (least >> np.uint32(k)) & np.uint32(1)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel().tolist()


def odd_sketch(hashes: np.ndarray) -> list[int]:
    """Of each place whether an odd number of a set's hashes falls on it, 64 places in a long."""
    odd = np.bincount((hashes & np.uint64(PLACES - 1)).astype(np.int64), minlength=PLACES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def unlike(a: str, b: str) -> Column:
    """In how many places two odd sketches differ, never more than the sets do in elements."""
    return reduce(Column.__add__, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(PLACES // 64)])


def differing(a: str, b: str) -> Column:
    """In how many MinHash values the bits of two nodes differ."""
    width = -(-BANDS * ROWS // 64)
    parts = []
    for k in range(width):
        unlike = [F.col(a)[p * width + k].bitwiseXOR(F.col(b)[p * width + k]) for p in range(PLANES)]
        parts.append(F.bit_count(reduce(Column.bitwiseOR, unlike)))
    return reduce(Column.__add__, parts)


def signatures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, node, size, fp, bands, planes, odd): the node is a 128-bit hash of the shingle set; no bands without shingles."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"), F.xxhash64(text_of(text)).alias("text_hash"))

    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for t in batch.column(1):
                s = shingles(t.as_py())
                least = least_values(s) if len(s) else None
                out.append((xxhash.xxh128_hexdigest(s.tobytes()), len(s), np.uint64(simhash.majority(s)).view(np.int64), [] if least is None else bands(least), [] if least is None else planes(least), odd_sketch(s)))
            node, size, fp, band, plane, odd = zip(*out) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(node, pa.string()), pa.array(size, pa.int64()), pa.array(fp, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(plane, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "size", "fp", "bands", "planes", "odd"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, node string, size long, fp long, bands array<long>, planes array<long>, odd array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose texts (node, text) reach the threshold."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        last, of = None, None  # the rows come sorted by a where the join sorts
        for batch in batches:
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for k in range(batch.num_rows):
                node = a[k].as_py()
                if node != last:
                    last, of = node, shingles(ta[k].as_py())
                keep.append(jaccard(of, shingles(tb[k].as_py())) >= threshold)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string")


def alike(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by SimHash: those of one fingerprint, and those that stand for linked fingerprints."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = looked_up(nodes.select("node", "fp"), firsts, ["fp"], "inner").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    x, y = (firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")) for end in ("a", "b"))
    near = simhash.links(firsts.select("fp")).distinct().join(x, "a").join(y, "b")
    return same.union(near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))).distinct()


def links(nodes: DataFrame, texts: DataFrame, *, threshold: float = THRESHOLD, spread: int = 4) -> DataFrame:
    """Edges (a, b) that connect all ``nodes`` (node, size, fp, bands, planes, odd) as their confirmed candidates do.

    Confirmed links are replaced by those of their components' nodes to the smallest one after every round.

    SimHash's links come first. Where the pairs between components are more than
    ``spread`` times the members, members are then held against one of their
    bucket, until under 16 times as many pairs are left or a round finds a link
    for under a hundredth of the members. Then all pairs that are left are tried,
    each once.
    """
    keyed = nodes.select("node", "size", "planes", F.posexplode("bands").alias("band", "hash")).select("node", "size", "planes", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = stored(keyed.join(shared, "bucket"))
    near = stored(alike(nodes.filter("size > 0")))
    named = members.select("node").union(near.select("a")).union(near.select("b")).distinct()
    texts = stored(texts.join(named, "node", "left_semi"))
    close = (F.least("size", "other_size") >= F.lit(threshold) * F.greatest("size", "other_size") - 1e-9) & (differing("planes", "other_planes") <= APART)
    pair = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    found, new, at = stored(confirmed(near, texts, threshold)), 0, 0
    while True:
        of = stored(components(found))
        found = of.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        now = members.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
        now = stored(now.join(mixed, "bucket"))
        sizes = now.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        total = sizes.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).first()
        if not total["n"]:
            return found
        last = total["pairs"] <= spread * (16 if at else 1) * total["n"] or (at > 0 and 100 * new < total["n"])
        first_met = F.lit(True)
        if last:
            # a pair is tried in the first band that both share, not in each
            now = stored(now.join(nodes.select("node", "bands", "odd"), "node"))
            other = now.select("bucket", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("planes").alias("other_planes"), F.col("component").alias("other_component"), F.col("bands").alias("other_bands"), F.col("odd").alias("other_odd"))
            first_met = F.array_position(F.zip_with("bands", "other_bands", lambda x, y: x == y), True) == F.col("band") + 1
            # at the threshold t, sets of a and b elements differ in (a + b) * (1 - t) / (1 + t) at most
            close = close & (unlike("odd", "other_odd") <= (F.col("size") + F.col("other_size")) * (1 - threshold) / (1 + threshold) + 1e-6)
        else:
            first = F.min_by(F.struct("node", "size", "planes", "component"), F.col("node") if at == 0 else F.xxhash64("node", "bucket", F.lit(at)))
            other = now.groupBy("bucket").agg(first.alias("x")).select("bucket", F.col("x.node").alias("other"), F.col("x.size").alias("other_size"), F.col("x.planes").alias("other_planes"), F.col("x.component").alias("other_component"))
        once = F.col("node") < F.col("other") if last else F.lit(True)
        tried = now.join(other, "bucket").filter((F.col("component") != F.col("other_component")) & once & close & first_met).select(*pair).distinct()
        got = stored(confirmed(tried, texts, threshold))
        found, new, at = found.union(got), got.count(), at + 1
        if last:
            return found


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose id is the smallest of their component."""
    found = stored(signatures(docs, doc_id=doc_id, text=text))
    nodes = stored(found.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("planes").alias("planes"), F.first("odd").alias("odd"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("row")))
    # one row stands for each node, so that its text moves once
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text_of(text)).alias("_hash"), text_of(text).alias("text"))
    named = nodes.select("node", "row.doc_id", "row.text_hash")
    texts = rows.join(named, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).select("node", "text").dropDuplicates(["node"])
    edges = links(nodes, texts, threshold=threshold)
    of = components(edges)
    least = nodes.join(of, "node").groupBy("component").agg(F.min("first_id").alias("least_id"))
    merged = of.join(least, "component").select("node", "least_id")
    kept = stored(nodes.join(merged, "node", "left").select("node", F.coalesce("least_id", "first_id").alias("kept_id")))
    dropped = stored(looked_up(found.select("node", "doc_id"), kept, ["node"], "inner").filter(F.col("doc_id") != F.col("kept_id")).select(F.col("doc_id").alias(doc_id)).distinct())
    rest = docs.join(dropped, doc_id, "left_anti").select(*docs.columns)
    twice = stored(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(doc_id)))
    if not twice.limit(1).count():
        return rest
    return rest.join(twice, doc_id, "left_anti").select(*docs.columns).union(rest.join(twice, doc_id, "left_semi").select(*docs.columns).dropDuplicates([doc_id]))
