"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; two link if they differ in at most ``RADIUS`` = 3.
Each bit position gets a non-zero vector of F_2^4. For each of the 15 non-zero
v, table v keeps the bits whose vector has an odd inner product with v. For any
three positions some v is orthogonal to all their vectors, so whatever three
bits differ, one table masks them all: every pair within the radius shares a
bucket of some table. Candidates are verified on the fingerprints.

Only distinct fingerprints are searched. A bucket of more than ``bucket_limit``
of them is covered again, by other vectors, within the bucket; each level
leaves under half the free bits, so buckets shrink below the limit after a few
levels, and levels go on until none is larger. Within a bucket a spanning forest of its links is found, not all
pairs.

Defined results
---------------
* A null or wordless text has fingerprint zero and links like any other.
* Fewer than three words: the whole sequence is the one shingle.
* A text of any length is read whole. A bit that is set in exactly half the hashes is 0.
* Repeated rows give repeated result rows; a null ``doc_id`` is never a
  component's id unless the component has no other.
* An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import documents, looked_up, stored, text_of
from plumbline.llm.components import components

RADIUS = 3
VECTORS = 15
SEED = 42


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes ``h`` (uint64)."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):  # bits of a bounded number of hashes at a time
        part = np.ascontiguousarray(h[at : at + 8192])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8"))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def masks(level: int) -> list[int]:
    """The 15 masks of one level, as signed longs. Levels deal the vectors to the positions in other orders."""
    order = np.random.default_rng(level).permutation(64)
    vector = np.empty(64, dtype=np.int64)
    vector[order] = 1 + np.arange(64) % VECTORS
    found = []
    for v in range(1, VECTORS + 1):
        bits = sum(1 << i for i in range(64) if bin(int(vector[i]) & v).count("1") % 2)
        found.append(bits - (1 << 64) if bits >> 63 else bits)
    return found


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``fps`` (uint64, distinct)."""
    rest, edges = fps, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                linked = rest[near]
                edges += [(int(x), int(y)) for y in linked]
                front += list(linked)
                rest = rest[~near]
    return edges


def _links_in(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            edges = [e for fps in batch.column(0) for e in spanning_links(np.array(fps.as_py(), dtype=np.int64).view(np.uint64), radius)]
            pairs = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, *, radius: int = RADIUS, bucket_limit: int = 512) -> DataFrame:
    """Edges (a, b) that connect all fingerprints ``fp`` of ``distinct`` within the radius."""
    if radius > RADIUS:
        raise ValueError("the masks cover a radius of 3 at most")
    rows, level, found = distinct.select(F.lit(0).cast("long").alias("key"), "fp"), 0, None
    while True:
        keyed = rows.select(F.col("fp"), F.explode(F.array(*[F.xxhash64("key", F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(masks(level))])).alias("key"))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        shared = stored(keyed.join(sizes, "key"))
        cold = shared.filter(F.col("n") <= bucket_limit).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        got = _links_in(cold, radius)
        found = got if found is None else found.union(got)
        rows, level = shared.filter(F.col("n") > bucket_limit).select("key", "fp"), level + 1
        if not rows.limit(1).count():
            return found


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket_limit: int = 512) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, one row for each document."""
    fps = stored(fingerprints(docs, doc_id=doc_id, text=text))
    firsts = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    of = components(links(firsts, radius=radius, bucket_limit=bucket_limit)).withColumnRenamed("node", "fp")
    groups = firsts.join(of, "fp").groupBy("component").agg(F.min("first_id").alias("least_id"))
    merged = of.join(groups, "component").select("fp", "least_id")
    final = stored(firsts.join(merged, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")))
    return looked_up(fps, final, ["fp"], "inner").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents whose id is their component's; repeated rows of one id become one.

    Rows of null id can't be told apart by id and stay.
    """
    found = near_duplicates(docs, **how)
    dropped = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    rest = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    twice = stored(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not twice.limit(1).count():
        return rest
    return rest.join(twice, "doc_id", "left_anti").select(*docs.columns).union(rest.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
