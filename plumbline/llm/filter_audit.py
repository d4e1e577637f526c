"""Filter interaction audit: what each filter takes in each order of the filters.

The corpus is reduced to mask cells: how many documents of a part fail exactly
one set of filters. With five filters a part has 32 cells at most, so the
documents are read once and shuffled as sums.

The orders are visited by adjacent transpositions: each differs from the one
before by one swap of neighbours. Of its steps only the two that were swapped
see other documents before them, so only these are computed anew, from the
cells. A filter's removals are added to its Shapley sum when they change, for
all the orders that they held.

Defined results
---------------
* A null text is empty: under 200 words, no distinct words, no characters; equal to other empty texts.
* A null part is the empty string. Only parts that have a document are shown, all their orders and steps, zeros included.
* A document is a copy if an equal text has a smaller id; rows of null id are no copies and make none. Repeated
  rows count each; of one id none is the other's copy.
* A document is good or toxic if any of its labels says so; rows of null id have none.
* Very long texts are one row like any other. Only the named columns are read, so others can't clash.
* An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import documents, looked_up, stored, text_of, words_of

FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def conditions(text: Column, *, min_words: int = 200, min_distinct: int = 50, max_capitals: int = 3) -> list[Column]:
    """The failures of A to D."""
    words = words_of(text)
    return [
        F.size(words) < min_words,
        100 * F.size(F.array_distinct(words)) < min_distinct * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > max_capitals * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of each document: bit k of the mask is set if it fails filter k. Texts are read once."""
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions(F.col("_text")))]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_of(f"`{text}`").alias("_text"))
    rows = stored(rows.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter(F.col("copies") > 1).drop("copies")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return looked_up(rows, first, ["digest"]).select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", **how) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of a part that fail just these filters."""
    rows = stored(masks(docs, **how))
    marks = labels.select(F.col(label_id).alias("doc_id"), (F.col(quality) == 1).cast("int").alias("good"), (F.col(toxic) == 1).cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = looked_up(rows.filter(F.col("doc_id").isNotNull()), marks, ["doc_id"]).select("part", "mask", "good", "toxic")
    rest = rows.filter(F.col("doc_id").isNull()).select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return known.unionByName(rest).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def swaps(n: int) -> Iterator[int]:
    """The places k at which neighbours k and k + 1 are swapped, one after the other, to visit all orders of n things."""
    if n < 2:
        return
    down = True
    inner = swaps(n - 1)
    while True:
        # the last thing walks through the others, then the others make a swap of their own
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        k = next(inner, None)
        if k is None:
            return
        yield k + 1 if down else k
        down = not down


def walk(cell: pd.DataFrame) -> pd.DataFrame:
    """All orders' steps of one part, from its cells, of which there are 32 at most."""
    name, mask = cell["part"].iloc[0], cell["mask"].to_numpy()
    n, good, toxic = (cell[c].to_numpy() for c in ("n", "good", "toxic"))
    unique = [int(n[mask == 1 << f].sum()) for f in range(len(FILTERS))]

    def step(before: int, f: int) -> tuple[int, ...]:
        left, failing = (mask & before) == 0, (mask >> f) & 1 == 1
        gone = left & failing
        return int(n[left & ~failing].sum()), int(n[gone].sum()), int(n[failing & ~left].sum()), unique[f], int(good[gone].sum()), int(toxic[gone].sum())

    order, before, steps, seen = list(range(len(FILTERS))), 0, [], 0
    for f in order:
        steps.append(step(before, f))
        before |= 1 << f
    since, shapley, out = [0] * len(FILTERS), [0] * len(FILTERS), []

    def emit() -> None:
        letters = "".join(FILTERS[f] for f in order)
        out.extend((name, letters, k + 1, *x, f) for k, (x, f) in enumerate(zip(steps, order, strict=True)))

    emit()
    for k in swaps(len(FILTERS)):
        seen += 1
        for j in (k, k + 1):  # what these two have removed so far
            shapley[order[j]] += steps[j][1] * (seen - since[order[j]])
            since[order[j]] = seen
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        steps[k], steps[k + 1] = step(before, order[k]), step(before | 1 << order[k], order[k + 1])
        emit()
    for k, f in enumerate(order):
        shapley[f] += steps[k][1] * (seen + 1 - since[f])
    found = pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    found["shapley"] = found["shapley"].map(dict(enumerate(shapley)))
    return found


def filter_audit(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """A row for each part, order of the filters and step."""
    return cells(docs, labels, **how).groupBy("part").applyInPandas(walk, SCHEMA)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
first AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN first USING (t) LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
  FROM x a, x b, x c, x d, x e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (
  SELECT filter_order, 1 AS step, b1 AS bit, 0 AS before FROM o UNION ALL SELECT filter_order, 2, b2, b1 FROM o
  UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM o UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM o
  UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM o),
r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
