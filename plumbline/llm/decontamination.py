"""Benchmark decontamination by containment search, in DataFrame functions only.

Items are partitioned by size (powers of two of their distinct shingles). Each
partition has its own MinHash sketch length: with an upper size ``u`` and a
threshold ``t`` the ``floor((1 - t) * u) + 1`` smallest shingle hashes of an
item are its sketch. A document that contains a share ``t`` of the item's
shingles misses fewer than that many, so at least one sketch hash occurs in it,
however long it is: the search loses no pair. Every document's shingle hashes
are looked up in the sketches; pairs found are verified by exact shingle
containment on the shingles' text.

Words are maximal runs of letters and digits of the lower-cased text, so added
punctuation hides nothing. A shingle is five words; an item of fewer words is
one shingle of all of them, found only in a document of exactly those words.

Defined results
---------------
* A null or wordless document or item is in no pair. A text of any length is searched whole.
* Ties: an item that a document holds in full and one that it holds to the threshold are both reported.
* Repeated document rows give repeated pairs; an item_id given twice counts as
  two items of equal id, merged as one (its shingles are united).
* Empty tables give an empty result. Only the named columns are read; all others, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.base import broadcast_if, carried, documents, looked_up, stored, text_of, unpacked

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Sketch hashes or shingles up to which the items' side is broadcast (about 60 MB).
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _shingle_texts(words: Column, size: int) -> Column:
    """Distinct shingles as text: the whole sequence if it is shorter than ``size``."""
    long = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(1))), lambda x, i: F.concat_ws(" ", x, *[F.get(words, i + k) for k in range(1, size)]))
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.size(words) >= size, F.array_distinct(long)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(none)


def item_shingles(items: DataFrame, *, item_id: str = "item_id", text: str = "text", size: int = 5) -> DataFrame:
    """Rows (item_id, shingle, hash, n): an item's distinct shingles and their number."""
    rows = items.select(F.col(item_id).alias("item_id"), _words(text_of(text)).alias("w"))
    rows = rows.select("item_id", F.explode(_shingle_texts(F.col("w"), size)).alias("shingle")).distinct()
    counts = rows.groupBy(F.col("item_id").alias("_id")).agg(F.count("*").alias("n"))
    return rows.join(counts, F.col("item_id").eqNullSafe(F.col("_id"))).select("item_id", "shingle", F.xxhash64("shingle").alias("hash"), "n")


def item_sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """Rows (item_id, hash): the smallest hashes of each item, as many as its size partition needs."""
    upper = F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1)
    length = F.floor((1 - threshold) * upper + 1e-9) + 1
    smallest = Window.partitionBy("item_id").orderBy("hash", "shingle")
    return shingles.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= length).select("item_id", "hash")


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_shingles, n_found, containment) with containment at or over ``threshold``."""
    found = contaminated_texts(docs, items, text=text, item_id=item_id, item_text=item_text, size=size, threshold=threshold)
    # one row for each text, so that a text with many copies can be split
    pairs = ["item_id", "n_shingles", "n_found", "containment"]
    listed = stored(found.groupBy("text_hash").agg(F.collect_list(F.struct(*pairs)).alias("pairs")))
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash")))
    return looked_up(rows, listed, ["text_hash"], "inner").select("doc_id", F.inline("pairs"))


def contaminated_texts(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (text_hash, item_id, ...) over the distinct texts; copies of a text are judged once."""
    shingles = stored(item_shingles(items, item_id=item_id, text=item_text, size=size))
    total = shingles.count()
    sketches = item_sketches(shingles, threshold).select("item_id", "hash")
    short = shingles.filter(F.instr("shingle", " ") == 0).limit(1).count() > 0 or shingles.filter(F.size(F.split("shingle", " ")) < size).limit(1).count() > 0

    words = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), _words(text_of(text)).alias("w"))
    w = F.col("w")
    joined = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, size)])))
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    none = F.expr("cast(array() as array<bigint>)")
    hashes = F.when(F.size(w) >= size, joined).when(F.lit(short) & (F.size(w) > 0), whole).otherwise(none)
    looked_up = words.select("text_hash", F.explode(hashes).alias("hash"))
    candidates = stored(looked_up.join(broadcast_if(sketches, total, BROADCAST_ROWS), "hash").select("text_hash", "item_id").distinct())

    texts = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    texts = texts.join(candidates.select("text_hash").distinct(), "text_hash", "left_semi")
    # the words are a column of their own: inside the lambda they would be split again for every shingle
    held = texts.select("text_hash", _words(F.col("text")).alias("w")).select("text_hash", F.explode(_shingle_texts(w, size)).alias("shingle"))
    matched = held.join(broadcast_if(shingles.select("item_id", "shingle", "n"), total, BROADCAST_ROWS), "shingle").select("text_hash", "item_id", "shingle", "n").distinct()
    counted = matched.groupBy("text_hash", "item_id").agg(F.count("*").alias("n_found"), F.max("n").alias("n_shingles"))
    return (
        counted.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
        .filter(F.col("n_found") >= threshold * F.col("n_shingles") - 1e-9)
        .join(candidates, ["text_hash", "item_id"], "left_semi")
        .select("text_hash", "item_id", "n_shingles", "n_found", "containment")
    )


def decontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The documents that contain no item."""
    found = stored(contaminated_texts(docs, items, text=text, **how).select("text_hash").distinct())
    rows = docs.select(carried(docs), F.xxhash64(text_of(text)).alias("text_hash"))
    return rows.join(broadcast_if(found, found.count(), BROADCAST_ROWS), "text_hash", "left_anti").select(*unpacked(docs.columns))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH a AS (
  SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
b AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
sa AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM a WHERE len(w) > 0)),
sb AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM sa GROUP BY id)
SELECT sb.id AS doc_id, sa.id AS item_id, max(n.n) AS n_shingles, count(*) AS n_found, count(*)::DOUBLE / max(n.n) AS containment
FROM sb JOIN sa USING (s) JOIN n ON n.id = sa.id
GROUP BY sb.id, sa.id HAVING count(*) >= 0.8 * max(n.n) - 1e-9
"""
