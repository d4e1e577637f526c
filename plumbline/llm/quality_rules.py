"""Quality rules by cross-document line frequency, in DataFrame functions only.

One pass over the texts stores each document's word and line statistics and
its normalised lines' hashes (lower case, blanks collapsed). For each host the
distinct documents that hold a line are counted. A line over the limits is
boilerplate and is taken out of the text; a document that loses most of its
words so is depleted and rejected.

A line that only copies of a few texts share is no boilerplate: a line over
the limits stands in more than ``min_texts`` different texts as well. Copies
are left to near-duplicate removal, which keeps one of them. In a host of under
ten times ``min_texts`` documents, over a tenth of them, but over ``least``, are
enough, of documents and of texts.

Defined results
---------------
* A null text counts as empty: no words, hence ``base_failed``. A very long one is one row like any other.
* A null host is the host ``''``.
* Documents are told apart by doc_id: repeated rows count once for the line frequency, rows of null id don't.
  Copies of one text get the same verdict, as ties do.
* Repeated rows give one result row each. All other columns of the input, whatever their names, are kept
  as they are; only ``n_chars``, where there is one, follows a changed text.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import BLANKS, broadcast_if, carried, documents, looked_up, stored, text_of, with_text, words_of

SYMBOLS = r"[#*$%&|<>]"
NO_LINES = "cast(array() as array<struct<line:bigint,n:int>>)"


def line_key(line: Column) -> Column:
    """The hash of a normalised line."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), BLANKS, " ")))


def _lines(text: Column) -> Column:
    """The lines with a word, as (hash, number of words)."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(line_key(x).alias("line"), F.size(words_of(x)).alias("n")))


def frequent_lines(profiles: DataFrame, *, min_docs: int = 50, min_texts: int = 50, least: int = 5, max_share: float = 0.05, most_hosts: int = 100_000) -> DataFrame:
    """(host, line) of the lines above the limits, from profiles (doc_id, host, text_hash, lines).

    More than ``min_docs`` documents of the host, more than ``max_share`` of
    its documents and more than ``min_texts`` different texts hold such a line.
    In a small host a tenth of its documents, or ``least`` if that is more,
    stands for either number where it is below it. Hosts are broadcast while they are at most ``most_hosts``.
    """
    hosts = stored(profiles.groupBy("host").agg(F.count_distinct("doc_id").alias("in_host")))
    held = profiles.select("host", "doc_id", "text_hash", F.explode(F.array_distinct("lines.line")).alias("line"))
    counts = held.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("text_hash").alias("n_texts")).filter((F.col("n_docs") > min(min_docs, least)) & (F.col("n_texts") > min(min_texts, least)))
    sized = counts.join(F.broadcast(hosts), "host") if hosts.count() <= most_hosts else looked_up(stored(counts), hosts, ["host"], "inner")
    over = lambda n, limit: (F.col(n) > limit) | ((F.col(n) > least) & (10 * F.col(n) > F.col("in_host")))
    return sized.filter(over("n_docs", min_docs) & over("n_texts", min_texts) & (F.col("n_docs") > max_share * F.col("in_host"))).select("host", "line")


def line_verdicts(profiles: DataFrame, frequent: DataFrame, *, min_left: float = 0.3) -> DataFrame:
    """(host, text_hash, gone, removed_share, depleted) for each distinct text with a frequent line.

    ``gone`` are its frequent lines' hashes. A text is depleted if less than
    ``min_left`` of its words are in other lines.
    """
    frequent = stored(frequent.withColumn("frequent", F.lit(True)))
    lines = stored(profiles.select("host", "text_hash", F.explode("lines").alias("x")).groupBy("host", "text_hash", "x.line").agg(F.sum("x.n").alias("n")))
    marked = looked_up(lines, frequent, ["host", "line"]) if frequent.count() > 100_000 else lines.join(F.broadcast(frequent), ["host", "line"], "left")
    gone = F.sum(F.when(F.col("frequent"), F.col("n")).otherwise(0))
    return (
        marked.groupBy("host", "text_hash")
        .agg((gone / F.sum("n")).alias("removed_share"), F.collect_list(F.when(F.col("frequent"), F.col("line"))).alias("gone"))
        .filter(F.size("gone") > 0)
        .withColumn("depleted", 1 - F.col("removed_share") < min_left)
    )


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """(doc_id, host, text_hash, lines, the statistics of one text, base_failed), stored: later filters must not build the arrays anew."""
    base = (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("_text"))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    w = F.col("_words")
    # every 3-word window as (hash, place), sorted: equal windows become neighbours
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(1))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    base = base.withColumn("_windows", F.sort_array(F.when(F.size(w) >= 3, windows).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))))
    s = F.col("_windows")
    same = lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))
    base = base.withColumn("_again", F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])))
    p = F.col("_again")
    base = base.withColumn("_steps", F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x + F.size(p) * 0, F.lit(3)))))
    found = base.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("_steps", F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.coalesce(_lines(F.col("_text")), F.expr(NO_LINES)).alias("lines"),
    )
    return stored(found.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))))


def _judged(docs: DataFrame, limits: dict, **how) -> tuple[DataFrame, DataFrame]:
    """The statistics of the documents, and the verdicts on the texts that have frequent lines."""
    stats = statistics(docs, **how)
    profiles, left = stats.select("doc_id", "host", "text_hash", "lines"), {k: limits.pop(k) for k in ("min_left",) if k in limits}
    return stats, stored(line_verdicts(profiles, frequent_lines(profiles, **limits), **left))


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, **limits) -> DataFrame:
    """Statistics, ``base_failed``, ``removed_share`` and ``kept`` of each document. ``limits``: see ``frequent_lines`` and ``line_verdicts``."""
    stats, verdicts = _judged(docs, limits, doc_id=doc_id, text=text, host=host, min_words=min_words, max_repeat_percent=max_repeat_percent)
    stats, verdicts = stats.drop("lines"), verdicts.select("host", "text_hash", "removed_share", "depleted")
    out = looked_up(stats, verdicts, ["host", "text_hash"])
    return out.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        F.coalesce("removed_share", F.lit(0.0)).alias("removed_share"),
        (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
    )


def kept_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, most_broadcast: int = 200_000, **limits) -> DataFrame:
    """The documents, all their columns, that the rules keep, without their frequent lines.

    Rejected texts and texts with frequent lines are broadcast by their hashes
    while they are at most ``most_broadcast``; beyond, the rows are shuffled.
    """
    stats, verdicts = _judged(docs, limits, doc_id=doc_id, text=text, host=host, min_words=min_words, max_repeat_percent=max_repeat_percent)
    failed = stats.filter("base_failed").select("host", "text_hash").distinct().select("host", "text_hash", F.expr("cast(array() as array<bigint>)").alias("gone"), F.lit(True).alias("bad"))
    changed = verdicts.join(failed.select("host", "text_hash"), ["host", "text_hash"], "left_anti").select("host", "text_hash", "gone", F.col("depleted").alias("bad"))
    judged = stored(failed.unionByName(changed))
    rows = docs.select(carried(docs), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_of(text)).alias("text_hash"))
    key = ["host", "text_hash"]
    found = rows.join(F.broadcast(judged), key, "left") if judged.count() <= most_broadcast else looked_up(rows, judged, key)
    left = F.filter(F.split(F.col("_row")[text], "\n"), lambda x: ~F.array_contains("gone", line_key(x)))
    return with_text(found.filter(~F.coalesce("bad", F.lit(False))), docs.columns, text, F.array_join(left, "\n"), F.size("gone") > 0)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (
  SELECT doc_id, host, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, host, t, unnest(l) AS x FROM d)),
fr AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS c, count(DISTINCT t) AS k FROM ln GROUP BY host, line)
  JOIN (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host) USING (host)
  WHERE (c > 50 OR (c > 5 AND 10 * c > n)) AND (k > 50 OR (k > 5 AND 10 * k > n)) AND c > 0.05 * n),
held AS (SELECT doc_id, host, line, len(line) - len(replace(line, ' ', '')) + 1 AS n FROM ln),
sh AS (
  SELECT doc_id, sum(CASE WHEN fr.line IS NOT NULL THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS removed
  FROM held LEFT JOIN fr USING (host, line) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, len(list_aggregate(w || [''], 'string_agg', ''))::BIGINT AS word_chars,
         (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(sh.removed, 0.0)::DOUBLE AS removed_share
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN sh USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_share,
       NOT base_failed AND NOT (1 - removed_share < 0.3) AS kept
FROM f
"""
