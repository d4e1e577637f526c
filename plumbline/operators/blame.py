"""Which commit a line comes from, by replaying patches, without the repository.

A commit's hunks map the lines of the new version: a range is either new, or
copied from a range of the old version, shifted. Such maps can be composed, and
composing is associative, so a file's history is folded in rounds: neighbours
are put together two by two, and a history of n commits takes log2(n) rounds.
Ranges meet by range joins, so nothing is replayed line by line and no task
holds a history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ranges import covering
from plumbline.session import cut

#: Where the unknown end of a file is put.
END = 1 << 40


def maps(hunks: DataFrame) -> DataFrame:
    """(path, seq, start, end, old, commit) from hunks(path, seq, commit, old_start, old_count, new_start, new_count).

    Ranges of the new version; ``old`` is where a copied one starts in the
    version before, null for new lines. As in unified diffs, a start with
    count 0 is the line before the place.
    """
    after = lambda side: F.col(f"{side}_start") + F.when(F.col(f"{side}_count") == 0, 1).otherwise(0)
    h = hunks.select("path", "seq", "commit", after("old").cast("long").alias("o"), F.col("old_count").cast("long").alias("oc"), after("new").cast("long").alias("n"), F.col("new_count").cast("long").alias("nc"))
    w = Window.partitionBy("path", "seq").orderBy("n", "o")
    h = h.withColumn("n0", F.coalesce(F.lag(F.col("n") + F.col("nc")).over(w), F.lit(1))).withColumn("o0", F.coalesce(F.lag(F.col("o") + F.col("oc")).over(w), F.lit(1)))
    h = h.withColumn("last", F.lead("n").over(w).isNull())
    none = F.lit(None)
    piece = lambda a, b, old, commit: F.struct(a.alias("start"), b.alias("end"), old.cast("long").alias("old"), commit.alias("commit"))
    ends = F.col("n") + F.col("nc")
    kind = h.schema["commit"].dataType
    rows = F.array(piece(F.col("n0"), F.col("n") - 1, F.col("o0"), none.cast(kind)), piece(F.col("n"), ends - 1, none, F.col("commit")), piece(F.when(F.col("last"), ends).otherwise(0), F.when(F.col("last"), F.lit(END)).otherwise(-1), F.col("o") + F.col("oc"), none.cast(kind)))
    return h.select("path", "seq", F.inline(F.filter(rows, lambda x: x["start"] <= x["end"])))


def _composed(pieces: DataFrame) -> DataFrame:
    """Maps numbered ``seq`` from 0 for each path, two neighbours put together as one map."""
    pieces = pieces.withColumn("pair", F.floor(F.col("seq") / 2))
    late, early = pieces.filter("seq % 2 = 1"), pieces.filter("seq % 2 = 0")
    partnered = late.select("path", "pair").distinct()
    alone = early.join(partnered, ["path", "pair"], "left_anti")
    early = early.join(partnered, ["path", "pair"], "left_semi")
    key = F.struct("path", "pair").alias("key")
    old_end = F.col("old") + F.col("end") - F.col("start")
    copied = late.filter("old is not null").select(key, F.col("start").alias("new_start"), F.col("old").alias("start"), old_end.alias("end"))
    from_ = early.select(key, "start", "end", F.col("old").alias("first_old"), "commit")
    rename = lambda df, *names: df.select("key", *[F.col(c).alias(f"b_{c}") for c in names])
    # a copied range overlaps one of the older version if one of the two starts in the other
    one = covering(rename(copied, "new_start", "start", "end"), from_, "key", "b_start")
    two = covering(rename(from_, "start", "end", "first_old", "commit"), copied, "key", "b_start").filter("b_start > start")
    both = one.select("key", F.col("b_new_start").alias("new_start"), F.col("b_start").alias("c"), F.col("b_end").alias("d"), "start", "end", "first_old", "commit").unionByName(
        two.select("key", "new_start", F.col("start").alias("c"), F.col("end").alias("d"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("b_first_old").alias("first_old"), F.col("b_commit").alias("commit"))
    )
    a, b = F.greatest("c", "start"), F.least("d", "end")
    joined = both.select("key", (F.col("new_start") + a - F.col("c")).alias("n0"), (F.col("new_start") + b - F.col("c")).alias("n1"), (F.col("first_old") + a - F.col("start")).alias("old"), "commit")
    joined = joined.select("key.path", F.col("key.pair").alias("seq"), F.col("n0").alias("start"), F.col("n1").alias("end"), "old", "commit")
    fresh = late.filter("old is null").select("path", F.col("pair").alias("seq"), "start", "end", "old", "commit")
    return joined.unionByName(fresh).unionByName(alone.select("path", F.col("pair").alias("seq"), "start", "end", "old", "commit"))


def blame(hunks: DataFrame) -> DataFrame:
    """(path, start, end, commit): the ranges of each file's last version that commits have written.

    ``seq`` orders a file's commits; gaps don't matter. Lines that were there
    before the first commit belong to none and are left out.
    """
    order = Window.partitionBy("path").orderBy("seq")
    seqs = hunks.select("path", "seq").distinct().withColumn("rank", F.row_number().over(order) - 1)
    pieces = cut(maps(hunks.join(seqs, ["path", "seq"]).drop("seq").withColumnRenamed("rank", "seq")))
    while pieces.filter("seq > 0").limit(1).count():
        pieces = cut(_composed(pieces))
    w = Window.partitionBy("path").orderBy("start")
    rows = pieces.filter("old is null").select("path", "start", "end", "commit")
    # neighbours of one commit are one range
    opens = ~(F.coalesce((F.lag("end").over(w) == F.col("start") - 1) & F.lag("commit").over(w).eqNullSafe(F.col("commit")), F.lit(False)))
    run = F.sum(opens.cast("int")).over(w)
    return rows.withColumn("_run", run).groupBy("path", "commit", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("path", "start", "end", "commit")


def parsed(patches: DataFrame) -> DataFrame:
    """hunks from patches(path, seq, commit, text): the @@ lines of unified diffs; a count left out is 1."""
    at = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    heads = patches.select("path", "seq", "commit", F.explode(F.regexp_extract_all("text", F.lit(at), F.lit(0))).alias("h"))
    part = lambda k: F.regexp_extract("h", at, k)
    count = lambda k: F.when(part(k) == "", 1).otherwise(part(k).cast("int"))
    return heads.select("path", "seq", "commit", part(1).cast("int").alias("old_start"), count(2).alias("old_count"), part(3).cast("int").alias("new_start"), count(4).alias("new_count"))


def line_ages(points: DataFrame, ranges_: DataFrame, commits: DataFrame) -> DataFrame:
    """points(path, line) with the commit of their line and its ``ts``, from blame's ranges and commits(commit, ts)."""
    return covering(points, ranges_).drop("start", "end").join(commits, "commit")
