"""Order statistics and dispersion over one column.

The percentile rules pick a whole element by index; none equals
``percentile_disc``. Values are counted, then placed by running sums within
ranges of values, so no task sees them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut


def index_of(rule: int, n: int, p: float) -> int:
    """The 0-based index of a percentile rule.

    1: floor(n p), clamped. 2: floor((n - 1) p). 3: n * 99 // 100, whatever p.
    4: the element n // 2 of the descending order.
    """
    if rule == 1:
        k = int(n * p)
    elif rule == 2:
        k = int((n - 1) * p)
    elif rule == 3:
        k = n * 99 // 100
    else:
        k = n - 1 - n // 2
    return max(0, min(k, n - 1))


def running(counts: DataFrame, value: str, n: str = "c") -> DataFrame:
    """counts(value, n), one row for each value -> with ``before``, the sum of n below it, without one order in one task.

    Ranges of values are sums of their own; an offset for each range is a sum
    over the ranges, of which there are as many as shuffle partitions.
    """
    ranged = cut(counts.repartitionByRange(value).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(n).alias("s"))
    offsets = sums.select("_range", F.coalesce(F.sum("s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(F.broadcast(offsets), "_range").withColumn("before", F.col("_offset") + F.col("_inside")).drop("_range", "_offset", "_inside")  # a row for each range is broadcast


def percentile(df: DataFrame, column: str, p: float, rule: int = 1) -> DataFrame:
    """One row (value): the element that the rule picks; null for no rows. Nulls don't count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    placed = running(counts, "value")
    n = placed.agg(F.sum("c")).first()[0]
    k = index_of(rule, n, p) if n else 0
    return placed.filter((F.col("before") <= k) & (F.col("before") + F.col("c") > k)).agg(F.max("value").alias("value"))


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of ``value`` within each group of ``by``, from two levels of counts."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    # H = log2(n) - sum(c log2 c) / n
    return counts.groupBy(*by).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"), F.sum("c").alias("n"))


def histogram(df: DataFrame, column: str, width: float, buckets: int, last_open: bool = True) -> DataFrame:
    """(bucket, lower, upper, count, percentage) for every bucket. ``last_open`` counts the upper end in the last one."""
    k = F.floor(F.col(column) / width).cast("int")
    if last_open:
        k = F.when(F.col(column) == width * buckets, buckets - 1).otherwise(k)
    counts = df.select(k.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("total"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").crossJoin(F.broadcast(total)).select("bucket", (F.col("bucket") * width).alias("lower"), ((F.col("bucket") + 1) * width).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"), F.round(100 * F.coalesce("count", F.lit(0)) / F.greatest("total", F.lit(1)), 6).alias("percentage"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """(gini): from the distinct values' counts and the running sums over them."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    ranked = running(counts, "x")
    # ranks before+1 .. before+c all hold x
    weighted = F.sum(F.col("x") * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2))
    n, total = F.sum("c"), F.sum(F.col("x") * F.col("c"))
    return ranked.agg(F.round(2 * weighted / (n * total) - (n + 1) / n, 6).alias("gini"))


def coefficient_of_variation(column: str | Column) -> Column:
    """Population deviation over the mean, in percent."""
    return F.stddev_pop(column) / F.avg(column) * 100


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
