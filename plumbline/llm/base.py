"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode only, where none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    The files outlive any executor. They are compressed columns, smaller than
    what ``checkpoint()`` writes.
    """
    path = f"{shared_dir(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stored`` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.rpartition("/")[0].endswith("/stored"):
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def batches(spark: SparkSession, path: str, batch: str = "*") -> list[str]:
    """The folders of the batches that are below ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or ()
    return sorted(str(x.getPath().getParent().toString()) for x in found)


def published(df: DataFrame, path: str, batch: str) -> bool:
    """Writes ``df`` as a batch below ``path``: apart first, then by one rename. False if the batch is there by then."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    apart = f"{path}/_apart/{uuid.uuid4().hex}"
    df.write.parquet(apart)
    a, b = jvm.org.apache.hadoop.fs.Path(apart), jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), conf)
    try:
        files.rename(a, b, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError:
        if not batches(spark, path, batch):
            raise
        files.delete(a, True)
        return False


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], how: str = "left", *, hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key at most; no task gets a hot key.

    A key of more than ``hot`` rows and more than a thousandth of all rows is
    hot. So there are under a thousand, whose rows of ``table`` are broadcast.
    ``rows`` and ``table`` are read more than once: store them before. Keys must not be null.
    """
    n = rows.count()
    often = rows.groupBy(*key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > max(hot, n // 1000)).select(*key)
    often = stored(often)
    if not often.limit(1).count():
        return rows.join(table, key, how)
    few = F.broadcast(often)
    for_hot, for_rest = rows.join(few, key, "left_semi"), rows.join(few, key, "left_anti")
    return for_hot.join(F.broadcast(table.join(few, key, "left_semi")), key, how).unionByName(for_rest.join(table, key, how))


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def carried(docs: DataFrame, name: str = "_row") -> Column:
    """All columns of ``docs`` as one struct, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unpacked(columns: list[str], row: str = "_row") -> list[Column]:
    """The columns of such a struct."""
    return [F.col(row)[c].alias(c) for c in columns]


def with_text(df: DataFrame, columns: list[str], text: str, new: Column, changed: Column, row: str = "_row") -> DataFrame:
    """The carried columns, the text being ``new`` where ``changed``; ``n_chars``, where there is one, follows."""
    changed = F.coalesce(changed, F.lit(False))
    df = df.select(row, F.when(changed, new).otherwise(F.col(row)[text]).alias("_new"), changed.alias("_changed"))
    kind = dict(df.select(f"{row}.*").dtypes)
    value = {text: F.col("_new")}
    if "n_chars" in columns and text != "n_chars":
        value["n_chars"] = F.when(F.col("_changed"), F.length("_new").cast(kind["n_chars"])).otherwise(F.col(row)["n_chars"])
    return df.select(*[value.get(c, F.col(row)[c]).alias(c) for c in columns])


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay under the bound, else unchanged."""
    return F.broadcast(df) if rows <= most else df
