"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so a batch adds the
sums of its signed rows: an insert counts +1, a delete -1, a revised document
-1 with its old counts and +1 with its new ones. A batch's deltas are one
folder named by the batch id: it is written apart and put there by one rename,
which fails if the id is there. So a batch that is sent again, whose job is
retried or that two jobs commit at once, counts once. ``totals`` adds the
batches up.

A document is counted once: ``counted`` rows carry its numbers, and moves
between sources, revisions and deletes add and take away what they say.

Only sums of a task's rows are shuffled, so a hot source costs a row for each task.

Defined results
---------------
* A null text has no tokens and no characters; its document counts. A text of any length is counted whole.
* A special token's string in a text is one token.
* Null source or language is a group of its own.
* Repeated rows count each. A group whose totals are all zero is not shown.
* An empty batch commits, and changes nothing. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.base import batches, documents, published, shared_dir, stored, text_of

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")


def version_of(path: str) -> str:
    """The tokenizer file's name and the start of its SHA-256."""
    with open(path, "rb") as f:
        return f"{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}:{hashlib.sha256(f.read()).hexdigest()[:12]}"


def counted(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None, keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """The ``keep`` columns, n_tokens and n_chars of each document."""
    path = tokenizer or tokens.default_path()
    rows = docs.select(*[F.col(c) for c in keep], text_of(text).alias("_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        encoder = tokens.encoder(path)
        for batch in batches:
            texts = batch.column(len(keep))
            n, chars = [], []
            for part in tokens.limited(texts):
                n += [len(ids) // 4 for ids in encoder.ids(part)]
                chars += [len(t) for t in part]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(n, pa.int64()), pa.array(chars, pa.int64())], names=[*keep, "n_tokens", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_chars long")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign).cast("long"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed rows of documents whose text, source or language changed from ``old`` to ``new``."""
    return signed(old, -1).unionByName(signed(new, 1))


class TokenLedger:
    """Batches of deltas below ``path``."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str | None = None):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer or tokens.default_path()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds signed rows (source, lang, sign and text, or n_tokens and n_chars) as one batch; false if it is there already."""
        if batches(self.spark, self.path, batch):
            return False
        keep = ("source", "lang", "sign")
        rows = changes if "n_tokens" in changes.columns else counted(changes, tokenizer=self.tokenizer, keep=keep)
        sums = [F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars")]
        delta = rows.groupBy("source", "lang").agg(*sums).withColumn("tokenizer_version", F.lit(version_of(self.tokenizer)))
        return published(delta.select(*KEYS, *SUMS), self.path, batch)

    def totals(self) -> DataFrame:
        """The sums over all batches by source, language and tokenizer version."""
        there = batches(self.spark, self.path)
        if not there:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long")
        added = self.spark.read.parquet(*there).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return added.filter(" OR ".join(f"{c} <> 0" for c in SUMS))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """The totals of the whole table after inserts, revisions and deletes, one batch of which is sent twice.

    All documents arrive unsorted, without source and language, and once more
    through a mirror; a revision files them, and the mirror's are deleted.
    """
    ledger = TokenLedger(spark, f"{shared_dir(spark)}/token_ledger/{uuid.uuid4().hex}")
    rows = stored(counted(documents(spark, sf_dir)))
    unsorted_, mirror = (rows.withColumn("source", F.lit(s)).withColumn("lang", F.lit(None).cast("string")) for s in (None, "mirror"))
    unsorted_ = unsorted_.withColumn("source", F.col("source").cast("string"))
    ledger.commit("arrived", signed(unsorted_, 1))
    ledger.commit("mirrored", signed(mirror, 1))
    for _ in range(2):  # sent again, it changes nothing
        ledger.commit("filed", revised(unsorted_, rows))
    ledger.commit("withdrawn", signed(mirror, -1))
    return ledger.totals()
