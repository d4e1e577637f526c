"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its content. The ledger
holds the (blob, rule version) pairs that have been scanned, and their
findings; a run scans only pairs that the ledger has not seen and joins the
findings back to all paths that hold the blob. Batches are folders named by
their batch id, put there by one rename: a batch that is given again, or that
two jobs commit at once, replaces nothing and adds nothing.

The gaps and lengths of a text's matches are rows; running sums over them give
the positions, so nothing is copied at every match.

Positions count code points from 0, the end is exclusive. Matches are leftmost
and do not overlap within a kind; spans of different kinds may.

Defined results
---------------
* A null text is the empty blob; it has no findings. A text of any length is scanned whole.
* Repeated rows and copies are scanned once and all reported. Spans that start alike are ordered by kind.
* An empty table gives an empty result. Null ids are kept as they are.
* Only the named columns of the input are read; all others, whatever their names, are kept.
  Where there is an ``n_chars``, it follows a redacted text.
* A report on a document that no batch has committed fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.base import batches, broadcast_if, carried, documents, looked_up, published, shared_dir, stored, text_of, with_text

RULE_VERSION = "2026-11-c"
#: A private key of any kind and length, with its headers and body: up to the END line, or as long as base64 goes on where
#: that is missing. Repeats are possessive: they neither go back nor nest, so a body has as many lines as it likes.
PEM = (
    r"-----BEGIN (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----"
    r"(?:\s*[A-Za-z][A-Za-z-]*:[^\n]*)*+"
    r"(?:[^-]*+-----END (?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:[\s\\\"]*[A-Za-z0-9+/=]{16,}+)*+(?:\r?\n[A-Za-z0-9+/]{1,63}={0,2}(?=\r?\n|$))?)"
)
#: Kind, pattern, and which group must have how many characters at least. In the order of the kinds.
#: The first three are fixed by contract; hex and access spell their least length in the pattern,
#: which finds the same spans, as a shorter run holds no longer one.
RULES = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
    ("pem", PEM, 0),
    ("vcs", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}", 0),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
)
BASE_KINDS = ("assign", "access", "hex")
_MARKS = "array<struct<kind:int,place:int,gap:int,size:int,ok:boolean>>"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _marks(text: Column, kind: int, pattern: str, least: int) -> Column:
    """The matches of one kind in order: characters since the last match, own length, and whether the rule takes it."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda g: F.length(g) >= least) if least else F.transform(whole, lambda g: F.lit(True))
    parts = F.arrays_zip(F.slice(F.transform(pieces, lambda p: F.length(p)), 1, F.size(whole)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("size"), long.alias("ok"))
    found = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok")))
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {_MARKS})"))


def scan(blobs: DataFrame, *, text: str = "text") -> DataFrame:
    """(blob, found) of each blob: all spans of its text by start, then kind."""
    marked = stored(blobs.select("blob", F.concat(*[_marks(F.col(text), k, p, n) for k, (_, p, n) in enumerate(RULES)]).alias("marks")).dropDuplicates(["blob"]))
    upto = Window.partitionBy("blob", "kind").orderBy("place")
    placed = marked.select("blob", F.inline("marks")).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).filter("ok")
    spans = placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))).alias("found"))
    none = F.expr(f"cast(array() as {_SPANS})")
    bare = marked.filter(~F.exists("marks", lambda x: x["ok"])).select("blob", none.alias("found"))
    return spans.unionByName(bare)


def shown(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k, _, _ in RULES])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def new_blobs(docs: DataFrame, seen: DataFrame | None, *, doc_id: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """One row (blob, text) for each content that ``seen`` (blob, rule_version) lacks under this version.

    One row id stands for each blob, so that only numbers and hashes meet in
    the aggregation; the texts move once, in the join that picks those rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(text_of(text), 256).alias("blob"), text_of(text).alias("text"))
    chosen = rows.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if seen is not None:
        chosen = chosen.join(seen.filter(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    picked = rows.join(chosen.withColumnRenamed("blob", "_blob"), (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    return picked.select("blob", "text")


class BlobLedger:
    """Findings by (blob, rule version), kept as batch folders below ``path``.

    ``commit`` is idempotent: an id that is there already is left alone. A blob
    that is given again, in whatever batch, is not scanned again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def findings(self) -> DataFrame | None:
        there = batches(self.spark, self.path)
        return self.spark.read.parquet(*there) if there else None

    def commit(self, batch: str, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> None:
        if batches(self.spark, self.path, batch):
            return
        old = self.findings()
        fresh = new_blobs(docs, None if old is None else old.select("blob", "rule_version"), doc_id=doc_id, text=text, rule_version=rule_version)
        published(scan(fresh).select("blob", F.lit(rule_version).alias("rule_version"), "found"), self.path, batch)

    def report(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
        """(doc_id, blob, found) of every row of ``docs``; fails if a blob was never committed."""
        rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(text_of(text), 256).alias("blob")))
        found = self.findings()
        if found is None:
            known = self.spark.createDataFrame([], f"blob string, found {_SPANS}")
        else:
            # two jobs at once may both have scanned a blob, with one result
            known = stored(found.filter(F.col("rule_version") == rule_version).select("blob", "found").dropDuplicates(["blob"]))
        unknown = F.raise_error(F.concat(F.lit("the ledger lacks blob "), F.col("blob"))).cast(_SPANS)
        return looked_up(rows, known, ["blob"]).select("doc_id", "blob", F.coalesce("found", unknown).alias("found"))


def secret_scan(docs: DataFrame, ledger_path: str, batch: str = "all") -> DataFrame:
    """(doc_id, blob, found): commits ``docs`` to the ledger as one batch and reports on them."""
    ledger = BlobLedger(docs.sparkSession, ledger_path)
    ledger.commit(batch, docs)
    return ledger.report(docs)


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]", *, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` (blob, found) replaced; overlapping spans become one mark."""
    some = found.filter(F.size("found") > 0).select("blob", "found").dropDuplicates(["blob"])
    before = Window.partitionBy("blob").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = some.select("blob", F.inline("found")).withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0)))
    opens = F.when(F.col("start") >= F.col("upto"), F.struct(F.col("upto").alias("at"), (F.col("start") - F.col("upto")).alias("n")))
    kept = stored(spans.groupBy("blob").agg(F.sort_array(F.collect_list(opens)).alias("kept"), F.max("end").alias("last")))  # the text between the spans
    rows = docs.select(carried(docs), F.sha2(text_of(text), 256).alias("blob"))
    few = kept.count()
    joined = rows.join(broadcast_if(kept, few, 100_000), "blob", "left") if few <= 100_000 else looked_up(rows, kept, ["blob"])
    t = F.col("_row")[text]
    parts = F.transform("kept", lambda x: F.substring(t, x["at"] + 1, x["n"]))
    rest = F.substring(t, F.col("last") + 1, F.length(t))
    return with_text(joined, docs.columns, text, F.array_join(F.concat(parts, F.array(rest)), mark), F.col("kept").isNotNull())


def fresh_ledger(spark: SparkSession) -> str:
    """A new ledger's folder among the shared ones."""
    return f"{shared_dir(spark)}/ledger/{uuid.uuid4().hex}"


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Two batches, as a table would grow: the second one's copies of blobs of the first are not scanned again."""
    docs, ledger = documents(spark, sf_dir), BlobLedger(spark, fresh_ledger(spark))
    early = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    ledger.commit("first", docs.filter(early))
    ledger.commit("second", docs.filter(~early))
    found = ledger.report(docs)
    f = F.col("found")
    base = F.filter(f, lambda x: x["kind"] < len(BASE_KINDS))
    counted = lambda k: F.size(F.filter(f, lambda x: x["kind"] == k)).cast("long")
    counts = [counted(k).alias(f"n_{n}") for k, n in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(f).alias("spans"), "blob", F.lit(RULE_VERSION).alias("rule_version"))
