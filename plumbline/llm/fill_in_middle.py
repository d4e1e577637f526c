"""Fill-in-middle: a text's lines are cut at two random ranks, and the parts change places.

Overlapping chunks
------------------
A text is decomposed into chunks of ``chunk`` code points, each with the
character before it (a line break before the first). A line starts where the
left one of two adjacent characters is a line break, so a chunk counts its own
starts and needs no neighbour. Prefix sums over the counts tell how many lines
a text has and which chunk owns a rank; only the owning chunks, two at most,
are scanned again for the places of the cuts.

All of it is column expressions on the row of the text: nothing is shuffled,
and work and memory are linear in the text, whatever its length.

Defined results
---------------
* A null text is empty. An empty text, and one that holds a mark, stays as it is (form ``plain``).
* Ties: two equal ranks give an empty middle. A rank of all lines cuts at the end.
* A null doc_id draws as the empty string does. Repeated rows give equal results, one for each row.
* ``transformed`` keeps all other columns, whatever their names; ``n_chars``, where there is one, follows the text.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import carried, documents, text_of, with_text

PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def overlapping_chunks(text: Column, size: int) -> Column:
    """Chunks of ``size`` code points, each led by the character before it; the first one by a line break."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"(?s)(?=(.{2,%d}+)).{1,%d}+" % (size + 1, size)), F.lit(1))


def starts_in(chunk: Column) -> Column:
    """The line starts that a chunk owns: its adjacent pairs with a line break on the left."""
    return F.regexp_count(chunk, F.lit(r"(?s)\n(?=.)")).cast("long")


def routed(counts: Column, ranks: list[Column]) -> Column:
    """For each rank the chunk (from 0) that owns that start, and the rank inside it; null where no chunk has it."""
    none = F.lit(None).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("before"), *[none.alias(f"{what}{k}") for k in range(len(ranks)) for what in ("own", "left")])

    def step(s, c):
        here = [(r >= s["before"]) & (r < s["before"] + c) for r in ranks]
        return F.struct(
            (s["i"] + 1).alias("i"),
            (s["before"] + c).alias("before"),
            *[x for k, r in enumerate(ranks) for x in (F.when(here[k], s["i"]).otherwise(s[f"own{k}"]).alias(f"own{k}"), F.when(here[k], r - s["before"]).otherwise(s[f"left{k}"]).alias(f"left{k}"))],
        )

    return F.aggregate(counts, zero, step)


def cut_at(chunks: Column, own: Column, left: Column, size: int, length: Column) -> Column:
    """The code points before a start, by scanning the chunk that owns it."""
    before = F.call_function("substring_index", F.get(chunks, own.cast("int")), F.lit("\n"), (left + 1).cast("int"))
    return F.when(own.isNull(), length).otherwise(own * size + F.length(before)).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))), F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, chunk: int = 16_384) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row, and the row itself as ``_row``.

    ``rate`` per cent of the texts are cut, ``spm_rate`` per cent of them with the suffix first.
    """
    h1, h2, h3, h4 = draws(F.col("_id"), seed)
    rows = docs.select(carried(docs), F.col(f"`{doc_id}`").alias("_id"), text_of(f"`{text}`").alias("_text"))
    rows = rows.withColumn("_chunks", overlapping_chunks(F.col("_text"), chunk))
    rows = rows.withColumn("_counts", F.transform("_chunks", starts_in))
    rows = rows.withColumn("n", F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("_k1", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))).withColumn("_k2", F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
    rows = rows.withColumn("_at", routed(F.col("_counts"), [F.col("_k1"), F.col("_k2")]))
    marked = (F.col("_text") == "") | F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    rows = rows.withColumn("form", F.when(marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))
    at = lambda k: F.when(F.col("form") != "plain", cut_at(F.col("_chunks"), F.col("_at")[f"own{k}"], F.col("_at")[f"left{k}"], chunk, F.length("_text")))
    rows = rows.withColumn("_a", at(0)).withColumn("_b", at(1))
    a, b = F.col("_a").cast("int"), F.col("_b").cast("int")
    first, middle, last = F.left("_text", a), F.substring(F.col("_text"), a + 1, b - a), F.substring(F.col("_text"), b + 1, F.length("_text"))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), last, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), last, F.lit(PREFIX), first, F.lit(MIDDLE), middle))
    return rows.select("_row", F.col("_id").alias("doc_id"), "n", "form", F.col("_a").alias("prefix_chars"), (F.col("_b") - F.col("_a")).alias("middle_chars"), output.alias("output"))


def transformed(docs: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The documents, all their columns, with transformed texts."""
    found = fill_in_middle(docs, text=text, **how)
    return with_text(found.withColumnRenamed("output", "_output"), docs.columns, text, F.col("_output"), F.col("form") != "plain")


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, h, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l FROM d),
k AS (SELECT doc_id, t, l, len(l) AS n,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
c AS (SELECT doc_id, t, l, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf FROM c),
o AS (SELECT doc_id, t, n, form, pre, mid,
             CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                       ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
