"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words. Each word covered by a window whose
words also start in a document of a smaller doc_id is removed.

1. Copies of a whole word sequence go to their smallest doc_id, their representative.
2. Each window has an anchor: the least hash among its ``GRAM``-word phrases.
   Equal windows have equal anchors, and neighbours mostly share one, so a
   document has few. Anchors that two representatives hold recur.
3. Recurring passages are confirmed: windows with a recurring anchor are hashed
   (96 bits) and grouped; those of two documents recur, the smaller one owns them.
4. The owners' passages are compiled into automata with pyahocorasick, sharded
   by anchor; the other documents' passages with that anchor are streamed
   through, which locates every occurrence, word by word. A frequent anchor's
   documents are dealt over as many shards as they fill, each with a copy of
   the anchor's automaton.

Texts move only where they can matter, and no group is held whole: a task holds
one anchor's patterns and one passage at a time.

Defined results
---------------
* A text of any length is read whole, ``BLOCK`` words at a time. Of equal texts the one of the smallest doc_id keeps its words.
* A null text has no words: kept_sha256 is that of the empty string.
* Fewer words than a window: nothing is removed.
* Rows of one doc_id don't remove one another; repeated rows give repeated results.
* A null doc_id is neither smaller nor larger than another: its row keeps all its words.
* An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import documents, looked_up, stored, text_of

WINDOW, GRAM = 50, 16
#: Documents of one anchor that one shard takes.
SHARD_DOCS = 50
#: Words that are hashed at a time.
BLOCK = 200_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(r: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**j and r**-j modulo 2**64 for j below n at least."""
    got = _powers.get(r)
    if got is None or len(got[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, r, dtype=np.uint64), np.full(n, pow(r, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        got = _powers[r] = np.cumprod(up), np.cumprod(down)
    return got


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _gram_hashes(words: list[bytes], sizes: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """For each (k, multiplier) the hash of every run of k words: differences of prefix sums of a polynomial."""
    text = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(text == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums, out = {}, []
    for k, r in sizes:
        up, down = _power(r, len(text) + 1)
        if r not in sums:
            sums[r] = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], dtype=np.uint64)])
        s, e = starts[: len(words) - k + 1], ends[k - 1 :]
        out.append(_mixed((sums[r][e] - sums[r][s]) * down[s]))
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _blocks(words: list[bytes], window: int):
    for at in range(0, max(len(words) - window + 1, 0), BLOCK):
        yield words[at : at + BLOCK + window - 1]


def anchors_of(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """The anchor of each window, as int64."""
    parts = [_sliding_min(_gram_hashes(b, ((gram, MULTIPLIERS[0]),))[0], window - gram + 1) for b in _blocks(words, window)]
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def windows_of(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each window and another of 32 bits."""
    parts = [_gram_hashes(b, ((window, MULTIPLIERS[0]), (window, MULTIPLIERS[1]))) for b in _blocks(words, window)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate([p[0] for p in parts]).view(np.int64), (np.concatenate([p[1] for p in parts]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _runs(on: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the longest runs of true ``on`` with one value in ``of``."""
    if not on.any():
        return []
    cut = np.flatnonzero(np.concatenate([[True], (on[1:] != on[:-1]) | (of[1:] != of[:-1]), [True]]))
    return [(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:]) if on[a]]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def profiles(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_hash, n_words, sha256, anchors) of each row; anchors are distinct."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(2):
                words = t.as_py().encode().split()
                out.append((len(words), _sha(words), np.unique(anchors_of(words, window, gram))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_words", "sha256", "anchors"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_words long, sha256 string, anchors array<long>")


def _candidate_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(w1, w2, doc_id) of every window with a recurring anchor."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(1)[k].as_py().encode().split()
                at = np.flatnonzero(np.isin(anchors_of(words, window, gram), np.array(batch.column(2)[k].as_py(), dtype=np.int64)))
                w1, w2 = (w[at] for w in windows_of(words, window))
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), batch.column(0).take(pa.array(np.full(len(at), k)))], names=["w1", "w2", "doc_id"])

    return texts.select("doc_id", "text", "anchors").mapInArrow(run, f"w1 long, w2 int, doc_id {kind}")


def _passages(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, shard, is_text, doc_id, text_hash, start, words): patterns of owned windows, passages of the other ones."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["anchor", "shard", "is_text", "doc_id", "text_hash", "start", "words"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                words = row["text"].encode().split()
                anchor, w1 = anchors_of(words, window, gram), windows_of(words, window)[0]
                shards = dict(zip(row["anchors"], row["shards"]))
                can = np.isin(anchor, np.array(row["anchors"], dtype=np.int64))
                own = can & np.isin(w1, np.array(row["owned"] or [], dtype=np.int64))
                out = []
                for a, b in _runs(own, anchor):
                    out += [(int(anchor[a]), s, False, a, b" ".join(words[a : b + window - 1])) for s in range(shards[int(anchor[a])])]
                for a, b in _runs(can & ~own, anchor):
                    out.append((int(anchor[a]), row["text_hash"] % shards[int(anchor[a])], True, a, b" ".join(words[a : b + window - 1])))
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), batch.column("doc_id").take(pa.array(np.full(len(out), k))), pa.array([row["text_hash"]] * len(out), pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], names=names)

    return texts.mapInArrow(run, f"anchor long, shard int, is_text boolean, doc_id {kind}, text_hash long, start long, words string")


def _located(passages: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, start, end): spans of words that the automata find in passages of larger doc_ids.

    Rows come sorted by shard, patterns first.
    """
    kind = passages.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import ahocorasick

        group, ids, automaton, ready = None, {}, None, False
        for batch in batches:
            found = []
            for k, (anchor, shard, is_text, doc, start, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "shard", "is_text", "doc_id", "start", "words")))):
                if (anchor, shard) != group:
                    group, ids, automaton, ready = (anchor, shard), {}, None, False
                words = text.split(" ")
                if not is_text:
                    automaton = automaton or ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
                    code = tuple(ids.setdefault(w, len(ids) + 1) for w in words)
                    for i in range(len(code) - window + 1):
                        automaton.add_word(code[i : i + window], doc)
                    continue
                if automaton is None:
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                last = None
                for end, owner in automaton.iter(tuple(ids.get(w, 0) for w in words)):
                    if owner < doc:
                        a, b = start + end - window + 1, start + end + 1
                        if last is not None and a <= last[2]:
                            last[2] = b
                        else:
                            found.append(last := [k, a, b])
            at = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), batch.column("text_hash").take(pa.array(at, pa.int64())), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["doc_id", "text_hash", "start", "end"])

    return passages.mapInArrow(run, f"doc_id {kind}, text_hash long, start long, end long")


def _cut(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_removed, kept_sha256, spans) from rows with the text and its spans."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for x in spans.as_py():
                    gone[x["start"]] += 1
                    gone[x["end"]] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                out.append((int(len(words) - keep.sum()), _sha([w for w, ok in zip(words, keep) if ok])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "text_hash", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text_hash", "text", "spans").mapInArrow(run, f"doc_id {kind}, text_hash long, n_removed long, kept_sha256 string")


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles with the representative ``first_id``, texts of candidates, their spans (doc_id, text_hash, start, end)), all stored."""
    gram = min(gram, window)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).alias("text"))
    found = stored(profiles(rows, window, gram))
    firsts = stored(found.groupBy("sha256").agg(F.min("doc_id").alias("first_id")))
    brief = stored(looked_up(found.select("doc_id", "text_hash", "n_words", "sha256"), firsts, ["sha256"]))
    reps = found.filter(F.col("n_words") >= window).join(brief.filter(F.col("doc_id") == F.col("first_id")).select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi")
    held = reps.select("doc_id", "text_hash", F.explode("anchors").alias("anchor"))
    recurring = stored(held.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").select("anchor", F.ceil(F.col("n") / SHARD_DOCS).cast("int").alias("shards")))
    lists = held.join(recurring, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "shards")).alias("l"))
    texts = stored(rows.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", F.col("l.anchor").alias("anchors"), F.col("l.shards").alias("shards")))
    owners = _candidate_windows(texts, window, gram).groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last")
    owned = owners.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("w1").alias("owned"))
    passages = _passages(texts.join(owned, "doc_id", "left"), window, gram)
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sharded = passages.repartition(int(n), "anchor", "shard").sortWithinPartitions("anchor", "shard", "is_text")
    return brief, texts, stored(_located(sharded, window))


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document."""
    found, texts, spans = repeated_spans(docs, window=window, **how)
    listed = spans.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = _cut(texts.dropDuplicates(["doc_id", "text_hash"]).join(listed, ["doc_id", "text_hash"])).withColumnRenamed("kept_sha256", "_kept").withColumnRenamed("n_removed", "_removed")
    copy = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first_id"))
    return found.join(cut, ["doc_id", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_kept", "sha256")).alias("kept_sha256"),
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
