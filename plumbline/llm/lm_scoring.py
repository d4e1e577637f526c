"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

Each text is split once, into ids of its block's own vocabulary. The blocks'
vocabularies are shuffled once by token, which adds their counts up, and go
back to their blocks as numbers.

Frequent tokens are classes of their own, every other token belongs to one of
the shapes (a hash of its last three characters). Both kinds grow with the
corpus, as the fourth root of its tokens. The model predicts a token's class
from the two classes before it: the context vector is the sum of their vectors,
each scaled by position; a class's logit is the product with its own vector
plus a bias. Within a shape a token has its smoothed count's share, and so has
one unseen token. So every token has a normalised probability, and a text's
score is the sum of their log10.

Training: a hash of (doc_id, text) picks a sample for the driver's first model
and deals all training texts to shards. Each shard goes on from the first model
by noise-contrastive estimation, in the order of the hashes, and the shards'
models are averaged, weighted by their tokens. Neither partitions nor blocks
change the model.

Defined results
---------------
* A null or wordless text is one end token. A text of any length is scored whole.
* A document whose id is null is held out. Repeated rows each train and each score.
* Tokens of equal counts are ordered by their text, so ties don't matter.
* Without training tokens every token has the smoothed probability of an unseen one, and score equals base_score.
* An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.base import documents, removed, stored, text_of

DIM, NOISE, BATCH = 16, 32, 4096
#: Frequent tokens have at least tokens**0.75 / RARITY counts, so there are at most RARITY * tokens**0.25 of them.
RARITY = 64
#: Shapes: SHAPES * tokens**0.25 of them.
SHAPES = 4
#: Texts that the first model's sample is expected to have.
WARM_DOCS = 200
#: Tokens of a shard, and characters of a block.
SHARD_TOKENS, BLOCK_CHARS = 4_000_000, 12_000_000
END = "\n"
SMOOTH = 0.1


def _rows(docs: DataFrame, doc_id: str, text: str, fold: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % fold == 0, F.lit(True))
    return docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.xxhash64(F.col(doc_id).cast("string"), text_of(text)).alias("key"), text_of(text).alias("text"))


def _blocks(batches, column: str, most: int):
    """Tables of rows whose ``column`` holds about ``most`` bytes, across the bounds of the batches."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, before + most - size, side="left")) + 1
            part = batch.slice(at, upto - at)
            held.append(part)
            size += int(ends[at + part.num_rows - 1]) - before
            at += part.num_rows
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, ids, ends): every text's words and an end token, coded by the vocabulary."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = cut.flatten()
    there = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)])
    offsets = cut.offsets.to_numpy()
    ends = there[offsets - offsets[0]]
    coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    vocabulary = pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)])
    ids = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), ends[1:], len(vocabulary) - 1)
    return vocabulary, ids, ends[1:] + np.arange(1, len(ends))


#: Columns that hold packed numbers: the lowest byte of each, the next one, ... Planes of like bytes compress well.
PLANES = ("b0", "b1", "b2", "b3")
PLANE_TYPES = ", ".join(f"{c} binary" for c in PLANES)


def _packed(values: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """The planes, with one row for each run of ``values`` that stops at ``ends``."""
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(planes[:, k].tobytes())]) for k in range(4)]


def _unpacked(planes: list) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of such columns, given as lists of bytes."""
    joined = [np.frombuffer(b"".join(p), dtype=np.uint8) for p in planes]
    values = np.stack(joined, axis=1).reshape(-1).view("<u4").astype(np.int32)
    return values, np.cumsum([len(x) for x in planes[0]])


def _of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked([table.column(c).to_pylist() for c in PLANES])


def coded(rows: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of two kinds, by block: documents (doc_id, held_out, key, planes of ids) and tokens (place, token, c).

    ids are places of the block's tokens, the most frequent first; ``c`` counts
    a token in the block's training texts.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["block", "doc_id", "held_out", "key", *PLANES, "place", "token", "c"]

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for number, table in enumerate(_blocks(batches, "text", block_chars)):
            doc, held, key, texts = (table.column(c).combine_chunks() for c in ("doc_id", "held_out", "key", "text"))
            vocabulary, ids, ends = _split(texts)
            n, m = len(doc), len(vocabulary)
            order = np.argsort(-np.bincount(ids, minlength=m), kind="stable")
            place = np.empty(m, dtype=np.int32)
            place[order] = np.arange(m, dtype=np.int32)
            learns = np.repeat(~held.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
            counts = np.bincount(ids[learns], minlength=m)
            none = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, first + number)), doc, held, key, *_packed(place[ids], ends), none(pa.int32(), n), none(pa.string(), n), none(pa.int64(), n)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, first + number)), none(doc.type, m), none(pa.bool_(), m), none(pa.int64(), m), *[none(pa.binary(), m)] * 4, pa.array(place), vocabulary, pa.array(counts)], names=names)

    return rows.mapInArrow(run, f"block long, doc_id {kind}, held_out boolean, key long, {PLANE_TYPES}, place int, token string, c long")


class Model:
    """Parameters in one float32 vector: context vectors, class vectors, biases, position scales."""

    def __init__(self, flat: np.ndarray, n: int, dim: int = DIM):
        a, b = n * dim, 2 * n * dim
        self.flat, self.n, self.dim = flat, n, dim
        self.context, self.target = flat[:a].reshape(n, dim), flat[a:b].reshape(n, dim)
        self.bias, self.scale = flat[b : b + n], flat[b + n :].reshape(2, dim)

    @classmethod
    def fresh(cls, share: np.ndarray, dim: int = DIM) -> Model:
        n = len(share)
        rng = np.random.default_rng(11)
        flat = np.concatenate([rng.normal(0, 0.1, 2 * n * dim), np.log(share), np.ones(2 * dim)]).astype(np.float32)
        return cls(flat, n, dim)

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 P(target | one before, two before); each distinct context is normalised once."""
        code, back = np.unique(one.astype(np.int64) * self.n + two, return_inverse=True)
        h = self.context[code // self.n] * self.scale[0] + self.context[code % self.n] * self.scale[1]
        norm, step = np.empty(len(h), dtype=np.float64), max(1, 2_000_000 // self.n)
        for at in range(0, len(h), step):
            z = h[at : at + step] @ self.target.T + self.bias
            top = z.max(axis=1, keepdims=True)
            z -= top
            np.exp(z, out=z)
            norm[at : at + step] = np.log(z.sum(axis=1, dtype=np.float64)) + top[:, 0]
        logit = np.einsum("ij,ij->i", h[back], self.target[target]) + self.bias[target]
        return (logit - norm[back]) / np.log(10)


def _by_row(index: np.ndarray, grad: np.ndarray, n: int) -> np.ndarray:
    """Sums the rows of ``grad`` by ``index`` into n rows."""
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros((n, grad.shape[1]), dtype=np.float32)
    out[at[first]] = np.add.reduceat(grad[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with one noise sample for a batch, AdaGrad steps."""

    def __init__(self, model: Model, share: np.ndarray, *, noise: int = NOISE, rate: float = 0.1, seed: int = 0, start: float = 1.0):
        self.model, self.share, self.k, self.rate = model, share, noise, rate
        self.log_kq = np.log(noise * share).astype(np.float32)
        self.rng, self.past = np.random.default_rng(seed), np.full_like(model.flat, start * 1e-3)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        m, size = self.model, len(target)
        c1, c2 = m.context[one], m.context[two]
        h = c1 * m.scale[0] + c2 * m.scale[1]
        noise = self.rng.choice(m.n, self.k, p=self.share)
        s = np.einsum("ij,ij->i", h, m.target[target]) + m.bias[target] - self.log_kq[target]
        z = h @ m.target[noise].T + (m.bias - self.log_kq)[noise]
        up = 1 / (1 + np.exp(np.clip(s, -30, 30)))  # 1 - P(data)
        down = 1 / (1 + np.exp(np.clip(-z, -30, 30)))  # P(data) of noise
        dh = up[:, None] * m.target[target] - down @ m.target[noise]
        g_target = _by_row(target, up[:, None] * h, m.n)
        g_bias = np.bincount(target, up, m.n).astype(np.float32)
        np.subtract.at(g_target, noise, down.T @ h)
        np.subtract.at(g_bias, noise, down.sum(axis=0))
        g_context = _by_row(one, dh * m.scale[0], m.n) + _by_row(two, dh * m.scale[1], m.n)
        g_scale = np.stack([(dh * c1).sum(axis=0), (dh * c2).sum(axis=0)])
        g = np.concatenate([g_context.ravel(), g_target.ravel(), g_bias, g_scale.ravel()]) / size
        self.past += g * g
        m.flat += (self.rate * g / np.sqrt(self.past)).astype(np.float32)

    def learn(self, classes: np.ndarray, ends: np.ndarray, end: int, batch: int = BATCH) -> None:
        """One pass over the texts in a shuffled order of their tokens."""
        one, two = contexts(classes, ends, end)
        order = self.rng.permutation(len(classes))
        for at in range(0, len(order), batch):
            k = order[at : at + batch]
            self.step(one[k], two[k], classes[k])


def contexts(classes: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(one before, two before) of the texts' tokens; an end stands before each text."""
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    starts = np.concatenate([[0], ends[:-1]])
    one[starts] = end
    two[starts] = end
    two[np.minimum(starts + 1, len(classes) - 1)[ends - starts > 1]] = end
    return one, two


@dataclass
class Classes:
    """What a token's class and its share in it are made of."""

    tokens: list[str]  # frequent ones, class k each
    shapes: int
    mass: np.ndarray  # smoothed counts by class

    @property
    def share(self) -> np.ndarray:
        return self.mass / self.mass.sum()

    def of(self, token: str) -> int:
        if token in self.tokens:
            return self.tokens.index(token)
        import xxhash

        h = xxhash.xxh64_intdigest(token[-3:].encode(), 42)
        return len(self.tokens) + (h - (h >> 63 << 64)) % self.shapes


def _shape(token: Column, shapes: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, -3, 3)), F.lit(shapes)).cast("int")


def _counted(tokens: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(block, place, c, shape, first, token) of the blocks' tokens with the corpus's counts, and the number of shapes.

    ``first`` marks one row of each token. Only frequent tokens are kept as text.
    """
    shapes, same = max(1, round(SHAPES * total**0.25)), Window.partitionBy("token")
    rows = tokens.select("block", "place", "token", F.sum("c").over(same).alias("c"), (F.col("block") == F.min("block").over(same)).alias("first"))
    own = F.when((F.col("c") > 0) & (F.col("c") >= total**0.75 / RARITY), F.col("token"))
    return stored(rows.select("block", "place", "c", "first", _shape(F.col("token"), shapes).alias("shape"), own.alias("token")), "zstd"), shapes


def _classes(counted: DataFrame, shapes: int) -> tuple[DataFrame, Classes, int]:
    """Adds each token's class ``cls``; the classes, and the number of kinds."""
    kinds = counted.filter(F.col("first") & (F.col("c") > 0))
    frequent = sorted((-r["c"], r["token"]) for r in kinds.filter(F.col("token").isNotNull()).select("token", "c").collect())  # RARITY * total**0.25 at most
    tokens = [t for _, t in frequent]
    named = counted.sparkSession.createDataFrame([(t, k) for k, t in enumerate(tokens)], "token string, own int")
    mass = np.concatenate([[SMOOTH - n for n, _ in frequent], np.full(shapes, SMOOTH)])  # a shape's unseen token
    n_kinds = len(tokens)
    for r in kinds.filter(F.col("token").isNull()).groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[len(tokens) + r["shape"]] += r["c"] + SMOOTH * r["n"]
        n_kinds += r["n"]
    return counted.join(F.broadcast(named), "token", "left").withColumn("cls", F.coalesce("own", F.col("shape") + len(tokens))), Classes(tokens, shapes, mass), n_kinds


def _prepared(docs: DataFrame, known: DataFrame, classes: Classes, z: float) -> DataFrame:
    """(doc_id, held_out, key, n_tokens, n_known, base_score, inner, planes of classes) of each document.

    ``inner`` adds the logs of the tokens' shares in their shapes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    mass, own = classes.mass, len(classes.tokens)

    def run(docs: pa.Table, tokens: pa.Table) -> pa.Table:
        m = tokens.num_rows
        c, cls = np.zeros(m), np.zeros(m, dtype=np.int32)
        place = tokens.column("place").to_numpy()
        c[place], cls[place] = tokens.column("c").to_numpy(), tokens.column("cls").to_numpy()
        ids, ends = _of(docs)
        starts = np.concatenate([[0], ends[:-1]])
        add = lambda x: np.add.reduceat(x[ids], starts)
        inner = np.where(cls < own, 0.0, np.log10((c + SMOOTH) / mass[cls]))
        cols = [docs.column(k) for k in ("doc_id", "held_out", "key")]
        sums = [pa.array(x) for x in (np.diff(ends, prepend=0), add((c > 0).astype(np.int64)), add(np.log10((c + SMOOTH) / z)), add(inner))]
        return pa.table([*cols, *sums, *_packed(cls[ids], ends)], names=["doc_id", "held_out", "key", "n_tokens", "n_known", "base_score", "inner", *PLANES])

    schema = f"doc_id {kind}, held_out boolean, key long, n_tokens long, n_known long, base_score double, inner double, {PLANE_TYPES}"
    known = known.select(F.col("block").alias("of"), "place", "c", "cls")
    return docs.select("block", "doc_id", "held_out", "key", *PLANES).groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, schema)


def train(prepared: DataFrame, share: np.ndarray, end: int, *, shard_tokens: int = SHARD_TOKENS, fan: int = 64) -> Model:
    """The average of the shards' models, each one pass over its texts from a common start."""
    n = len(share)
    learns = prepared.filter(~F.col("held_out"))
    docs, total = learns.agg(F.count("*"), F.sum("n_tokens")).first()
    spread = min(1.0, WARM_DOCS / docs)
    picked = learns.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(spread * (1 << 40))) if spread < 1 else learns
    sample = picked.groupBy("key").agg(F.first(F.struct(*PLANES)).alias("p")).orderBy("key").collect()
    model = Model.fresh(share)
    if sample:
        first, ends = _unpacked([[r["p"][c] for r in sample] for c in PLANES])
        trainer = Trainer(model, share)
        for _ in range(4):
            trainer.learn(first, ends, end, 512)
    start, shards = model.flat.tobytes(), -(-int(total) // shard_tokens)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("doc_id", "ascending")])
        shard = table.column("shard")[0].as_py()
        model = Model(np.frombuffer(start, dtype=np.float32).copy(), n)
        classes, ends = _of(table)
        Trainer(model, share, seed=shard, start=10.0).learn(classes, ends, end)
        return pa.table([pa.array([shard], pa.int64()), pa.array([model.flat.tobytes()], pa.binary()), pa.array([float(len(classes))])], names=["shard", "flat", "weight"])

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        weight = table.column("weight").to_numpy()
        flat = sum(np.frombuffer(f, dtype=np.float32).astype(np.float64) * w for f, w in zip(table.column("flat").to_pylist(), weight)) / weight.sum()
        return pa.table([pa.array([table.column("shard")[0].as_py() // fan], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary()), pa.array([float(weight.sum())])], names=["shard", "flat", "weight"])

    schema = "shard long, flat binary, weight double"
    parts = learns.select("key", "doc_id", *PLANES, F.pmod("key", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(run, schema)
    while shards > 1:  # a tree of averages: no task holds more than ``fan`` models
        parts = stored(parts).groupBy(F.floor(F.col("shard") / fan)).applyInArrow(mean, schema)
        shards = -(-shards // fan)
    return Model(np.frombuffer(parts.first()["flat"], dtype=np.float32).copy(), n)


@dataclass
class Fitted:
    """A trained model with the documents that it was fitted on, ready to be scored."""

    prepared: DataFrame
    total: int
    classes: Classes
    model: Model | None


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fold: int = 10, block_chars: int = BLOCK_CHARS, shard_tokens: int = SHARD_TOKENS) -> Fitted:
    """Counts, classes and the model, from the documents whose crc32 of the id isn't divisible by ``fold``."""
    rows = stored(coded(_rows(docs, doc_id, text, fold), block_chars), "zstd")
    tokens = rows.filter(F.col("token").isNotNull())
    total = tokens.agg(F.sum("c")).first()[0] or 0
    counted, shapes = _counted(tokens, total)
    known, classes, kinds = _classes(counted, shapes)
    prepared = stored(_prepared(rows.filter(F.col("token").isNull()), known, classes, total + SMOOTH * (kinds + 1)), "zstd")
    for done in (rows, counted):
        removed(done)
    model = train(prepared, classes.share, classes.of(END), shard_tokens=shard_tokens) if total else None
    return Fitted(prepared, total, classes, model)


def scored(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; ``how``: see ``fit``."""
    fitted = fit(docs, **how)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    out = fitted.prepared.select(*names, F.lit(fitted.total).cast("long").alias("train_tokens"), "inner", *PLANES)
    if fitted.model is None:
        return out.select(*names, "train_tokens", F.col("base_score").alias("score"))
    flat, n, end = fitted.model.flat.tobytes(), fitted.model.n, fitted.classes.of(END)
    kind = fitted.prepared.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = Model(np.frombuffer(flat, dtype=np.float32), n)
        for table in _blocks(batches, "b0", 1_000_000):
            classes, ends = _of(table)
            starts = np.concatenate([[0], ends[:-1]])
            by = np.add.reduceat(model.log10(*contexts(classes, ends, end), classes), starts)
            cols = [table.column(c).combine_chunks() for c in (*names, "train_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(by + table.column("inner").to_numpy())], names=[*names, "train_tokens", "score"])

    return out.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
