"""Quality classifier: a linear-chain conditional random field over lines.

Each line with a character gets features of itself and of its neighbours. The
field labels lines good or bad; forward-backward gives each line's marginal,
and the marginals' mean, weighted by the lines' lengths, becomes the document's
score after a logistic calibration. It learns from document labels: each line
of a training document takes the document's label.

The field is fitted on the driver from at most ``TRAIN_DOCS`` labelled
documents of at most ``TRAIN_CHARS`` characters, chosen by a hash of their ids. Scoring covers every whole text, of any length.

Defined results
---------------
* A null or empty text has no lines; it scores as all bad, after calibration.
* Without usable labels every score is 0.5.
* Equal texts score alike; a score of 0.3 is predicted good.
* Repeated rows train once and score alike; a null doc_id is held out of training.
* An empty table gives an empty result. labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import documents, text_of

TRAIN_DOCS, TRAIN_CHARS = 3000, 50_000
OWN = 12
WIDTH = 3 * OWN + 1


def _classes() -> np.ndarray:
    """Bit flags of the code points below 256: upper 1, lower 2, digit 4, blank 8, symbol 16, mark 32."""
    t = np.zeros(256, dtype=np.uint8)
    for c in range(256):
        ch = chr(c)
        t[c] = 1 * ch.isupper() | 2 * ch.islower() | 4 * ch.isdigit() | 8 * ch.isspace() | 16 * (ch in "#*$%&|<>{}[]\\^~_=+@") | 32 * (ch in ".,;:!?")
    return t


CLASSES = _classes()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths): one row for each non-empty line, neighbours' features beside its own."""
    lines = [x for x in text.split("\n") if x]
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0)
    lengths = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4")
    kinds = CLASSES[np.minimum(codes, 255)]
    kinds = np.where(codes > 255, 2, kinds)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    share = [np.add.reduceat((kinds & bit) > 0, starts, dtype=np.int64) / lengths for bit in (1, 2, 4, 8, 16, 32)]
    bang = np.add.reduceat(codes == 33, starts, dtype=np.int64) / lengths
    seen: set[str] = set()
    rest = np.empty((len(lines), 5))
    for k, x in enumerate(lines):
        words = x.split()
        n = max(len(words), 1)
        rest[k] = (np.log1p(len(words)), len(x) / n / 10, len(set(words)) / n, x in seen, x[-1] in ".!?")
        seen.add(x)
    own = np.column_stack([*share, bang, rest])
    none = np.zeros((1, OWN))
    return np.column_stack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), np.ones(len(lines))]), lengths


def marginals(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(label) of each line, (n, 2); ``unary`` (n, 2) and ``pair`` (2, 2) are log potentials."""
    n = len(unary)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = unary[0]
    for k in range(1, n):
        alpha[k] = unary[k] + np.logaddexp(alpha[k - 1, 0] + pair[0], alpha[k - 1, 1] + pair[1])
        alpha[k] -= alpha[k].max()
    for k in range(n - 2, -1, -1):
        x = unary[k + 1] + beta[k + 1]
        beta[k] = np.logaddexp(pair[:, 0] + x[0], pair[:, 1] + x[1])
        beta[k] -= beta[k].max()
    p = alpha + beta
    p = np.exp(p - p.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, rounds: int = 150, rate: float = 0.1, l2: float = 1e-3) -> dict | None:
    """The field's weights from (features, lengths, label) of documents, by gradient ascent with Adam.

    All documents step together: place k of every document still that long is one batch.
    """
    rows = sorted((r for r in rows if len(r[0])), key=lambda r: -len(r[0]))
    if not rows or len({r[2] for r in rows}) < 2:
        return None
    x = np.vstack([r[0] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    z = (x - mean) / scale
    n_lines = np.array([len(r[0]) for r in rows])
    first = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
    label = np.array([r[2] for r in rows])
    per_line = np.repeat(label, n_lines)
    weigh = np.repeat(1.0 / n_lines, n_lines)  # each document counts once
    longest = int(n_lines.max())
    live = [int((n_lines > k).sum()) for k in range(longest)]
    w, pair = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(pair)]
    v = [np.zeros_like(w), np.zeros_like(pair)]
    for t in range(1, rounds + 1):
        unary = z @ w
        alpha, beta = np.empty_like(unary), np.zeros_like(unary)
        alpha[first] = unary[first]
        for k in range(1, longest):
            at = first[: live[k]] + k
            a = alpha[at - 1]
            a = unary[at] + np.logaddexp(a[:, :1] + pair[0], a[:, 1:] + pair[1])
            alpha[at] = a - a.max(axis=1, keepdims=True)
        edge = np.zeros((2, 2))
        for k in range(longest - 2, -1, -1):
            at = first[: live[k + 1]] + k
            y = unary[at + 1] + beta[at + 1]
            b = np.logaddexp(pair[:, 0] + y[:, :1], pair[:, 1] + y[:, 1:])
            beta[at] = b - b.max(axis=1, keepdims=True)
            joint = alpha[at][:, :, None] + pair[None] + y[:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            seen = np.zeros_like(joint)
            seen[np.arange(len(at)), label[: live[k + 1]], label[: live[k + 1]]] = 1
            edge += ((seen - joint) * weigh[at][:, None, None]).sum(axis=0)
        p = alpha + beta
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        want = np.eye(2)[per_line]
        grads = [z.T @ ((want - p) * weigh[:, None]) / len(rows) - l2 * w, edge / len(rows) - l2 * pair]
        for i, (g, theta) in enumerate(zip(grads, (w, pair))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta += rate * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    model = {"mean": mean, "scale": scale, "w": w, "pair": pair, "a": 1.0, "b": 0.0}
    raw = np.array([raw_score(model, r[0], r[1]) for r in rows])
    a, b = 4.0, -2.0
    for _ in range(50):  # Newton steps of the calibration
        q = 1 / (1 + np.exp(-(a * raw + b)))
        g = np.array([((label - q) * raw).sum() - 1e-2 * a, (label - q).sum()])
        s = np.maximum(q * (1 - q), 1e-6)
        h = np.array([[(s * raw * raw).sum() + 1e-2, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -2, 2)), b + float(np.clip(d[1], -2, 2))
    return model | {"a": a, "b": b}


def raw_score(model: dict, features: np.ndarray, lengths: np.ndarray) -> float:
    """The length-weighted mean of the lines' probability of being good."""
    if not len(features):
        return 0.0
    p = marginals(((features - model["mean"]) / model["scale"]) @ model["w"], model["pair"])[:, 1]
    return float((p * lengths).sum() / lengths.sum())


def score(model: dict | None, text: str) -> float:
    if model is None:
        return 0.5
    return float(1 / (1 + np.exp(-(model["a"] * raw_score(model, *line_features(text)) + model["b"]))))


def train(docs: DataFrame, labels: DataFrame, *, fold: int = 5, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict | None:
    """A field from the bounded sample of labelled documents out of fold 0."""
    usable = labels.filter(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % fold != 0)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "_quality").limit(train_docs)
    named = docs.select(F.col("doc_id").alias("_doc"), text_of().alias("text")).filter(F.length("text") <= train_chars)
    # ids that repeat count once: the least text stands for an id
    found = named.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_quality").agg(F.min("text").alias("text")).collect()
    return fit([(*line_features(r["text"]), r["_quality"]) for r in sorted(found, key=lambda r: (r["text"], r["_quality"]))])


def scored(docs: DataFrame, model: dict | None, *, doc_id: str = "doc_id", text: str = "text", fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % fold == 0, F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([score(model, t.as_py()) for t in batch.column(2)], pa.float64())], names=["doc_id", "held_out", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
