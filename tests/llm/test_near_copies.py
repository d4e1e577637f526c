"""The pipeline's near copies against the exact Jaccard of all pairs."""

import random

import corpus
import numpy as np
from plumbline.llm import near_copies


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    """The ids that stay: the least of each component of links at 0.8."""
    of, sets = {d: d for d in texts}, {d: grams(t) for d, t in texts.items()}
    top = lambda x: x if of[x] == x else top(of[x])
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                of[y] = x
    return {d for d in ids if of[d] == d}


def planted():
    rng, texts = random.Random(11), {}
    for group in range(40):
        base = corpus.words(rng, 200)
        texts[len(texts)] = " ".join(base)
        for _ in range(5):
            copy = list(base)
            for at in rng.sample(range(200), rng.randint(1, 6)):  # Jaccard about 0.75 to 0.97
                copy[at] = "changed%d" % rng.randint(0, 10**6)
            texts[len(texts)] = " ".join(copy)
    return texts


def test_pipeline_stage_finds_pairs_from_0_8_to_0_97(spark):
    import corpus_pipeline

    texts = planted()
    data = [(d, t, "en", "s", len(t), "", d, "") for d, t in texts.items()]
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, corpus.table(spark, data), "").collect()}
    assert got == brute(texts)


def test_awkward_rows(docs, empty):
    got = near_copies.deduplicated(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(brute({r[0]: r[1] or "" for r in corpus.rows() if r[0] is not None}))
    assert None in ids and near_copies.deduplicated(empty).count() == 0


def test_odd_sketches_differ_in_no_more_places_than_sets(spark):
    rng = np.random.default_rng(5)
    rows = []
    for size in (1, 10, 150, 1000, 20000):
        for changed in (0, 1, size // 10, size // 5, size):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            rows.append((near_copies.odd_sketch(a), near_copies.odd_sketch(b), len(np.setxor1d(a, b))))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, apart int").select("apart", near_copies.unlike("a", "b").alias("n")).collect()
    assert all(r.n <= r.apart for r in got) and all(r.n >= 0.7 * r.apart for r in got if r.apart <= 300)
