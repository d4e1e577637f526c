"""Fill-in-middle, source mixing and the filter audit against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus
from plumbline.llm import fill_in_middle, filter_audit, source_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def fim(doc_id, text):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(units), form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def line_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab\n\n\U0001f600é<", k=rng.randint(0, 60))) for _ in range(300)]
    return [*texts, "\n", "\n\n\n", "x", "x\n", "a<P>b\nc", "ends <\nS>\n<M\n", "\U0001f600a" * 3000 + "\n", "\n" * 4000, "a\r\nb\x0bc\nd"]


@pytest.mark.parametrize("chunk", [1, 2, 7, 16_384])
def test_fim_cuts(spark, chunk):
    texts = dict(enumerate(line_texts()))
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    found = fill_in_middle.fill_in_middle(docs, chunk=chunk).withColumn("back", fill_in_middle.restored(fill_in_middle.F.col("output"), fill_in_middle.F.col("form")))
    got = {r.doc_id: r for r in found.collect()}
    for k, t in texts.items():
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim(k, t), (k, t)
        assert r.back == t


def test_fim_corpus(spark, docs, empty):
    found = fill_in_middle.fill_in_middle(docs).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == Counter((r[0], *fim(r[0], r[1] or "")) for r in corpus.rows())
    out = fill_in_middle.transformed(docs)
    assert out.columns == docs.columns and fill_in_middle.transformed(empty).count() == 0
    texts = Counter((r[0], fim(r[0], r[1] or "")[4]) for r in corpus.rows())
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == texts and all(r.found == "mine" for r in out.collect())
    assert fill_in_middle.fill_in_middle(docs, rate=0).filter("form <> 'plain'").count() == 0


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def audited(docs, labels):
    """The contract, order by order and document by document."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(smallest.get(t or "", d), d)
    rows = []
    for d, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > smallest[t]}
        rows.append((part or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before, gone = set(order[:k]), [r for r in mine if f in r[1] and not r[1] & set(order[:k])]
                out[part, order, k + 1] = (
                    sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, docs, empty):
    rng = random.Random(8)
    data = [(r[0], r[1], r[2]) for r in corpus.rows()]
    for k in range(100, 260):
        text = " ".join(corpus.words(rng, rng.choice([20, 250]), rng.choice(["ab", "abcdefgh"]))) + rng.choice(["", " 5 % off", " LOUD" * 40])
        data += [(k, text, rng.choice(["en", "de", "", None]))] * rng.choice([1, 1, 2]) + [(k + 1000, text, "en")] * rng.choice([0, 1])
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 1200)] + [(100, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(d, t, p, "mine", 1) for d, t, p in data], "doc_id long, text string, lang string, digest string, mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(table, marks).collect()
    want = audited(data, labels)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert filter_audit.filter_audit(empty, marks).count() == 0
    assert filter_audit.filter_audit(docs, marks.limit(0)).count() == 600 * 2


def shared(sizes, weights=(1, 2, 3), most=3):
    """Targets by the contract's rounds: fill, hold what is full, share the excess again."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        left, free = total - sum(most * sizes[s] for s in held), [s for s in names if s not in held]
        target = {s: most * sizes[s] if s in held else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        held |= over


def sources(seed, n=4000):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "big", "tiny", "Z", "é", "one"]
    out = []
    for k in range(n):
        source = rng.choices(names, [3, 3, 10, 10, 70, 1, 5, 5, 0])[0]
        out.append((k, " ".join(["w"] * int(rng.lognormvariate(4, 1.2))), source))
    return [*out, (None, "null id words", "a"), (n, None, "a"), (n + 1, "x " * 9, "one"), (n + 2, "  ", "none"), *[(n + 3, "again and again", "b")] * 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_source_mixing(spark, seed):
    data = sources(seed)
    docs = spark.createDataFrame([(*r, "mine") for r in data], "doc_id long, text string, source string, size string")
    got = source_mixing.mix_sources(docs).collect()
    assert sorted(source_mixing.mix_sources(docs.repartition(13)).collect(), key=repr) == sorted(got, key=repr)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, s in data)
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = shared(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and r.taken <= 3 * r.size
        assert r.copies >= int(r.target / r.source_size) if r.source_size else r.copies == 0
        taken[r.source] += r.taken
    for s in sizes:
        n = sum(1 for r in got if r.source == s)
        assert abs(taken[s] - want[s]) <= (0.001 * want[s] + 3 if n > 20 else max(r.size for r in got if r.source == s)), (s, taken[s], want[s])


def test_source_mixing_follows_probabilities(spark):
    """Over many seeds each document is taken as often as its expectation says, whatever its size."""
    sizes = [10, 20, 30, 40, 50] * 20
    docs = spark.createDataFrame([(k, "w " * n, s) for s in "ab" for k, n in enumerate(sizes)], "doc_id long, text string, source string").coalesce(1).cache()
    taken, runs = Counter(), 12
    for seed in range(runs):
        for r in source_mixing.mix_sources(docs, seed=seed, spare=5).collect():
            taken[r.source, r.size] += r.copies
    for (s, n), c in taken.items():
        assert c / (20 * runs) == pytest.approx({"a": 2 / 3, "b": 4 / 3}[s], abs=0.15), (s, n)


def test_source_mixing_by_weight(spark, docs, empty):
    """Documents of more weight come more often, three times at most, and the words still come near the target."""
    rng = random.Random(4)
    data = [(k, "w " * rng.randint(5, 60), "a", w) for k in range(1000) for w in [rng.choice([0.0, 1.0, 2.0, 50.0])]] + [(5000 + k, "w " * 200, "b", 1.0) for k in range(300)]
    got = source_mixing.mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string, q double"), weight="q").collect()
    weight = {r[0]: r[3] for r in data}
    mean = {w: sum(r.copies for r in got if r.source == "a" and weight[r.doc_id] == w) / sum(1 for r in got if r.source == "a" and weight[r.doc_id] == w) for w in (0.0, 1.0, 2.0, 50.0)}
    assert mean[0.0] < 0.05 and mean[1.0] < mean[2.0] < mean[50.0] and mean[50.0] == 3
    a = [r for r in got if r.source == "a"]
    assert abs(sum(r.taken for r in a) - a[0].target) <= 60
    assert source_mixing.mix_sources(empty).count() == 0 and source_mixing.mixed(empty).count() == 0
    out = source_mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in source_mixing.mix_sources(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +copies
