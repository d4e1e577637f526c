"""Each operator against plain Python over a small table with the awkward cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus
from plumbline.llm import decontamination, licenses, lm_scoring, packing, quality_crf, quality_rules, secrets, simhash, substring, token_counts, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def texts():
    return [(r[0], r[1] or "") for r in corpus.rows()]


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.quality_rules(docs))
    for doc, text in texts():
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        for r in got[doc]:
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again)), doc
            assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_dup_lines == len(lines) - len(set(lines))
            assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.kept_documents(docs).columns == docs.columns
    kept = quality_rules.kept_documents(docs).collect()
    assert len(kept) == sum(r.kept for rs in got.values() for r in rs) and all(r._hash == r._host == r.found == "mine" for r in kept)
    assert quality_rules.quality_rules(docs).filter("kept").count() == len(kept)


def test_frequent_lines_of_small_hosts(spark):
    """Over a tenth of a small host's documents and texts, and over five, make a line frequent."""
    line = "the same line\n"
    hosts = {"fifty six": (50, 6), "fifty five": (50, 5), "ten six": (10, 6), "eighty eight": (80, 8), "eighty nine": (80, 9)}
    data, expected = [], {}
    for host, (n, holds) in hosts.items():
        for k in range(n):
            doc = len(data)
            data.append((doc, (line if k < holds else "") + f"word{doc} " * 6, "en", host, 7, "", 0, ""))
            expected[doc] = 1 / 3 if k < holds and host in ("fifty six", "ten six", "eighty nine") else 0
    docs = corpus.table(spark, data)
    for most in (100_000, 0):  # hosts broadcast or shuffled
        got = by_id(quality_rules.quality_rules(docs, min_words=1, max_repeat_percent=100, most_hosts=most))
        assert {d: pytest.approx(r[0].removed_share) for d, r in got.items()} == expected
    near = [(k, line * 3 + "other words" * (1 + k % 5), "en", "copies", 7, "", 0, "") for k in range(40)]
    assert all(r.removed_share == 0 for r in quality_rules.quality_rules(corpus.table(spark, near)).collect())


def test_frequent_lines_go_and_deplete(spark):
    """100 documents of one host with two menu lines; 80 have hardly more. Copies of one text make no line frequent."""
    menu = "Menu  one\nmenu two\n"
    data = [(k, menu + ("word%d " % k) * (1 if k < 80 else 60), "en", "h", 7, "", 0, "") for k in range(100)]
    data += [(100 + k, "the very same line of a copied text\n" * 3 + "other words", "en", "h", 7, "", 0, "") for k in range(200)]
    docs = corpus.table(spark, data)
    limits = {"min_words": 1, "max_repeat_percent": 100}
    got = by_id(quality_rules.quality_rules(docs, **limits))
    assert all(got[k][0].kept == (k >= 80) for k in got) and all(got[k][0].removed_share == 0 for k in range(100, 300))
    assert got[0][0].removed_share == pytest.approx(4 / 5) and got[90][0].removed_share == pytest.approx(4 / 64)
    for most in (200_000, 0):  # broadcast or shuffled
        kept = by_id(quality_rules.kept_documents(docs, most_broadcast=most, **limits))
        assert set(kept) == set(range(80, 300))
        assert all(kept[k][0].text == ("word%d " % k) * 60 and kept[k][0].n_chars == len(kept[k][0].text) for k in range(80, 100))
        assert kept[100][0].text == data[100][1] and kept[100][0].n_chars == 7 and kept[90][0].host == "mine" and kept[90][0]._hash == "mine"


def test_simhash(docs, empty):
    def plain(text):
        import xxhash

        w = WORD.findall(text.translate(LOWER))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        ones = [0] * 64
        for x in s:
            h = xxhash.xxh64_intdigest(x.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))

    got = by_id(simhash.near_duplicates(docs))
    fp = {d: plain(t) for d, t in texts()}
    parent = {d: d for d in fp if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in parent:
        for b in parent:
            if bin(fp[a] ^ fp[b]).count("1") <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for d, rs in got.items():
        for r in rs:
            assert r.fp % (1 << 64) == fp[d]
            assert d is None or r.component_id == root(d)
    assert simhash.near_duplicates(empty).count() == 0
    left = [r["doc_id"] for r in simhash.deduplicated(docs).collect()]
    assert sorted(d for d in left if d is not None) == sorted({root(d) for d in parent})


def test_covering_masks_and_small_buckets(spark):
    """Every pair within three bits meets, also when buckets are split again and again."""
    rng = np.random.default_rng(3)
    for level in range(5):
        masks = np.array(simhash.masks(level), dtype=np.int64).view(np.uint64)
        for _ in range(300):
            x = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64))
            assert ((masks & x) == 0).any()
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    for _ in range(400):
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(1, 5), replace=False)))
    fps = [int(x) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket_limit=8)
    from plumbline.llm.components import components

    got = {r["node"]: r["component"] for r in components(edges).collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(got.get(x, x) == root(x) for x in fps)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    got = by_id(packing.packed(docs))
    for doc, text in texts():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        copies = sum(1 for d, _ in texts() if d == doc)
        at = 0
        for k, r in enumerate(sorted(got[doc], key=lambda r: r.piece)[::copies]):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length <= 2048 and (k == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in (r for rs in got.values() for r in rs):
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(empty).count() == 0


def test_plan_fills_sequences():
    rng = np.random.default_rng(1)
    lengths = rng.integers(10, 600, 3000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    configs = packing.plan(histogram, 600)
    used = Counter()
    for config, times in configs:
        assert sum(s * n for s, n in config.items()) <= 600 and times > 0
        for s, n in config.items():
            used[s] += n * times
    assert used == Counter(histogram)
    assert sum(t for _, t in configs) <= 1.01 * math.ceil(lengths.sum() / 600) + 1


def test_encoder_is_exact():
    from tokenizers import Tokenizer

    e = tokens.Encoder(tokens.default_path(), most=5)
    t = [x for _, x in texts()] + ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n\nc <|endoftext|><|endoftext|>", "x  \n<|endoftext|>  y", "word " * 450_000, "a  b\n\n c", "  x ", "a\n", "<|endoftext|> hi", "a\x1cb !\x1c!", "é　b", "x" * 5000]
    plain = Tokenizer.from_file(tokens.default_path())
    ref = [np.array(x.ids, dtype="<u4").tobytes() for x in plain.encode_batch(t, add_special_tokens=False)]
    assert np.frombuffer(ref[len(texts())], dtype="<u4").tolist() == [plain.token_to_id("<|endoftext|>")]
    assert e.ids(t) == ref and e.ids(t[::-1]) == ref[::-1]


@pytest.mark.parametrize(("window", "shard"), [(50, 200), (7, 200), (50, 1)])
def test_substring_dedup(docs, empty, window, shard, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_DOCS", shard)  # 1: every anchor is dealt over many shards
    w = {d: t.encode().split() for d, t in texts()}
    owner = {}
    for d in sorted(x for x in w if x is not None):
        for i in range(len(w[d]) - window + 1):
            owner.setdefault(tuple(w[d][i : i + window]), d)
    for d, rs in by_id(substring.substring_dedup(docs, window=window)).items():
        gone = {j for i in range(len(w[d]) - window + 1) if d is not None and owner[tuple(w[d][i : i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w[d]) if j not in gone)
        for r in rs:
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w[d]), len(gone), hashlib.sha256(kept).hexdigest()), d
    assert substring.substring_dedup(empty).count() == 0


def test_license_scan(docs, empty):
    model = licenses.train(docs)
    found = licenses.license_scan(docs, model).filter("confirmed").collect()
    assert [(r.doc_id, r.paragraph, r.start, r.end, r.family) for r in found] == [(13, 0, 0, 47, "Apache-2.0")]
    wrapped = "intro\n" + "\n".join(["# Permission is hereby granted, free of charge, to any", "# person obtaining a copy of this software and", "# associated documentation files"]) + "\n\nother"
    assert [(n, a, b, f) for n, a, b, f, *_ in licenses.findings(model, wrapped, 0.5)] == [(1, 6, wrapped.index("\n\n"), "MIT")]
    assert [f[3] for f in licenses.findings(model, "x\nAll rights reserved.\ny", 0.5)] == ["proprietary"]
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            assert model.predict("some words first " + t)[0] == family, t
    for text in ("this is no licence at all", "version 2 of the plan", "licensed", "", "the terms of use"):
        assert model.predict(text)[0] == licenses.UNKNOWN, text
    assert licenses.license_scan(empty, licenses.train(empty)).count() == 0


def test_lm_scoring(docs, empty):
    tokens_of = {d: [*WORD.findall(t.translate(LOWER)), "\n"] for d, t in texts()}
    held = {d: d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens_of}
    counts = Counter(w for d, _ in texts() if not held[d] for w in tokens_of[d])
    total = sum(counts.values())
    z = total + 0.1 * (len(counts) + 1)
    for d, rs in by_id(lm_scoring.scored(docs)).items():
        for r in rs:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens_of[d]), sum(counts[w] > 0 for w in tokens_of[d]), total)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / z) for w in tokens_of[d]))
    assert lm_scoring.scored(empty).count() == 0
    unseen = lm_scoring.scored(docs.filter("doc_id IS NULL")).first()  # nothing to learn from
    assert unseen.score == unseen.base_score == 0 and unseen.n_known == 0


def plain_model(fitted):
    """(class of a token, its share in it, P(class | classes before)) from the fitted parts, one number at a time."""
    import xxhash

    c, m = fitted.classes, fitted.model
    counts = Counter(w for d, t in texts() if d is not None and zlib.crc32(str(d).encode()) % 10 for w in [*WORD.findall(t.translate(LOWER)), "\n"])
    frequent = {t: k for k, t in enumerate(c.tokens)}

    def of(token):
        h = xxhash.xxh64_intdigest(token[-3:].encode(), 42)
        return frequent.get(token, len(frequent) + (h - (1 << 64) * (h >> 63)) % c.shapes)

    mass = [0.1 * (k >= len(frequent)) for k in range(len(frequent) + c.shapes)]
    for t, n in counts.items():
        mass[of(t)] += n + 0.1

    def p(one, two):
        h = m.context[one] * m.scale[0] + m.context[two] * m.scale[1]
        e = [math.exp(float(h @ m.target[k]) + float(m.bias[k])) for k in range(m.n)]
        return [x / sum(e) for x in e]

    return counts, of, lambda t: (counts.get(t, 0) + 0.1) / mass[of(t)], p


def test_lm_score_is_the_models_normalised_probability(docs):
    fitted = lm_scoring.fit(docs)
    counts, of, inside, p = plain_model(fitted)
    got = by_id(lm_scoring.scored(docs))
    for d, t in texts():
        words = [*WORD.findall(t.translate(LOWER)), "\n"]
        if len(words) > 500:
            continue
        before, want = ["\n", "\n"], 0.0
        for w in words:
            want += math.log10(p(of(before[-1]), of(before[-2]))[of(w)] * inside(w))
            before.append(w)
        assert all(r.score == pytest.approx(want, rel=1e-4) for r in got[d]), d
    # over all known tokens and one unseen token of each shape the probabilities add up to one
    classes = p(of("\n"), of("one"))
    unseen = sum(classes[len(fitted.classes.tokens) + k] * 0.1 / fitted.classes.mass[len(fitted.classes.tokens) + k] for k in range(fitted.classes.shapes))
    assert sum(classes[of(w)] * inside(w) for w in counts) + unseen == pytest.approx(1, abs=1e-4)


def test_lm_scores_do_not_depend_on_partitions_blocks_or_batches(docs):
    """Many blocks and several shards, from 1 and from 7 partitions."""
    runs = [by_id(lm_scoring.scored(docs.repartition(n), block_chars=chars, shard_tokens=5_000)) for n, chars in ((1, 3_000), (7, 1_000_000))]
    for d in runs[0]:
        assert [r.score for r in runs[0][d]] == pytest.approx([r.score for r in runs[1][d]], rel=1e-5)


def test_lm_learns_on_held_out_documents(spark):
    rng = np.random.default_rng(5)
    follows = rng.integers(60, size=(60, 3))
    data = []
    for k in range(400):
        at, words = int(rng.integers(60)), []
        for _ in range(80):
            words.append(f"w{at}x")
            at = int(follows[at, rng.integers(3)])
        data.append((k, " ".join(words), "en", "s", 0, "", 0, ""))
    rows = lm_scoring.scored(corpus.table(spark, data)).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.3 * sum(r.n_tokens for r in rows)


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    ids = np.zeros(6000, dtype=np.int32)
    for k in range(1, len(ids)):  # mostly the next of eight
        ids[k] = (ids[k - 1] + 1) % 8 if rng.random() < 0.9 else rng.integers(8)
    share = np.bincount(ids, minlength=8) / len(ids)
    model, ends = lm_scoring.Model.fresh(share), np.array([len(ids)])
    one, two = lm_scoring.contexts(ids, ends, 0)
    every = sum(10 ** model.log10(one[:50], two[:50], np.full(50, c)) for c in range(8))
    assert every == pytest.approx(np.ones(50), abs=1e-5)
    before = model.log10(one, two, ids).mean()
    trainer = lm_scoring.Trainer(model, share)
    for _ in range(20):
        trainer.learn(ids, ends, 0, 512)
    assert model.log10(one, two, ids).mean() > before + 0.3


def test_decontamination(spark, docs, empty):
    passage = corpus.rows()[4][1].split(" ")[:70]
    items = spark.createDataFrame([(1, " ".join(passage[5:35])), (2, "no such words anywhere in here at all"), (3, None), (4, "One!"), (5, " ".join([*passage[:40], *["zz"] * 40]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contaminated(docs, items).collect()}

    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {}
    for r in items.collect():
        mine = shingles(r.text)
        for d, t in texts():
            if mine and 5 * len(mine & shingles(t)) >= 4 * len(mine):
                want[d, r.item_id] = len(mine & shingles(t)) / len(mine)
    assert got == want and {(4, 1), (5, 1), (8, 4), (9, 4)} <= set(want)
    clean = decontamination.decontaminated(docs, items).collect()
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in clean} == {d for d, _ in want}
    assert all(r.text_hash == r._hash == "mine" for r in clean)
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_token_counts(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    plain = {d: len(t.encode(x, add_special_tokens=False).ids) for d, x in texts()}
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("a", token_counts.signed(docs, 1)) and not ledger.commit("a", token_counts.signed(docs, 1))
    total = lambda: tuple(ledger.totals().groupBy().sum("n_docs", "n_tokens").first())
    n = sum(plain[d] for d, _ in texts())
    assert total() == (len(texts()), n)
    gone = docs.filter("doc_id = 12")
    ledger.commit("b", token_counts.signed(gone, -1))
    assert total() == (len(texts()) - 1, n - plain[12])
    from pyspark.sql import functions as F

    old = docs.filter("doc_id = 8")
    ledger.commit("c", token_counts.revised(old, old.withColumn("text", F.lit("one two three")).withColumn("source", F.lit("new"))))
    assert total() == (len(texts()) - 1, n - plain[12] - plain[8] + 3)
    ledger.commit("d", token_counts.signed(empty, 1))
    assert total()[0] == len(texts()) - 1
    from plumbline.llm import base

    one = spark.createDataFrame([("s", "en", "v", 1, 1, 1)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long")
    assert not base.published(one, ledger.path, "d") and total()[0] == len(texts()) - 1  # another job's batch of that id was first


def test_token_counts_query_equals_plain_counts(spark):
    """After inserts, revisions, deletes and a batch sent twice: SQL over the library's own counts."""
    import duckdb
    import pandas as pd
    from tokenizers import Tokenizer

    sf, t = "/root/testdata/sf0.001", Tokenizer.from_file(tokens.default_path())
    table = duckdb.sql(f"SELECT source, lang, coalesce(text, '') AS text FROM '{sf}/documents.parquet'").df()
    counts = pd.DataFrame({"source": table.source, "lang": table.lang, "n": [len(t.encode(x, add_special_tokens=False).ids) for x in table.text], "chars": table.text.str.len()})
    want = duckdb.sql("SELECT source, lang, count(*), sum(n)::BIGINT, sum(chars)::BIGINT FROM counts GROUP BY 1, 2").fetchall()
    got = token_counts.op8_token_counts(spark, sf).collect()
    assert sorted((r.source, r.lang, r.n_docs, r.n_tokens, r.n_chars) for r in got) == sorted(want)


def test_quality_classifier(spark):
    rng = np.random.default_rng(4)
    data, labels = [], []
    for k in range(300):
        good = k % 4 > 0
        word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
        line = (lambda: " ".join(word() for _ in range(12)) + ".") if good else (lambda: " ".join(word().upper() + "###" for _ in range(12)))
        data.append((k, "\n".join(line() for _ in range(rng.integers(1, 6))), "en", "s", 0, "", 0, ""))
        labels.append((k, int(good), 0))
    docs, labels = corpus.table(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(quality_crf.scored(docs, quality_crf.train(docs, labels)))
    held = [k for k in got if got[k][0].held_out]
    assert held and sum((got[k][0].score >= 0.3) == (k % 4 > 0) for k in held) >= 0.95 * len(held)
    assert all(r.score == 0.5 for rs in by_id(quality_crf.scored(docs.limit(5), None)).values() for r in rs)


def test_quality_scores_awkward_rows(docs, empty):
    model = quality_crf.fit([(*quality_crf.line_features(t), k % 2) for k, (_, t) in enumerate(texts())])
    assert all(0 <= r.score <= 1 for rs in by_id(quality_crf.scored(docs, model)).values() for r in rs)
    assert quality_crf.scored(empty, model).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    unary, pair = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    p = np.zeros((5, 2))
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        w = np.exp(sum(unary[k, y[k]] for k in range(5)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        for k in range(5):
            p[k, y[k]] += w
    assert quality_crf.marginals(unary, pair) == pytest.approx(p / p.sum(axis=1, keepdims=True))


def plain_spans(text):
    rules = [("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)]
    out = []
    for k, (name, p, n) in enumerate(rules):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(p, text, re.I | re.A if k == 0 else 0) if len(m[1] if k == 0 else m[0]) >= n]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(out)]


def test_secret_scan(docs, empty, tmp_path):
    found = secrets.secret_scan(docs, str(tmp_path / "ledger"))
    from pyspark.sql import functions as F

    got = by_id(found.select("doc_id", secrets.shown(F.col("found")).alias("s")))
    for d, t in texts():
        assert all(r.s.split(",") == (plain_spans(t) or [""]) for r in got[d]), d
    assert secrets.secret_scan(empty, str(tmp_path / "none")).count() == 0
    rows = secrets.redacted(docs, found).collect()
    assert all(r.blob in ("clash", None) and r.kept == r._found == "mine" and r.n_chars in (None, len(r.text or "")) for r in rows)
    assert "n_chars" not in secrets.redacted(docs.drop("n_chars"), found).columns
    renamed = secrets.redacted(docs.withColumnRenamed("text", "body"), found, text="body").collect()
    assert sorted((r.doc_id or 0, r.body or "") for r in renamed) == sorted((r.doc_id or 0, r.text or "") for r in rows)
    clean = {r["doc_id"]: r["text"] for r in rows}
    assert clean[11] == "[SECRET]\" and [SECRET] then [SECRET]" and clean[1] == texts()[0][1] and clean[7] is None


def test_many_matches_in_one_text(spark, tmp_path):
    rng = np.random.default_rng(6)
    parts = [rng.choice(["token = abcdefgh%d" % k, "AKIA" + "B" * 12 + "%d" % k, "secret=short", "0123456789abcdef" * 2, "plain \U0001f600 words", "password: " + "0a" * 20]) for k in range(4000)]
    docs = corpus.table(spark, [(1, " ".join(parts), "en", "s", 0, "", 0, "")])
    found = secrets.secret_scan(docs, str(tmp_path / "l"))
    from pyspark.sql import functions as F

    assert found.select(secrets.shown(F.col("found")).alias("s")).first().s.split(",") == plain_spans(" ".join(parts))
    left = secrets.redacted(docs, found).first().text
    assert not plain_spans(left) and left.count("plain \U0001f600 words") == parts.count("plain \U0001f600 words")


def test_ledger_scans_new_blobs_only(spark, docs, tmp_path):
    ledger = secrets.BlobLedger(spark, str(tmp_path / "l"))
    ledger.commit("one", docs.filter("doc_id < 10"))
    n = ledger.findings().count()
    ledger.commit("one", docs)  # the batch is there: nothing happens
    assert ledger.findings().count() == n
    with pytest.raises(Exception, match="the ledger lacks blob"):
        ledger.report(docs).collect()
    ledger.commit("two", docs)
    assert ledger.findings().count() == docs.select("text").na.fill("").distinct().count()
    ledger.commit("three", docs, rule_version="other")
    assert ledger.findings().filter("rule_version = 'other'").count() == ledger.findings().filter("rule_version <> 'other'").count()
    assert ledger.report(docs).count() == docs.count()


def test_license_features_come_from_runs_of_known_words(monkeypatch):
    from plumbline.llm import licenses

    model = licenses.fit(["plain words of no licence at all", "more plain words", "and some others here"] * 20, rounds=20)
    lines = ["x y licensed under the MIT", "license. z " + "filler " * 50, "", "All rights reserved. the", "the of and", "GNU General Public License version 3 Creative Commons", "under CC0"]
    for text in [*lines, " ".join(lines[:2]), ""]:
        words = licenses.words_in(text)
        assert sorted(model.features(words)) == sorted({g for g in licenses.grams(words) if g in model.weights})
    want = [model.predict(" ".join(lines[a:b])) for a, b in ((0, 1), (0, 2), (3, 4))]
    monkeypatch.setattr(licenses, "grams", None)  # not asked for all n-grams of a text
    assert [model.predict(" ".join(lines[a:b])) for a, b in ((0, 1), (0, 2), (3, 4))] == want
    assert all(start <= end for _, start, end, *_ in licenses.findings(model, "\n".join(lines), 0.5))
