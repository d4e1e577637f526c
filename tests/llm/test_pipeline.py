"""The pipeline's rows and every stage against plain Python, and the registry's SQL twins."""

import re
import zlib
from collections import Counter, defaultdict

import corpus
import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(records):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in records)


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_decontamination"])
def test_sql_twin(spark, name):
    from plumbline.llm import registry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert rows(got.select(*sorted(got.columns)).collect()) == rows(want.project(", ".join(sorted(want.columns))).fetchall())


def good(docs):
    """docs: {id: (text, source)}. Those that the rules keep, without frequent lines."""
    key = lambda x: " ".join(x.lower().split())
    lines = {d: [x for x in t.split("\n") if WORD.search(x)] for d, (t, _) in docs.items()}
    held, texts, hosts = defaultdict(set), defaultdict(set), Counter(s for _, s in docs.values())
    for d, (t, s) in docs.items():
        for x in lines[d]:
            held[s, key(x)].add(d)
            texts[s, key(x)].add(t)
    gone = {k for k, v in held.items() if len(v) > 50 and len(texts[k]) > 50 and len(v) > 0.05 * hosts[k[0]]}
    out = {}
    for d, (t, s) in docs.items():
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lost = sum(len(x.split()) for x in lines[d] if (s, key(x)) in gone)
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and len(w) - lost >= 0.3 * len(w):
            out[d] = ("\n".join(x for x in t.split("\n") if (s, key(x)) not in gone), s)
    return out


def distinct(docs):
    """One of each component of exact 5-word Jaccard of 0.8, by all pairs."""
    sets = {}
    for d, (t, _) in docs.items():
        w = t.translate(LOWER).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    of = {d: d for d in docs}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                of[y] = x
    return {d: v for d, v in docs.items() if of[d] == d}


def clean(docs, items):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    wanted = [s for s in map(shingles, items) if s]
    return {d: v for d, v in docs.items() if not any(5 * len(s & shingles(v[0])) >= 4 * len(s) for s in wanted)}


def hidden(docs):
    """Secrets replaced; on the tables only the three base kinds occur."""
    rules = [(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A), (r"AKIA[A-Z0-9]{12,}", 0), (r"[0-9a-f]{32,}", 0)]
    out = {}
    for d, (t, s) in docs.items():
        spans, at, parts = sorted(m.span() for p, f in rules for m in re.finditer(p, t, f)), 0, []
        for a, b in spans:
            if a >= at:
                parts += [t[at:a], "[SECRET]"]
            at = max(at, b)
        out[d] = ("".join([*parts, t[at:]]), s)
    return out


def test_pipeline_rows(spark):
    import corpus_pipeline
    from plumbline.llm import tokens
    from tokenizers import Tokenizer

    table = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), coalesce(source, '') FROM '{SF}/documents.parquet'").fetchall()
    items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    want = hidden(clean(distinct(good({d: (t, s) for d, t, s in table})), items))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]].append(r)
    assert set(got) == set(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    t, filled = Tokenizer.from_file(tokens.default_path()), Counter()
    for d, pieces in got.items():
        ids, at = np.array([*t.encode(want[d][0], add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for p in sorted(pieces, key=lambda p: p.piece):
            assert (p.start, p.ids_crc32) == (at, zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
            filled[p.sequence_id] += p.length
        assert at == len(ids)
    assert max(filled.values()) <= 2048


@pytest.mark.parametrize("k", range(4))
def test_stages_on_awkward_rows(spark, docs, empty, tmp_path, k):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables; columns stay as they are."""
    import corpus_pipeline

    spark.createDataFrame([(1, " ".join(corpus.rows()[3][1].split("\n")[1].split()[:40])), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert set(ids) <= {r[0] for r in corpus.rows()} and all(r._hash == r.text_hash == r._row == "mine" for r in got.collect())
    want = [{1, 2, 3, 4, 5, 12, 14, None}, {1, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15, None}, {r[0] for r in corpus.rows()} - {4, 5}, {r[0] for r in corpus.rows()}][k]
    if k != 0:
        assert set(ids) == want
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_packing_stage_on_awkward_rows(spark, docs, empty):
    import corpus_pipeline

    got = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r[0] for r in corpus.rows()}
    assert corpus_pipeline.STAGES[4][1](spark, empty, "").count() == 0
