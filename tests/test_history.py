"""Ignore files against git's own answers, blame against line-by-line replay, incremental stores against runs from scratch."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.operators import blame, facts
from plumbline.sources import ignores
from plumbline.streaming import incremental

RULES = {
    ".gitignore": "# comment\n\n*.log\n!keep.log\n/top.txt\nbuild/\n**/cache/**\ndoc/*.txt\n!doc/a.txt\na/**/z.rs\n\\#odd\n\\!bang\nspace\\ \ntail   \n[ab]x?.c\n[!c-z]y.c\nfoo/bar\n*.tmp\nout\n!out/keep.rs\ndeep/\n",
    "sub/.gitignore": "!*.log\n*.rs\n!main.rs\n/only.here\nnested/**\n!nested/\n!nested/kept.c\n",
    "sub/deep2/.gitignore": "*\n!.gitignore\n!ok.c\n",
}
PATHS = """a.log keep.log top.txt x/top.txt build/a.c x/build/b.c build.c x/cache/y/z.c cache/q.c doc/a.txt doc/b.txt doc/s/b.txt a/z.rs a/b/c/z.rs x/a/z.rs #odd !bang tail axb.c bx1.c cx1.c dx.c
ay.c dy.c foo/bar x/foo/bar foo/bar/q.c q.tmp out/keep.rs out/b.rs sub/x.log sub/x.rs sub/main.rs sub/s/main.rs sub/only.here sub/s/only.here sub/nested/kept.c sub/nested/gone.c sub/nested/d/e.c
sub/deep2/ok.c sub/deep2/no.c sub/deep2/d/ok.c deep/keep.log x/deep/y.c deep sub/deep3/a.c src/ünï.log src/ok.ünï""".split()


def test_ignore_files_as_git_reads_them(spark, tmp_path):
    paths = [*PATHS, "space ", *RULES]
    paths = [p for p in paths if not any(q.startswith(p + "/") for q in paths)]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(RULES.get(p, ""))
    told = subprocess.run(["git", "-c", "core.quotePath=false", "check-ignore", "--no-index", "--stdin", "-z"], cwd=tmp_path, input="\0".join(paths).encode(), capture_output=True).stdout.decode()
    want = {p for p in told.split("\0") if p}
    files = spark.createDataFrame([(p, RULES.get(p, "")) for p in paths], "path string, content string")
    got = {r.path for r in ignores.ignored(files, ignores.rules(files)).collect()}
    assert got == want
    assert {r.path for r in ignores.discovered(files).collect()} == set(paths) - want
    assert {r.path for r in ignores.discovered(files, most_depth=1).collect()} == {p for p in set(paths) - want if "/" not in p}
    assert ignores.discovered(files.limit(0)).count() == 0


def history(rng, commits):
    """A file's versions as lists of commits, and the hunks between them."""
    version, hunks = [], []
    for c in range(commits):
        new, old_at, out = [], 0, []
        for _ in range(rng.randint(1, 3)):
            keep = rng.randint(0, max(0, len(version) - old_at))
            if out and keep == 0:
                continue  # hunks that touch are one
            new += version[old_at : old_at + keep]
            old_at += keep
            gone, come = rng.randint(0, min(3, len(version) - old_at)), rng.randint(0, 4)
            if not gone and not come:
                come = 1
            out.append((c, old_at + (gone > 0), gone, len(new) + (come > 0), come))
            new += [c] * come
            old_at += gone
        version = new + version[old_at:]
        hunks += out
    return version, hunks


def test_blame_is_the_replay(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for path in range(12):
        version, hunks = history(rng, rng.choice([1, 2, 3, 9, 20]))
        want |= {(f"f{path}", k + 1): c for k, c in enumerate(version)}
        rows += [(f"f{path}", 10 * c + 3, c, *h) for c, *h in hunks]
    got = {}
    for r in blame.blame(spark.createDataFrame(rows, "path string, seq int, commit int, old_start int, old_count int, new_start int, new_count int")).collect():
        for k in range(r.start, r.end + 1):
            assert (r.path, k) not in got
            got[r.path, k] = r.commit
    assert got == want


def test_blame_of_patches(spark, tmp_path):
    """Against git's own blame of a small repository."""
    def git(*a):
        return subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True).stdout.decode()

    git("init", "-q")
    rng, lines, patches = random.Random(1), [], []
    for k in range(6):
        for _ in range(3):
            at = rng.randint(0, len(lines))
            lines[at : at + rng.randint(0, 2)] = [f"line {k} {rng.random()}" for _ in range(rng.randint(1, 3))]
        (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
        git("add", "x.txt")
        git("commit", "-qm", str(k))
        patches.append(("x.txt", k, str(k), git("show", "-U0", "--format=", "HEAD")))
    log = {h: s for h, s in (x.split(" ", 1) for x in git("log", "--format=%H %s").splitlines())}
    want = [log[x.split(" ")[0].lstrip("^")] for x in git("blame", "-l", "--root", "x.txt").splitlines()]
    got = {}
    for r in blame.blame(blame.parsed(spark.createDataFrame(patches, "path string, seq int, commit string, text string"))).collect():
        got |= {k: r.commit for k in range(r.start, r.end + 1)}
    assert [got[k + 1] for k in range(len(lines))] == want and len(got) == len(lines)


def commits(spark, rows):
    return spark.createDataFrame(rows, "path string, hash string, author string, ts timestamp, additions long, deletions long")


def test_churn_by_batches_is_churn_from_scratch(spark, tmp_path):
    import datetime as dt

    rng = random.Random(3)
    rows = [(f"p{rng.randint(0, 8)}", f"h{k}", f"a{rng.randint(0, 3)}", dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(0, 900)), rng.randint(0, 9), rng.randint(0, 9)) for k in range(200)]
    store = incremental.ChurnStore(spark, str(tmp_path / "churn"))
    store.add(commits(spark, rows[:80]), 0)
    store.add(commits(spark, rows[60:150]), 1)  # twenty were there before
    store.add(commits(spark, rows[60:150]), 1)  # and the batch comes again
    store.add(commits(spark, rows[140:]), 2)
    columns = facts.churn(commits(spark, rows)).columns
    want = sorted(map(tuple, facts.churn(commits(spark, rows)).select(columns).collect()))
    assert sorted(map(tuple, store.churn().select(columns).collect())) == want
    assert {r.path for r in store.changed(2).collect()} == {r[0] for r in rows[150:]}
    # the same as a stream, one file a batch
    folder = tmp_path / "in"
    for k, part in enumerate((rows[:80], rows[60:150], rows[140:])):
        commits(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
    streamed = incremental.ChurnStore(spark, str(tmp_path / "streamed"))
    stream = spark.readStream.schema(commits(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for _ in range(2):  # nothing new the second time
        incremental.keep(stream, streamed, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, streamed.churn().select(columns).collect())) == want


def test_coverage_by_hash(spark, tmp_path):
    files = lambda rows: spark.createDataFrame(rows, "path string, hash string, covered long, total long")
    store = incremental.CoverageStore(spark, str(tmp_path / "cover"))
    assert tuple(store.coverage().first()) == (0, 0, 0, 0.0)
    store.add(files([("a", "1", 5, 10), ("b", "1", 0, 10)]), 0)
    for _ in range(2):
        store.add(files([("a", "1", 9, 10), ("b", "2", 10, 10), ("c", "1", 1, 5)]), 1)  # a's content is the same: not looked at again
    assert tuple(store.coverage().first()) == (3, 16, 25, 64.0) and tuple(store.coverage(0).first()) == (2, 5, 20, 25.0)
    assert tuple(store.delta(1).first()) == (2, 39.0)
    store.add(files([]), 2)
    assert tuple(store.delta(2).first()) == (0, 0.0)
