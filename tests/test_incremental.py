import random

import pytest
from pyspark.sql import functions as F

from stratograph.operators.incremental import IntervalLedger, changed_files, merge_intervals, subtract_intervals, to_intervals


def covered(rows):
    return {(k, x) for k, lo, hi in rows for x in range(lo, hi + 1)}


def test_intervals_against_sets(spark):
    rng = random.Random(4)
    seqs = [(rng.choice("ab"), rng.randrange(60)) for _ in range(80)] + [("a", None)]
    df = spark.createDataFrame(seqs, "k string, s long")
    got = [tuple(r) for r in to_intervals(df, ["k"], "s").select("k", "lo", "hi").collect()]
    assert covered(got) == {(k, s) for k, s in seqs if s is not None}
    for k, lo, hi in got:  # maximal and disjoint
        assert (k, lo - 1) not in covered(got) and (k, hi + 1) not in covered(got)
    make = lambda n: [(rng.choice("abc"), lo, lo + rng.randrange(9)) for lo in (rng.randrange(80) for _ in range(n))]
    a, p = make(25), make(25)
    A, P = (spark.createDataFrame(x, "k string, lo long, hi long") for x in (a, p))
    assert covered(map(tuple, merge_intervals(A, ["k"]).select("k", "lo", "hi").collect())) == covered(a)
    gaps = [tuple(r) for r in subtract_intervals(A, P, ["k"]).select("k", "lo", "hi").collect()]
    assert covered(gaps) == covered(a) - covered(p)
    assert subtract_intervals(A.limit(0), P, ["k"]).count() == 0
    assert covered(map(tuple, subtract_intervals(A, P.limit(0), ["k"]).select("k", "lo", "hi").collect())) == covered(a)


def brute(states, files):
    runs = {r: (w, t, s) for r, w, t, s in states}
    out = set()
    for run, path, sha in files:
        if run not in runs:
            continue
        w, t, _ = runs[run]
        base = max(((x[1], r) for r, x in runs.items() if x[0] == w and x[2] == "ok" and (x[1], r) < (t, run)), default=None)
        known = {(p, (s or "").lower()) for r, p, s in files if base and r == base[1]}
        if (path, (sha or "").lower()) not in known:
            out.add((run, path, "modified" if any(p == path for p, _ in known) else "added"))
    return out


def test_changed_files_against_brute_force(spark):
    rng = random.Random(7)
    states = [(r, rng.choice("uv"), rng.randrange(100), rng.choice(["ok", "ok", "failed", "crashed"])) for r in range(40)]
    files = [(r, f"p{p}", rng.choice(["aa", "AA", "bb", "cc", None])) for r in range(42) for p in range(6) if rng.random() < 0.7]
    S = spark.createDataFrame(states + states[:5], "run_id long, workspace string, started_at int, status string")
    Fs = spark.createDataFrame(files + files[:9] + [(1, None, "aa"), (None, "p1", "aa")], "run_id long, path string, sha string")
    got = {tuple(r) for r in changed_files(S, Fs).collect()}
    assert got == brute(states, files)
    assert changed_files(S.limit(0), Fs).count() == 0 and changed_files(S, Fs.limit(0)).count() == 0


def test_ledger_neither_skips_nor_repeats(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger", ["k"], "seq")
    schema = "k string, seq long, v string"
    source = [("a", i, f"a{i}") for i in (1, 2, 3, 7)]
    ledger.run(spark.createDataFrame(source, schema), lambda df: df)
    source += [("a", 5, "late"), ("a", 8, "a8"), ("b", 1, "b1")]
    df = spark.createDataFrame(source, schema)
    assert {r["v"] for r in ledger.pending(df).collect()} == {"late", "a8", "b1"}

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(df, fails)
    assert len(ledger.commits()) == 1 and ledger.output().count() == 4  # nothing of the failed run is seen
    ledger.run(df, lambda x: x)
    assert sorted(r["v"] for r in ledger.output().collect()) == sorted(v for _, _, v in source)
    assert ledger.pending(df).count() == 0
    assert covered(map(tuple, ledger.processed().select("k", "lo", "hi").collect())) == {(k, s) for k, s, _ in source}
    assert ledger.run(df, lambda x: x) == 3 and ledger.output().agg(F.count("*")).first()[0] == len(source)


def test_ledger_without_keys_late_numbers_and_compaction(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger", [], "seq", segment=10)
    ledger.COMPACT = 2
    seen, rng = [], random.Random(3)
    order = list(range(95))
    rng.shuffle(order)
    for step in range(5):
        seen += order[step * 19:(step + 1) * 19]
        if step == 3:
            ledger.BROADCAST_GAPS = 0  # many gaps: rows are joined by number
        df = spark.createDataFrame([(x, f"v{x}") for x in seen] + [(seen[0], f"v{seen[0]}")], "seq long, v string")
        ledger.run(df, lambda x: x.select("seq", "v"))
        assert len(ledger.last()["ranges"]) <= 2 and ledger.pending(df).count() == 0
    out = [r["seq"] for r in ledger.output().collect()]
    assert sorted(set(out)) == sorted(seen) and len(out) == len(seen) + 1  # the row that came twice in the first run
    assert [tuple(r) for r in ledger.processed().select("lo", "hi").collect()] == [(0, 94)]
    (tmp_path / "ledger" / "data" / "lost").mkdir()
    assert ledger.vacuum(0) >= 1 and not (tmp_path / "ledger" / "data" / "lost").exists() and sorted(r["seq"] for r in ledger.output().collect()) == sorted(out)
