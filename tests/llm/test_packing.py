import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from stratograph.llm import mixing, packing, tokens

SIZES = "doc_id long, source string, tokens long, loss_tokens long"
SPECS = "spec_id int, capacity_tokens int, source string"


def test_pack_never_overflows_and_wastes_little():
    rng = random.Random(3)
    size = np.array([min(512, int(rng.paretovariate(1.1) * 12)) for _ in range(1500)])
    loss = np.array([min(400, rng.randrange(s + 1)) for s in size])
    bins = packing.pack(size, loss, 512, 128, 400)
    assert sorted(i for b in bins for i in b) == list(range(1500))
    assert all(size[b].sum() <= 512 and loss[b].sum() <= 400 and len(b) <= 128 for b in bins)
    assert len(bins) <= 1.05 * max(size.sum() / 512, loss.sum() / 400) + 1
    assert any(loss[b].sum() >= 390 for b in bins)
    tight = packing.pack(size, loss, 512, 6, 400)
    assert max(map(len, tight)) == 6 and len(tight) > len(bins)
    assert sorted(map(sorted, packing.pack(np.array([9, 5, 5, 1]), np.array([9, 5, 0, 0]), 10, 4, 6))) == [[0, 3], [1, 2]]  # 9 loss-bearing tokens are all of a container's share
    assert packing.pack(np.array([], dtype=int), np.array([], dtype=int), 8, 2, 8) == [] and len(packing.pack(np.zeros(5, dtype=int), np.zeros(5, dtype=int), 8, 2, 8)) == 3


def test_containers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["wiki", "wiki", "issue", None]), n := min(5000, int(rng.paretovariate(1) * 40)), n // 2) for i in range(900)] + [(900, "wiki", 0, 0), (901, "wiki", 12345, 12000), (902, "issue", 512, 512)]
    sizes = spark.createDataFrame(rows, SIZES)
    specs = spark.createDataFrame([(1, 512, None), (2, 1024, " Wiki"), (3, 0, None), (4, 64, "absent"), (None, 5, None), (1, 512, None)], SPECS)
    placed = packing.fill_containers(sizes, specs, cell=100).collect()
    for spec, cap, want in ((1, 512, rows), (2, 1024, [r for r in rows if r[1] == "wiki"])):
        mine = [r for r in placed if r["spec_id"] == spec]
        used, texts, places = defaultdict(int), defaultdict(list), defaultdict(list)
        for r in mine:
            used[r["container_id"]] += r["token_end"] - r["token_start"]
            texts[r["doc_id"]].append((r["token_start"], r["token_end"]))
            places[r["container_id"]].append(r["position"])
        assert max(used.values()) <= cap and all(sorted(p) == list(range(len(p))) for p in places.values())
        for doc, _, n, _ in want:  # every token once, cut only where it must be
            spans = sorted(texts[doc])
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len(spans) == max(1, -(-n // cap))
        assert sum(used.values()) / (len(used) * cap) > 0.93
    assert {r["spec_id"] for r in placed} == {1, 2}
    report = {r["spec_id"]: r for r in packing.fill_report(packing.fill_containers(sizes, specs, cell=100), specs).collect()}
    assert report[1]["at_loss"] > 0 and report[1]["most_segments"] <= report[1]["segment_limit"] and report[1]["most_loss"] <= report[1]["loss_limit"]
    assert report[1]["containers"] >= report[1]["least_containers"] and report[1]["fullest"] <= 512
    few = packing.fill_report(packing.fill_containers(sizes, specs, cell=100, segment_slack=1.2), specs, segment_slack=1.2).filter("spec_id = 1").first()
    assert few["at_segments"] > 0 and few["most_segments"] <= few["segment_limit"] < report[1]["most_segments"]
    assert packing.fill_containers(sizes.limit(0), specs).count() == 0 and packing.fill_containers(sizes, specs.limit(0)).count() == 0


def test_token_sizes(spark):
    code = "Look:\n```\nx = 1\ny = 2\n```\nDone."
    docs = spark.createDataFrame([(1, " Wiki ", "hello world", "x"), (1, " Wiki ", "hello world", "x"), (2, None, None, "x"), (3, "a", "", "x"), (4, "a", code, "x"), (None, "a", "b", "x"), (5, "a", "b" * 20000 + "<|endoftext|>", "x")], "doc_id long, source string, text string, tokens string")
    got = {r["doc_id"]: (r["source"], r["tokens"], r["loss_tokens"]) for r in tokens.token_sizes(docs).collect()}
    assert got[1] == ("wiki", 2, 2) and got[2] == (None, 0, 0) and got[3] == ("a", 0, 0) and 0 < got[4][2] < got[4][1] and got[5][1] > 1000 and len(got) == 5
    assert tokens.encoder(tokens.VOCABULARY)[0].decode(tokens.encode(code * 30)) == code * 30


def test_mixing_reaches_shares_within_caps(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a"] * 12 + ["b"] * 4 + ["c"]), min(3000, int(rng.paretovariate(1) * 20)), 0) for i in range(4000)] + [(5000, None, 50, 0), (5001, "a", 0, 0)]
    sizes = spark.createDataFrame(rows, SIZES)
    targets = spark.createDataFrame([(1, "A ", 2.0, None), (1, "b", 1.0, 3), (1, "c", 1.0, 2), (2, "c", 5.0, None), (2, "gone", 5.0, 1), (3, "gone", 1.0, 1), (4, "b", 0.0, 1), (5, "a", 0.9, 1), (5, "c", 0.1, None)], "mix_id int, source string, weight double, max_repeats int")
    mixed = mixing.mix_sources(sizes, targets)
    picked = mixed.collect()
    cap = {(1, "b"): 3, (1, "c"): 2, (5, "a"): 1}
    total, per = defaultdict(int), defaultdict(int)
    for r in picked:
        assert r["repeats"] <= cap.get((r["mix_id"], r["source"]), 10**9) and r["tokens"] > 0
        total[r["mix_id"]] += r["tokens"] * r["repeats"]
        per[r["mix_id"], r["source"]] += r["tokens"] * r["repeats"]
    assert len({(r["mix_id"], r["doc_id"]) for r in picked}) == len(picked)
    for (mix, source), want in {(1, "a"): 0.5, (1, "b"): 0.25, (1, "c"): 0.25, (2, "c"): 1.0, (5, "a"): 0.9, (5, "c"): 0.1}.items():
        assert abs(per[mix, source] / total[mix] - want) < 0.004, (mix, source, per[mix, source] / total[mix])
    assert set(total) == {1, 2, 5}
    report = {(r["mix_id"], r["source"]): r for r in mixing.mix_report(mixed, targets).collect()}
    assert report[2, "gone"]["reached_share"] == 0 and report[2, "c"]["target_share"] == 1.0 and report[3, "gone"]["tokens"] == 0
    assert mixing.mix_sources(sizes.limit(0), targets).count() == 0 and mixing.mix_sources(sizes, targets.limit(0)).count() == 0


def test_mixing_solves_the_dual(spark):
    """Tilts against a plain solver of the primal's optimality conditions (bisection on each source), to 1e-6; both signs occur."""
    rng = random.Random(3)
    rows = [(i, "ab"[i % 3 == 0], min(3000, int(rng.paretovariate(1) * 20)), 0) for i in range(600)] + [(1000 + i, "c", 7, 0) for i in range(9)]
    plan, _ = mixing.plan_mix(spark.createDataFrame(rows, SIZES), spark.createDataFrame([(1, "a", 1.0, None), (1, "b", 4.0, 5), (2, "a", 8.0, 2), (2, "b", 1.0, 1), (3, "c", 1.0, 1), (4, "a", 1.0, None), (4, "c", 3.0, None)], "mix_id int, source string, weight double, max_repeats int"))
    signs = set()
    for mix, source, tilt, scale, cap, share, budget in plan:
        t = np.array([r[2] for r in rows if r[1] == source], dtype=float)
        tokens = lambda x: (t * np.exp(np.minimum(math.log(cap), x * t / scale))).sum()  # noqa: E731, B023
        if share * budget >= cap * t.sum() * (1 - 1e-9):
            assert tilt == mixing.SATURATED
            continue
        low, high = -1e6, 1e6
        for _ in range(200):
            low, high = ((low + high) / 2, high) if tokens((low + high) / 2) < share * budget else (low, (low + high) / 2)
        assert abs(tilt - low) < 1e-6 * max(1, abs(low)) and abs(tokens(tilt) / (share * budget) - 1) < 1e-8, (mix, source)
        signs.add(tilt > 0)
    assert signs == {True, False} and len(plan) == 7


def test_copies_are_whole_and_close():
    import pandas as pd

    frame = pd.DataFrame({"mix_id": 1, "source": "a", "tokens": [5, 900, 40], "docs": [100, 3, 20], "rate": [0.37, 0.37, 0.37], "cap": [1.0, 1.0, 1.0]})
    out = mixing._whole(frame)
    want = sum(frame["tokens"] * frame["docs"] * 0.37)
    assert abs((out["tokens"] * out["copies"]).sum() - want) < 300 and (out["copies"] <= out["docs"]).all() and F is not None
