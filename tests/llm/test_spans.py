import random

import pytest
from pyspark.sql import functions as F

from stratograph.llm import spans


def brute(texts, n):
    grams = {}
    for i, t in texts.items():
        for p in range(len(t) - n + 1):
            grams.setdefault(t[p:p + n], set()).add(i)
    pairs = {(a, b) for s in grams.values() for a in s for b in s if a < b}
    shared = {}
    for i, t in texts.items():
        mark, again = bytearray(len(t)), bytearray(len(t))
        for p in range(len(t) - n + 1):
            s = grams[t[p:p + n]]
            if len(s) > 1:
                mark[p:p + n] = b"\1" * n
                if min(s) < i:
                    again[p:p + n] = b"\1" * n
        shared[i] = (sum(mark), sum(again))
    return pairs, shared


def make(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    line = lambda long: " ".join(word() for _ in range(rng.randrange(1, 90 if long else 9)))
    pool = ["\n".join(line(rng.random() < 0.15) for _ in range(30)) for _ in range(6)]
    texts = {}
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(pool)
            a = rng.randrange(len(t))
            parts += [line(False), t[a:a + rng.randrange(150, 420)], line(rng.random() < 0.3)]
        texts[f"r{i:02}"] = "\n".join(parts) if rng.random() < 0.5 else "".join(parts)
    texts["r90"], texts["r91"], texts["r92"] = texts["r05"], texts["r05"], "short"
    texts["r93"] = "é🙂" * 150 + "\n" + "x" * 250
    texts["r94"] = "q" + "é🙂" * 150 + "x" * 250
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    texts = make(seed)
    pairs, shared = brute(texts, spans.LENGTH)
    if seed == 2:  # numbers of classes that clash
        monkeypatch.setattr(spans, "_number", lambda text: F.char_length(text) % 7)
    if seed == 3:  # every unit hot, every set too large to broadcast: the other ways give the same
        monkeypatch.setattr(spans, "BROADCAST_ROWS", 0)
    rows = [(i, t, "x") for i, t in texts.items()] * 2 + [(None, texts["r01"], "x"), ("r99", None, "x"), ("r98", "", "x")]
    df = spark.createDataFrame(rows, "id string, text string, digest string")
    found = spans.sharing(df, hot_rows=1 if seed == 3 else spans.HOT_ROWS)
    assert {(r["id_a"], r["id_b"]) for r in spans.sharing_pairs(found).collect()} == pairs and len(pairs) > 20
    told = {r["id"]: r for r in spans.shared_share(df, found).collect()}
    assert {i: (told[i]["shared_chars"], told[i]["removable_chars"]) for i in texts} == shared
    assert told["r99"]["chars"] is None and told["r98"]["shared_chars"] == 0
    classes = {r["id"]: r for r in spans.sharing_classes(df, found).collect()}
    first = {t: min(i for i in texts if texts[i] == t) for t in texts.values()}
    for i, t in texts.items():
        if len(t) >= spans.LENGTH:
            others = {first[texts[b if a == i else a]] for a, b in pairs if i in (a, b)} - {first[t]}
            assert (classes[i]["class_id"], classes[i]["copies"], classes[i]["links"]) == (first[t], sum(x == t for x in texts.values()), len(others))
    assert classes["r99"]["class_id"] is None and classes["r92"]["links"] == 0 and len(classes) == len(texts) + 2
    assert spans.sharing_pairs(spans.sharing(df.limit(0))).count() == 0


@pytest.mark.parametrize("few", [0, spans.BROADCAST_ROWS])
def test_hot_and_cold_windows_mixed(spark, few, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_ROWS", few)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, tail, head = word(100), "\n" + word(260), word(240)
    texts = {f"t{i:02}": f"{word(50)}\n{line}\n{word(120)}" for i in range(30)}  # a hot unit, no hot window
    texts |= {f"u{i:02}": f"{head}\n{word(90)}" for i in range(30)}  # hot windows
    texts |= {"a": f"{word(40)}\n{line}{tail}", "b": f"{word(40)}\nexport {line}{tail}", "c": f"{word(30)}\nlet {head}", "d": f"x{head}{tail}"}
    pairs, shared = brute(texts, spans.LENGTH)
    found = spans.sharing(spark.createDataFrame(list(texts.items()), "id string, text string"), hot_rows=20)
    assert found.hot.count() >= 20 and ("a", "b") in pairs
    assert {(r["id_a"], r["id_b"]) for r in spans.sharing_pairs(found).collect()} == pairs
    assert {r["id"]: (r["shared_chars"], r["removable_chars"]) for r in spans.shared_share(spark.createDataFrame(list(texts.items()), "id string, text string"), found).collect()} == shared


def test_pair_is_not_lost_between_hot_and_cold_units(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, tail = word(100), word(320)
    rows = [(f"t{i:04}", f"{word(50)}\n{line}\n{word(60)}") for i in range(1200)]
    rows += [("a", f"{word(40)}\n{line}\n{tail}"), ("b", f"{word(40)}\nexport {line}\n{tail}")]
    found = spans.sharing(spark.createDataFrame(rows, "id string, text string"), hot_rows=1000)
    assert [tuple(r) for r in spans.sharing_pairs(found).collect()] == [("a", "b")]


def test_units_cover_every_span():
    rng = random.Random(5)
    for _ in range(60):
        s = "".join(rng.choice("ab \n" if rng.random() < 0.02 else "abcdefg ") for _ in range(spans.LENGTH))
        a, b = "".join(rng.choice("xyz\n") for _ in range(rng.randrange(300))) + s + "tail", "".join(rng.choice("uvw") for _ in range(rng.randrange(300))) + s + "\nend"
        units = lambda t: {t[p:p + spans.UNIT] for p in spans.unit_starts(t) if p + spans.UNIT <= len(t)}
        assert units(a) & units(b)
