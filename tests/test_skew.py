from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stratograph.operators.domains import domain_counts, domain_profile, heavy_domains
from stratograph.operators.references import live_nodes, missing_keys, orphan_counts, orphan_references, reference_counts, referring_records
from stratograph.operators.skew import heavy_keys, salted_aggregate, skew_join, with_salt

MODULES = "id string, path string, domain string, loc int"


def skewed(spark, n=3000):
    # a third of all rows under one key, nulls, ties, and an extra column named like an internal one
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{i % 200}"), i % 7, "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "i int, k string, v int, count string")


def test_salted_aggregate_is_plain_aggregate(spark):
    rows, df = skewed(spark)
    got = {r["k"]: (r["n"], r["s"], r["lo"], r["hi"]) for r in salted_aggregate(df, ["k"], [("n", "count", F.col("i")), ("s", "sum", F.col("v")), ("lo", "min", F.col("i")), ("hi", "max", F.col("i"))], ["i"]).collect()}
    want = defaultdict(list)
    for i, k, v, _ in rows:
        want[k].append((i, v))
    assert got == {k: (len(x), sum(v for _, v in x), min(i for i, _ in x), max(i for i, _ in x)) for k, x in want.items()}


def test_heavy_keys_are_few_and_salts_spread(spark):
    rows, df = skewed(spark)
    heavy = heavy_keys(df, ["k"], 0.05)
    assert {r["k"] for r in heavy.collect()} == {"hot"}
    salts = Counter(r["_salt"] for r in with_salt(df, ["k"], ["i"], 16, 0.05).filter("k = 'hot'").collect())
    assert len(salts) == 16 and max(salts.values()) < 3 * min(salts.values())
    assert with_salt(df, ["k"], ["i"], 16, 0.05).filter("k <> 'hot' AND _salt <> 0").count() == 0


def test_skew_join_is_plain_join(spark):
    rows, df = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = sorted(map(str, skew_join(df, right, ["k"], how, ["i"]).select("i", "k").collect()))
        assert got == sorted(map(str, df.join(right, "k", how).select("i", "k").collect())), how


def test_empty_tables(spark):
    empty = spark.createDataFrame([], MODULES)
    assert domain_counts(empty).count() == 0 and heavy_domains(empty).count() == 0
    assert salted_aggregate(empty, ["domain"], [("n", "count", F.col("id"))], ["id"]).count() == 0


def test_domains_count_modules_once(spark):
    rows = [(f"m{i}", f"src/{'a' if i % 3 else 'b'}/w/{i}.py", "a" if i % 3 else "b", i) for i in range(60)] + [("n", None, None, None)] * 3 + [(None, "p", "a", 1)]
    df = spark.createDataFrame(rows + rows, MODULES)
    assert {r["domain"]: r["modules"] for r in domain_counts(df).collect()} == {"a": 40, "b": 20, None: 1}
    assert {r["domain"] for r in heavy_domains(df, 0.5).collect()} == {"a"}
    symbols = spark.createDataFrame([("s1", "src/a/w/1.py"), ("s1", "src/a/w/1.py"), ("s2", "src/b/w/0.py"), (None, None)], "id string, file_path string")
    calls = spark.createDataFrame([("symbol:src/a/w/1.py:f", "g"), ("symbol:src/a/w/1.py:f", "g"), ("symbol:src/b/w/0.py:f", "g")], "caller_id string, called_name string")
    documents = spark.createDataFrame([(1, "w"), (2, "w"), (3, None)], "doc_id long, workspace string")
    got = {r["domain"]: tuple(r)[1:] for r in domain_profile(df, symbols, calls, documents).collect()}
    assert got["a"] == (40, sum(i for i in range(60) if i % 3), 1, 1, 2) and got["b"][2:] == (1, 1, 2) and got[None] == (1, 0, 0, 0, 0)


def test_orphans(spark):
    at = "timestamp_ntz'2025-03-04 00:00:00'"
    symbols = spark.sql(f"""SELECT * FROM VALUES
      ('s:a', 'A.run', 'c:a', array('go', 'run'), {at}), ('s:a', 'A.run', 'c:a', array('go', 'run'), timestamp_ntz'2025-05-01 00:00:00'),
      ('s:b', 'go', 'gone', array('dead', 'gone', ''), {at}), ('s:c', 'dead', '', cast(null as array<string>), {at}), ('s:d', 'x', null, array('go'), null) AS t(id, name, parent_id, calls, synced_at)""")
    routes = spark.sql(f"SELECT * FROM VALUES ('r:1', 's:a', {at}), ('r:2', 's:zz', {at}), ('r:3', null, {at}), ('r:2', 's:zz', {at}) AS t(id, handler_id, synced_at)")
    modules, classes = spark.createDataFrame([("m",)], "id string"), spark.createDataFrame([("c:a",), (None,)], "id string")
    journal = spark.createDataFrame([(1, "s:c", "upsert"), (5, "s:c", "delete"), (2, "s:a", "delete"), (9, "s:a", "upsert"), (5, "s:c", "delete"), (7, None, "delete")], "seq long, node_id string, op string")
    live = live_nodes(modules, classes, symbols, journal)
    assert {r["id"] for r in live.collect()} == {"m", "c:a", "s:a", "s:b", "s:d"}
    want = {("symbol_nodes", "s:b", "parent_id", "gone", "2025-03"), ("symbol_nodes", "s:b", "calls", "dead", "2025-03"), ("symbol_nodes", "s:b", "calls", "gone", "2025-03"), ("route_endpoints", "r:2", "handler_id", "s:zz", "2025-03")}
    records = referring_records(symbols, routes)
    counts = reference_counts(records)
    for share in (0.001, 0.3, 1.1):  # all keys hot, some, none: the same rows
        for bound in (100, 0):  # missing keys broadcast, or hot ones only
            missing = missing_keys(counts, live, share)
            assert sorted(map(tuple, orphan_references(records, missing, bound).collect())) == sorted(want)
    told = {(r["src_table"], r["ref_field"]): (r["orphan_refs"], r["missing_keys"]) for r in orphan_counts(counts, missing).collect()}
    assert told == {("symbol_nodes", "parent_id"): (1, 1), ("symbol_nodes", "calls"): (2, 2), ("route_endpoints", "handler_id"): (1, 1)}
    none = referring_records(symbols.limit(0), routes.limit(0))
    assert orphan_references(none, missing_keys(reference_counts(none), live_nodes(modules, classes, symbols.limit(0), journal.limit(0)))).count() == 0
