"""References whose target is not in the graph.

References are first counted per key and period. Which keys have no target is decided on these counts, a row per key: heavy keys by a
broadcast check, the rest by a shuffled anti-join. Counts of orphans come from the counts; the references themselves are only
gone through once more where the rows are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratograph.operators.skew import SHARE, heavy_keys
from stratograph.session import cut

FIELDS = ("src_table", "record_id", "ref_field", "ref_key", "period")
#: Missing keys up to which they are broadcast to the references; they are counted first, and beyond it they are shuffled.
BROADCAST_KEYS = 100_000


def live_nodes(modules: DataFrame, classes: DataFrame, symbols: DataFrame, journal: DataFrame) -> DataFrame:
    """(id, name): nodes with a row in one of the three tables whose journal entry of highest seq, if any, is no delete.

    ``name`` is the short name of symbols (after the last dot) and null for other nodes. Entries with
    a null seq lose to any other. Rows of duplicates and versions of a node are all here: what follows asks only whether there is one.
    """
    short = F.element_at(F.split("name", r"\."), -1)
    nodes = (modules.select("id", F.lit(None).cast("string").alias("name"))
             .unionByName(classes.select("id", F.lit(None).cast("string").alias("name")))
             .unionByName(symbols.select("id", F.when(F.length("name") > 0, short).alias("name")))
             .filter("id IS NOT NULL"))
    dead = (journal.filter("node_id IS NOT NULL").groupBy("node_id").agg(F.max_by("op", F.coalesce("seq", F.lit(-(2**62)))).alias("op"))
            .filter("op = 'delete'").select(F.col("node_id").alias("id")))
    return nodes.join(dead, "id", "left_anti")


def referring_records(symbols: DataFrame, routes: DataFrame) -> DataFrame:
    """(src_table, record_id, period, refs): one row per record with its references as (ref_field, ref_key), each once.

    Versions and duplicates of a record are one record: of symbols the newest version counts, of routes the
    handlers of all. Null and empty references are none, records without id are left out; a record whose every synced_at is null
    has a null period.
    """
    month = lambda c: F.date_format(c, "yyyy-MM")
    ref = lambda field, key: F.struct(F.lit(field).alias("ref_field"), key.alias("ref_key"))
    real = lambda refs: F.filter(refs, lambda r: r["ref_key"] != "")
    # the newest version, combined before the shuffle; of versions of one time the largest stands
    sym = symbols.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("synced_at", "parent_id", "calls")).alias("v")).select("id", "v.*")
    calls = F.transform(F.array_distinct(F.coalesce("calls", F.array().cast("array<string>"))), lambda c: ref("calls", c))
    from_symbols = sym.select(F.lit("symbol_nodes").alias("src_table"), F.col("id").alias("record_id"), month("synced_at").alias("period"), real(F.concat(F.array(ref("parent_id", F.col("parent_id"))), calls)).alias("refs"))
    r = routes.filter("id IS NOT NULL").groupBy("id").agg(F.max("synced_at").alias("at"), F.collect_set("handler_id").alias("h"))  # the handlers of one route
    from_routes = r.select(F.lit("route_endpoints").alias("src_table"), F.col("id").alias("record_id"), month("at").alias("period"), real(F.transform("h", lambda c: ref("handler_id", c))).alias("refs"))
    return from_symbols.unionByName(from_routes).filter("size(refs) > 0")


def references(records: DataFrame) -> DataFrame:
    """One row per (src_table, record_id, ref_field, ref_key) with the period of the record."""
    return records.select("src_table", "record_id", "period", F.explode("refs").alias("r")).select("src_table", "record_id", "r.ref_field", "r.ref_key", "period")


def _kind() -> Column:
    return F.when(F.col("ref_field") == "calls", F.lit("name")).otherwise(F.lit("id"))


def reference_counts(records: DataFrame) -> DataFrame:
    """(src_table, ref_field, ref_key, period, refs): references per key and period, combined before they are shuffled."""
    return references(records).groupBy("src_table", "ref_field", "ref_key", "period").agg(F.count("*").alias("refs"))


def missing_keys(counts: DataFrame, live: DataFrame, share: float = SHARE) -> DataFrame:
    """(ref_kind, ref_key, heavy): keys without a target among ``live``: names for ``calls``, ids for the other fields.

    Keys are split by the references they hold: those with at least ``share`` of all (at most ``1 / share`` of them) are broadcast
    to the targets, all others, one row each, go through a shuffled anti-join. Both parts together are the result.
    """
    key = ["ref_kind", "ref_key"]
    keyed = counts.select(_kind().alias("ref_kind"), "ref_key", "refs")
    heavy = cut(heavy_keys(keyed, key, share, F.col("refs")).select(*key))
    named = live.filter("name IS NOT NULL").select(F.lit("name").alias("ref_kind"), F.col("name").alias("ref_key")).distinct()  # combined before the shuffle
    targets = live.select(F.lit("id").alias("ref_kind"), F.col("id").alias("ref_key")).unionByName(named)
    found = targets.join(F.broadcast(heavy), key, "left_semi").distinct()  # at most 1/share keys on either side
    lost = heavy.join(F.broadcast(found), key, "left_anti").withColumn("heavy", F.lit(True))
    rest = keyed.select(*key).distinct().join(F.broadcast(heavy), key, "left_anti")
    return lost.unionByName(rest.join(targets, key, "left_anti").withColumn("heavy", F.lit(False)))


def orphan_references(records: DataFrame, missing: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The references whose key is among ``missing``, one row each.

    Up to ``broadcast_keys`` missing keys, which are counted first, are broadcast, and references do not move. Beyond, only the heavy
    ones are; references to the others are shuffled by their key.
    """
    refs, key = references(records).withColumn("ref_kind", _kind()), ["ref_kind", "ref_key"]
    if missing.limit(broadcast_keys + 1).count() <= broadcast_keys:
        return refs.join(F.broadcast(missing.select(*key)), key, "left_semi").select(*FIELDS)
    hot = missing.filter("heavy").select(*key)
    cold = missing.filter("NOT heavy").select(*key)
    return (refs.join(F.broadcast(hot), key, "left_semi").unionByName(  # at most 1/share keys
        refs.join(F.broadcast(hot), key, "left_anti").join(cold, key, "left_semi"))).select(*FIELDS)


def orphan_counts(counts: DataFrame, missing: DataFrame) -> DataFrame:
    """Per table, field and period: orphan references and distinct missing keys. A key is one row here, however many refer to it."""
    lost = counts.withColumn("ref_kind", _kind()).join(missing.select("ref_kind", "ref_key"), ["ref_kind", "ref_key"], "left_semi")
    return lost.groupBy("src_table", "ref_field", "period").agg(F.sum("refs").alias("orphan_refs"), F.count("*").alias("missing_keys"))
