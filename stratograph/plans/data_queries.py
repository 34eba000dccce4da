"""Queries for skew, missing references and incremental work, with DuckDB statements for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratograph.operators.domains import domain_profile, heavy_domains
from stratograph.operators.incremental import IntervalLedger, changed_files, pending_files
from stratograph.operators.references import live_nodes, missing_keys, orphan_counts, orphan_references, reference_counts, referring_records
from stratograph.session import cut, shared_dir
from stratograph.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_domains(table(spark, folder, "module_nodes")).select("domain")


def p3_domain_profile(spark: SparkSession, folder: str) -> DataFrame:
    return domain_profile(*(table(spark, folder, t) for t in ("module_nodes", "symbol_nodes", "call_specs", "documents")))


def _missing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, counts, missing): each is read more than once, so each is written once."""
    modules, classes, symbols, journal, routes = (table(spark, folder, t) for t in ("module_nodes", "class_nodes", "symbol_nodes", "node_journal", "route_endpoints"))
    records = cut(referring_records(symbols, routes))
    counts = cut(reference_counts(records))
    return records, counts, cut(missing_keys(counts, live_nodes(modules, classes, symbols, journal)))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    records, _, missing = _missing(spark, folder)
    return orphan_references(records, missing)


def p4_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    _, counts, missing = _missing(spark, folder)
    return orphan_counts(counts, missing)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pending_files(table(spark, folder, "cache_states"), table(spark, folder, "cache_files")).select("run_id", "path")


def p5_changes_per_run(spark: SparkSession, folder: str) -> DataFrame:
    changes = changed_files(table(spark, folder, "cache_states"), table(spark, folder, "cache_files"))
    return changes.groupBy("run_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "modified").alias("modified"))


def p5_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The journal processed by four runs of the ledger, one of which fails: what its commits hold, with the commit each entry came by.

    The first run sees the older half of the entries, the second sees two thirds, but dies; the third sees these as well, and
    with them entries whose numbers lie between those of the first run; the last sees all.
    """
    journal = table(spark, folder, "node_journal").filter("seq IS NOT NULL").groupBy("seq").agg(F.min("node_id").alias("node_id"), F.min("op").alias("op"), F.min("recorded_at").alias("recorded_at"))
    ledger = IntervalLedger(spark, f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}", [], "seq")
    part = F.pmod(F.xxhash64("seq"), F.lit(6))  # in what order entries arrive is made up; every entry arrives

    def dies(df: DataFrame) -> DataFrame:
        raise RuntimeError("the run is lost")

    for seen, work in ((3, lambda df: df), (4, dies), (4, lambda df: df), (6, lambda df: df)):
        try:
            ledger.run(journal.filter(part < seen), work)
        except RuntimeError:
            pass
    return ledger.output().select("seq", "node_id", "op")


_LIVE = """
  entries AS (SELECT node_id, arg_max(op, seq) AS op FROM node_journal WHERE node_id IS NOT NULL GROUP BY node_id),
  nodes AS (SELECT id, NULL AS name FROM module_nodes UNION SELECT id, NULL FROM class_nodes
            UNION SELECT id, string_split(name, '.')[-1] FROM symbol_nodes),
  live AS (SELECT * FROM nodes WHERE id IS NOT NULL AND id NOT IN (SELECT node_id FROM entries WHERE op = 'delete')),
  at_symbol AS (SELECT id, max(synced_at) AS seen, arg_max(parent_id, synced_at) AS parent_id, arg_max(calls, synced_at) AS calls FROM symbol_nodes GROUP BY id),
  at_route AS (SELECT id, max(synced_at) AS seen FROM route_endpoints GROUP BY id),
  refs AS (
    SELECT DISTINCT 'symbol_nodes' AS src_table, id AS record_id, 'calls' AS ref_field, k AS ref_key, strftime(seen, '%Y-%m') AS period
      FROM (SELECT id, seen, unnest(calls) AS k FROM at_symbol)
    UNION SELECT 'symbol_nodes', id, 'parent_id', parent_id, strftime(seen, '%Y-%m') FROM at_symbol
    UNION SELECT 'route_endpoints', r.id, 'handler_id', r.handler_id, strftime(a.seen, '%Y-%m') FROM route_endpoints r JOIN at_route a ON a.id = r.id),
  orphans AS (SELECT * FROM refs WHERE ref_key IS NOT NULL AND ref_key <> ''
    AND ((ref_field = 'calls' AND ref_key NOT IN (SELECT name FROM live WHERE name IS NOT NULL))
      OR (ref_field <> 'calls' AND ref_key NOT IN (SELECT id FROM live))))
"""

_CHANGES = """
  runs AS (SELECT run_id, any_value(workspace) AS workspace, any_value(started_at) AS started_at, any_value(status) AS status FROM cache_states GROUP BY run_id),
  based AS (SELECT run_id, (SELECT arg_max(p.run_id, (p.started_at, p.run_id)) FROM runs p WHERE p.workspace = r.workspace AND p.status = 'ok'
                              AND (p.started_at, p.run_id) < (r.started_at, r.run_id)) AS base FROM runs r),
  listed AS (SELECT DISTINCT run_id, path, lower(sha) AS sha FROM cache_files),
  changes AS (SELECT DISTINCT l.run_id, l.path, EXISTS (SELECT 1 FROM listed o WHERE o.run_id = b.base AND o.path = l.path) AS known
    FROM listed l JOIN based b ON b.run_id = l.run_id
    WHERE NOT EXISTS (SELECT 1 FROM listed o WHERE o.run_id = b.base AND o.path = l.path AND o.sha IS NOT DISTINCT FROM l.sha))
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_domain_profile, p4_found, p4_orphan_counts, p5_found, p5_changes_per_run, p5_ledger)}

ORACLES = {
    "p3_found": """
WITH m AS (SELECT id, max(domain) AS domain FROM module_nodes WHERE id IS NOT NULL GROUP BY id)
SELECT domain FROM m WHERE domain IS NOT NULL GROUP BY domain HAVING count(*) >= 0.05 * (SELECT count(*) FROM m)""",
    "p3_domain_profile": """
WITH m AS (SELECT id, max(path) AS path, max(domain) AS domain, max(loc) AS loc FROM module_nodes WHERE id IS NOT NULL GROUP BY id),
 s AS (SELECT file_path, count(DISTINCT id) AS n FROM symbol_nodes GROUP BY file_path),
 c AS (SELECT regexp_extract(caller_id, '^symbol:(.*):[^:]*$', 1) AS file_path, count(*) AS n FROM (SELECT DISTINCT caller_id, called_name FROM call_specs) GROUP BY 1),
 w AS (SELECT workspace, count(DISTINCT doc_id) AS n FROM documents WHERE workspace IS NOT NULL GROUP BY 1),
 d AS (SELECT domain, sum(n) AS n FROM (SELECT DISTINCT domain, string_split(path, '/')[3] AS workspace FROM m) JOIN w USING (workspace) GROUP BY 1)
SELECT g.domain, g.modules, g.loc, g.symbols, g.calls, CAST(coalesce(d.n, 0) AS BIGINT) AS documents FROM
 (SELECT m.domain, count(*) AS modules, CAST(coalesce(sum(loc), 0) AS BIGINT) AS loc, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS symbols, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS calls
  FROM m LEFT JOIN s ON s.file_path = m.path LEFT JOIN c ON c.file_path = m.path GROUP BY m.domain) g
 LEFT JOIN d ON d.domain IS NOT DISTINCT FROM g.domain""",
    "p4_found": f"WITH {_LIVE} SELECT src_table, record_id, ref_field, ref_key, period FROM orphans",
    "p4_orphan_counts": f"WITH {_LIVE} SELECT src_table, ref_field, period, count(*) AS orphan_refs, count(DISTINCT ref_key) AS missing_keys FROM orphans GROUP BY ALL",
    "p5_found": f"WITH {_CHANGES} SELECT DISTINCT run_id, path FROM changes",
    "p5_ledger": "SELECT seq, min(node_id) AS node_id, min(op) AS op FROM node_journal WHERE seq IS NOT NULL GROUP BY seq",
    "p5_changes_per_run": f"WITH {_CHANGES} SELECT run_id, count(*) FILTER (NOT known) AS added, count(*) FILTER (known) AS modified FROM changes GROUP BY run_id",
}
