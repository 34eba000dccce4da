"""Per-domain results over modules and what hangs on them, without one task per large domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratograph.operators.skew import SALTS, SHARE, salted_aggregate

HEAVY_DOMAIN_SHARE = 0.05


def _modules(modules: DataFrame) -> DataFrame:
    """One row per module id. Duplicate rows count once; where they differ the largest values win."""
    return modules.filter("id IS NOT NULL").groupBy("id").agg(
        F.max("path").alias("path"), F.max("domain").alias("domain"), F.max("loc").alias("loc"))


def domain_counts(modules: DataFrame, salts: int = SALTS, share: float = SHARE) -> DataFrame:
    """(domain, modules): distinct module ids per domain by two-stage salted aggregation.

    A null domain is a row of its own; modules without id are left out; an empty table gives no rows.
    """
    return salted_aggregate(_modules(modules), ["domain"], [("modules", "count", F.col("id"))], ["id"], salts, share)


def heavy_domains(modules: DataFrame, share: float = HEAVY_DOMAIN_SHARE) -> DataFrame:
    """Non-null domains with at least ``share`` of all distinct module ids (modules of null domain count in the total)."""
    counts = domain_counts(modules)
    total = counts.agg(F.sum("modules").alias("_total"))
    return (counts.join(F.broadcast(total))  # a single row
            .filter(F.col("domain").isNotNull() & (F.col("modules") >= F.col("_total") * F.lit(float(share))))
            .select("domain", "modules", "_total"))


def domain_profile(modules: DataFrame, symbols: DataFrame, calls: DataFrame, documents: DataFrame,
                   salts: int = SALTS, share: float = SHARE) -> DataFrame:
    """Per domain: modules, loc, distinct symbols, distinct calls and documents.

    Symbols and calls are counted per file first (a file belongs to one domain, so no key of those
    shuffles is hot) and joined as one row per path; only then the salted aggregate runs. Documents
    join through the workspace: a domain gets every document of each workspace in which it has a
    module, counted per workspace before the join. Domains of null are reported as one row; rows
    without id, path or workspace take no part in the respective count.
    """
    mods = _modules(modules)
    sym = symbols.select("id", "file_path").filter("id IS NOT NULL AND file_path IS NOT NULL").distinct().groupBy("file_path").agg(F.count("*").alias("symbols"))
    # caller ids are symbol:<path>:<Name>; neither part holds a colon
    called = (calls.select("caller_id", "called_name").distinct()
              .select(F.regexp_extract("caller_id", "^symbol:(.*):[^:]*$", 1).alias("file_path"))
              .groupBy("file_path").agg(F.count("*").alias("calls")))
    per_file = (mods.join(sym.withColumnRenamed("file_path", "path"), "path", "left")
                .join(called.withColumnRenamed("file_path", "path"), "path", "left"))
    counted = salted_aggregate(per_file, ["domain"], [
        ("modules", "count", F.col("id")), ("loc", "sum", F.coalesce(F.col("loc"), F.lit(0)).cast("long")),
        ("symbols", "sum", F.coalesce(F.col("symbols"), F.lit(0))), ("calls", "sum", F.coalesce(F.col("calls"), F.lit(0)))], ["id"], salts, share)
    spaces = mods.select("domain", F.get(F.split("path", "/"), F.lit(2)).alias("workspace")).filter("workspace IS NOT NULL").distinct()
    docs = documents.select("doc_id", "workspace").filter("workspace IS NOT NULL").distinct().groupBy("workspace").agg(F.count("*").alias("documents"))
    per_domain = spaces.join(docs, "workspace").groupBy("domain").agg(F.sum("documents").alias("documents"))
    return (counted.alias("c").join(per_domain.alias("d"), F.col("c.domain").eqNullSafe(F.col("d.domain")), "left")
            .select("c.domain", "modules", "loc", "symbols", "calls", F.coalesce("documents", F.lit(0)).cast("long").alias("documents")))
