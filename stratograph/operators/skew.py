"""Keys that hold most rows: salted two-stage aggregation and a join that splits hot keys.

Heavy keys are found by an exact count with map-side combine. A key counts as heavy when it
holds at least ``share`` of all rows, so there are never more than ``1 / share`` of them; that is
the proven bound under which they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
SHARE = 0.01


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE, weight: Column | None = None) -> DataFrame:
    """Keys whose rows (or summed ``weight``) make up at least ``share`` of the total.

    Returns the key columns and ``key_weight``; at most ``1 / share`` rows. Null keys are a group
    of their own. An empty input gives no rows.
    """
    weight = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    counts = df.groupBy(*keys).agg(F.sum(weight.cast("long")).alias("key_weight"))
    total = counts.agg(F.sum("key_weight").alias("_total"))
    return (
        counts.join(F.broadcast(total))  # a single row
        .filter((F.col("key_weight") > 0) & (F.col("key_weight") >= F.col("_total") * F.lit(float(share))))
        .drop("_total")
    )


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def with_salt(df: DataFrame, keys: Sequence[str], row_id: Sequence[str], salts: int = SALTS, share: float = SHARE,
              heavy: DataFrame | None = None) -> DataFrame:
    """Add ``_salt``: 0 for ordinary keys, 0..salts-1 for rows of heavy keys.

    The salt is a hash of ``row_id`` rather than ``rand()``, so a recomputed task puts each row where
    it was before and a lost executor cannot double or lose rows.
    """
    heavy = heavy_keys(df, keys, share) if heavy is None else heavy
    marked = heavy.select(*keys, F.lit(True).alias("_heavy"))
    out = df.alias("l").join(F.broadcast(marked.alias("r")), _same("l", "r", keys), "left")  # at most 1/share rows
    salt = F.when(F.col("r._heavy"), F.pmod(F.xxhash64(*[F.col(f"l.{c}") for c in row_id]), F.lit(salts))).otherwise(F.lit(0))
    return out.select("l.*", salt.cast("int").alias("_salt"))


#: partial aggregate name -> (stage one, stage two)
_MERGE = {
    "count": (lambda c: F.count(c), lambda c: F.sum(c)),
    "sum": (lambda c: F.sum(c), lambda c: F.sum(c)),
    "min": (lambda c: F.min(c), lambda c: F.min(c)),
    "max": (lambda c: F.max(c), lambda c: F.max(c)),
}


def salted_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[tuple[str, str, Column]], row_id: Sequence[str],
                     salts: int = SALTS, share: float = SHARE) -> DataFrame:
    """Two-stage aggregate: partials per (key, salt), merged per key.

    ``aggs`` holds (output name, one of count/sum/min/max, input column). Rows of a key that holds a
    third of the input are spread over ``salts`` groups in the first stage; the second stage sees at
    most ``salts`` rows per heavy key. Null keys form a group; null inputs are ignored as in SQL;
    count of nothing is 0, sum of nothing null; an empty input gives no rows. Extra columns of the
    input, whatever their names, do not matter.
    """
    inputs = df.select(*keys, *[F.xxhash64(*row_id).alias("_row")], *[c.alias(f"_in_{n}") for n, _, c in aggs])
    salted = with_salt(inputs, keys, ["_row"], salts, share)
    first = salted.groupBy(*keys, "_salt").agg(*[_MERGE[how][0](F.col(f"_in_{n}")).alias(n) for n, how, _ in aggs])
    return first.groupBy(*keys).agg(*[_MERGE[how][1](F.col(n)).alias(n) for n, how, _ in aggs])


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, row_id: Sequence[str],
              salts: int = SALTS, share: float = SHARE) -> DataFrame:
    """Equi-join in which the left side may be skewed.

    ``right`` should be pre-aggregated to few rows per key: its rows of heavy keys (at most
    ``1 / share`` of them) are repeated once per salt, all others stay as they are. ``how`` is inner,
    left, left_semi or left_anti. Null keys never match.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot do {how!r}")
    heavy = heavy_keys(left, keys, share)
    salted = with_salt(left, keys, row_id, salts, heavy=heavy)
    marked = heavy.select(*keys, F.lit(True).alias("_heavy"))
    spread = right.alias("l").join(F.broadcast(marked.alias("r")), _same("l", "r", keys), "left")
    spread = spread.select("l.*", F.explode(F.when(F.col("r._heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
