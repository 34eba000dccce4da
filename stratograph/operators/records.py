"""Decision records kept as a table, with Markdown files beside it."""

from __future__ import annotations

import re
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADR_SCHEMA = "id string, number int, title string, status string, date string, context string, decision string, consequences string, tags array<string>, superseded_by string, updated_at string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ADR_SCHEMA)


def listed(adrs: DataFrame, status: str = "", tag: str = "") -> DataFrame:
    """Records by number, filtered by status and tag without regard to case."""
    out = adrs
    if status:
        out = out.filter(F.lower("status") == status.lower())
    if tag:
        out = out.filter(F.coalesce(F.exists("tags", lambda t: F.lower(t) == tag.lower()), F.lit(False)))
    return out.orderBy("number")


def one(adrs: DataFrame, key: str) -> DataFrame:
    """The record of an id (``ADR-0001``) or a number."""
    wanted = f"ADR-{int(key):04d}" if key.strip().isdigit() else key.strip().upper()
    return adrs.filter(F.upper("id") == wanted)


def created(adrs: DataFrame, title: str, today: str | None = None, status: str = "accepted", **fields) -> DataFrame:
    """The table with one record more, numbered one above the highest. A title is required."""
    if not title or not title.strip():
        raise ValueError("a decision record needs a title")
    today = today or date.today().isoformat()
    spark = adrs.sparkSession
    row = spark.createDataFrame([(title.strip(), status or "accepted", today, fields.get("context", ""), fields.get("decision", ""), fields.get("consequences", ""), list(fields.get("tags", [])), "", today)],
                                "title string, status string, date string, context string, decision string, consequences string, tags array<string>, superseded_by string, updated_at string")
    number = adrs.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("number"))  # one row
    new = row.join(F.broadcast(number)).withColumn("id", F.format_string("ADR-%04d", "number"))
    return adrs.unionByName(new.select(*adrs.columns))


def updated(adrs: DataFrame, key: str, today: str | None = None, **fields) -> DataFrame:
    """The table with one record changed: fields that are not given or None stay; being superseded ends ``accepted``."""
    hit = F.upper("id") == (f"ADR-{int(key):04d}" if key.strip().isdigit() else key.strip().upper())
    given = {k: v for k, v in fields.items() if v is not None}
    if given.get("superseded_by") and "status" not in given:
        status = F.when(hit & (F.col("status") == "accepted"), F.lit("superseded")).otherwise(F.col("status"))
    else:
        status = F.when(hit, F.lit(given.get("status"))).otherwise(F.col("status")) if "status" in given else F.col("status")
    out = {"status": status, "updated_at": F.when(hit, F.lit(today or date.today().isoformat())).otherwise(F.col("updated_at"))}
    for k, v in given.items():
        if k != "status":
            value = F.array(*[F.lit(x) for x in v]).cast("array<string>") if k == "tags" else F.lit(v)
            out[k] = F.when(hit, value).otherwise(F.col(k))
    return adrs.withColumns(out)


def deleted(adrs: DataFrame, key: str) -> DataFrame:
    return adrs.join(one(adrs, key).select("id"), "id", "left_anti").select(*adrs.columns)


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or "untitled"


def write_markdown(adrs: DataFrame, folder: str) -> list[str]:
    """Write ``NNNN-slug.md`` for each record and remove files of records that are gone; a folder of documents for people, so it is small."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    wanted = {}
    for r in adrs.orderBy("number").toLocalIterator():
        head = f"# {r['id']}: {r['title']}\n\n- Status: {r['status']}\n- Date: {r['date']}\n" + (f"- Tags: {', '.join(r['tags'])}\n" if r["tags"] else "") + (f"- Superseded by: {r['superseded_by']}\n" if r["superseded_by"] else "")
        body = "".join(f"\n## {name.capitalize()}\n\n{r[name]}\n" for name in ("context", "decision", "consequences") if r[name])
        wanted[f"{r['number']:04d}-{slug(r['title'])}.md"] = head + body
    for old in target.glob("[0-9][0-9][0-9][0-9]-*.md"):
        if old.name not in wanted:
            old.unlink()
    for name, text in wanted.items():
        (target / name).write_text(text)
    return sorted(wanted)
