"""Processing only new or changed records: sequence numbers kept as disjoint intervals.

A set of processed sequence numbers is a table of closed intervals ``[lo, hi]`` per key. New work is
what is available minus what is processed; a commit merges both. The ledger writes output and
intervals under one commit record, so a run that dies in between leaves nothing behind that a later
run could see.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratograph.operators.skew import skew_join
from stratograph.session import cut


def to_intervals(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Disjoint, maximal intervals (keys, lo, hi) of consecutive sequence numbers.

    Repeated numbers count once, null numbers are left out, null keys form a group.
    """
    island = Window.partitionBy(*keys).orderBy(seq)  # equal numbers have equal ranks, so repeats need no step of their own
    return (df.select(*keys, seq).filter(F.col(seq).isNotNull())
            .withColumn("_isle", F.col(seq) - F.dense_rank().over(island))
            .groupBy(*keys, "_isle").agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).drop("_isle"))


def merge_intervals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of intervals (keys, lo, hi), overlapping or touching ones made one."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = df.filter("lo <= hi").withColumn("_start", F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True)).cast("int"))
    return (starts.withColumn("_isle", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "_isle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_isle"))


def subtract_intervals(available: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The gaps: parts of ``available`` not covered by ``processed`` (both keys, lo, hi).

    A sweep over interval ends: +1/-1 events of both sides, ordered per key; stretches that are open
    on the left and closed on the right are gaps. No join, so no pairs of intervals arise, and one shuffle by key.
    """
    def events(df: DataFrame, da: int, dp: int) -> DataFrame:
        df = df.filter("lo <= hi")
        return (df.select(*keys, F.col("lo").alias("at"), F.lit(da).alias("da"), F.lit(dp).alias("dp"))
                .unionByName(df.select(*keys, (F.col("hi") + 1).alias("at"), F.lit(-da).alias("da"), F.lit(-dp).alias("dp"))))
    order = Window.partitionBy(*keys).orderBy("at")
    run = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # all events of one place together
    swept = events(available, 1, 0).unionByName(events(processed, 0, 1)).withColumns({"_a": F.sum("da").over(run), "_p": F.sum("dp").over(run), "_next": F.lead("at").over(order)})
    gaps = swept.filter("_a > 0 AND _p = 0").select(*keys, F.col("at").alias("lo"), (F.col("_next") - 1).alias("hi"))
    return merge_intervals(gaps, keys)


def points_of(intervals: DataFrame, seq: str) -> DataFrame:
    """One row per number of the intervals, as ``seq``; for intervals whose numbers all stand for rows."""
    return intervals.select(*[c for c in intervals.columns if c not in ("lo", "hi")], F.explode(F.sequence("lo", "hi")).alias(seq))


def pending_files(states: DataFrame, files: DataFrame, ok_status: str = "ok") -> DataFrame:
    """(run_id, path, workspace, base): what each sync run had to process.

    The successful runs of a workspace get the ordinals 1, 2, ... by start. For each file and digest
    the ordinals of the successful runs that listed it are the processed ranges, kept as disjoint intervals; a run
    that starts after ``b`` successful ones makes the ordinal ``b`` of the digests it lists available. The gaps, available minus processed,
    are the work: runs of a digest whose ordinal lies in a gap. Failed and crashed runs get work but add nothing to the processed ranges, so
    nothing is skipped after them; digests compare without regard to case, null as a value of its
    own. Duplicate and late rows are one row. Rows of runs that are not in ``states`` and rows
    without path are left out, since they have no place in the order. Ties in start go by run_id.

    A run's rows are joined to the run with hot runs split, and everything else is keyed by file and digest.
    """
    rows = cut(_listed(states, files, ok_status))  # read three times
    key = ["workspace", "path", "digest"]
    gaps = subtract_intervals(to_intervals(rows, key, "base"), to_intervals(rows.filter("ok = 1").withColumn("ordinal", F.col("base") + 1), key, "ordinal"), key)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("workspace",)]
    return (rows.alias("r").join(points_of(gaps, "base").alias("p"), [F.col(f"r.{c}") == F.col(f"p.{c}") for c in ("path", "digest", "base")] + same, "left_semi")
            .select("run_id", "path", "workspace", "base").distinct())


def _listed(states: DataFrame, files: DataFrame, ok_status: str) -> DataFrame:
    """(run_id, path, digest, workspace, ok, base) of what runs listed; ``base``: successful runs of the workspace before."""
    runs = (states.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.max("workspace").alias("workspace"), F.min("started_at").alias("started_at"),
                                                                     F.max(F.col("status").eqNullSafe(ok_status).cast("int")).alias("ok")))
    # Duplicate state rows of a run agree; the frame below sees one row per run, not per file.
    by_start = Window.partitionBy("workspace").orderBy(F.col("started_at").asc_nulls_first(), "run_id")
    runs = runs.withColumn("base", F.coalesce(F.sum("ok").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = files.filter("path IS NOT NULL AND run_id IS NOT NULL").select("run_id", "path", F.coalesce(F.lower("sha"), F.lit("")).alias("digest"))
    return skew_join(rows, runs.select("run_id", "workspace", "ok", "base"), ["run_id"], "inner", ["path"])


def changed_files(states: DataFrame, files: DataFrame, ok_status: str = "ok") -> DataFrame:
    """(run_id, path, change): :func:`pending_files`, ``modified`` if the last successful run before listed the path at all, else ``added``."""
    known = _listed(states, files, ok_status).filter("ok = 1").select("workspace", "path", (F.col("base") + 1).alias("base")).distinct().withColumn("_known", F.lit(True))
    work = pending_files(states, files, ok_status)
    same = work["workspace"].eqNullSafe(known["workspace"]) & (work["path"] == known["path"]) & (work["base"] == known["base"])
    return work.join(known, same, "left").select("run_id", work["path"], F.when(F.col("_known"), F.lit("modified")).otherwise(F.lit("added")).alias("change"))


class IntervalLedger:
    """Durable record of processed sequence numbers and the output made from them.

    Layout below ``root``: ``data/<batch>`` (output), ``ranges/<batch>`` (the intervals of a batch, or of all up to it) and
    ``commits/<n>.json``. Only a commit file makes a batch visible; it is created with
    overwrite off, so of two runs that race for the same number one fails and changes nothing. A commit names the range folders in force,
    so a run reads one commit and at most ``COMPACT`` folders, however long the ledger is.

    Intervals are kept per key and segment of ``segment`` numbers: a key that holds most rows, or a table without a key, is split by
    its numbers.
    """

    COMPACT = 16
    #: Gaps up to which they are broadcast to the source; they are counted first, and beyond it rows are shuffled by number.
    BROADCAST_GAPS = 100_000

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], seq: str, segment: int = 1 << 16):
        self.spark, self.root, self.keys, self.seq, self.segment = spark, root.rstrip("/"), list(keys), seq, segment
        self._by = [*self.keys, "_segment"]

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(f"{self.root}/{folder}")
        return sorted(str(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, name: str) -> dict:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/commits/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commits(self) -> list[dict]:
        """Commit records, oldest first: one small file per finished run."""
        return [self._read(name) for name in self._names("commits")]

    def last(self) -> dict | None:
        names = self._names("commits")
        return self._read(names[-1]) if names else None

    def _ranges(self, last: dict | None) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/ranges/{b}" for b in last["ranges"]]) if last else None

    def processed(self) -> DataFrame | None:
        """(keys, lo, hi): all processed intervals, disjoint; neighbouring segments are joined."""
        ranges = self._ranges(self.last())
        return None if ranges is None else merge_intervals(ranges.drop("_segment"), self.keys)

    def output(self) -> DataFrame | None:
        done = self.commits()
        folders = [f"{self.root}/data/{c['batch']}" for c in done]
        return self.spark.read.parquet(*folders) if folders else None

    def _numbered(self, source: DataFrame) -> DataFrame:
        return source.filter(F.col(self.seq).isNotNull()).withColumn("_segment", F.floor(F.col(self.seq) / F.lit(self.segment)).cast("long"))

    def pending(self, source: DataFrame) -> DataFrame:
        """Rows of ``source`` whose sequence number no committed interval covers, late ones included.

        Available ranges minus processed ones are the gaps; only keys and numbers are shuffled for that. Few gaps are broadcast
        to the rows, many are joined to them by number. Rows of a null sequence number can be neither ordered nor remembered and are
        left out.
        """
        rows, done = self._numbered(source), self._ranges(self.last())
        if done is None:
            return rows.drop("_segment")
        gaps = cut(subtract_intervals(to_intervals(rows, self._by, self.seq), done, self._by))
        few = gaps.limit(self.BROADCAST_GAPS + 1).count() <= self.BROADCAST_GAPS
        other = F.broadcast(gaps) if few else points_of(gaps, "_at")
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in self._by]
        at = F.col(f"r.{self.seq}")
        same += [(at >= F.col("g.lo")) & (at <= F.col("g.hi"))] if few else [at == F.col("g._at")]
        return rows.alias("r").join(other.alias("g"), same, "left_semi").drop("_segment")

    def run(self, source: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int:
        """Process what is pending and commit output and intervals together; returns the commit number. A run that fails leaves nothing."""
        last, batch = self.last(), uuid.uuid4().hex
        fs, path = self._fs()
        try:
            # the rows are fixed first, so that output and intervals speak of the same ones
            self.pending(source).write.parquet(f"{self.root}/input/{batch}")
            todo = self.spark.read.parquet(f"{self.root}/input/{batch}")
            work(todo).write.parquet(f"{self.root}/data/{batch}")
            fresh, ranges = to_intervals(self._numbered(todo), self._by, self.seq), [*(last["ranges"] if last else []), batch]
            if len(ranges) > self.COMPACT:
                fresh, ranges = merge_intervals(self._ranges(last).unionByName(fresh), self._by), [batch]
            fresh.write.parquet(f"{self.root}/ranges/{batch}")
            number = last["number"] + 1 if last else 1
            stream = fs.create(path(f"{self.root}/commits/{number:09d}.json"), False)
            try:
                stream.write(bytearray(json.dumps({"number": number, "batch": batch, "ranges": ranges}).encode()))
            finally:
                stream.close()
        except BaseException:
            for folder in ("data", "ranges"):
                fs.delete(path(f"{self.root}/{folder}/{batch}"), True)
            raise
        finally:
            fs.delete(path(f"{self.root}/input/{batch}"), True)
        return number

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Remove what runs that died left behind and ranges no longer in force; returns the number of folders removed."""
        fs, path = self._fs()
        done, last = self.commits(), self.last()
        keep = {"data": {c["batch"] for c in done}, "ranges": set(last["ranges"]) if last else set(), "input": set()}
        limit, removed = (time.time() - older_than_hours * 3600) * 1000, 0
        for folder, names in keep.items():
            for name in self._names(folder):
                at = path(f"{self.root}/{folder}/{name}")
                if name not in names and fs.getFileStatus(at).getModificationTime() <= limit:
                    removed += bool(fs.delete(at, True))
        return removed
