"""Change feeds as streams: files that arrive and journals that grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratograph.graph import Graph
from stratograph.operators import sync
from stratograph.sources import workspace


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Source files as they arrive: path (relative), sha, content. The schema is that of the file source of bytes."""
    raw = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
           .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root))
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/", "")
    return raw.select(relative.alias("path"), F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))


def parse_stream(spark: SparkSession, root: str, store: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Parse arriving files into ``store/batch=<n>``; a batch that is replayed after a failure overwrites its own folder and so counts once."""
    def write(batch: DataFrame, number: int) -> None:
        workspace.parse(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return file_stream(spark, root, per_trigger).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def journal_stream(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    """Journal entries from Parquet files that arrive in ``folder``, repeated ones dropped while the watermark remembers them."""
    stream = spark.readStream.schema("seq long, node_id string, op string, recorded_at timestamp").parquet(folder)
    return stream.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["seq"])


def journal_rates(journal: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window start, op, entries): tumbling counts of a journal, batch or stream; a stream drops what is later than the watermark."""
    marked = journal.withWatermark("recorded_at", late) if journal.isStreaming else journal
    return marked.groupBy(F.window("recorded_at", window).alias("w"), "op").agg(F.count("*").alias("entries")).select(F.col("w.start").alias("start"), "op", "entries")


def apply_stream(spark: SparkSession, folder: str, graph: Callable[[], Graph], rows: Callable[[], DataFrame], publish: Callable[[Graph, int], None], checkpoint: str) -> StreamingQuery:
    """Apply arriving journal entries to a graph batch by batch: within a batch only the last intent of a node counts, so a replay changes nothing."""
    def write(batch: DataFrame, number: int) -> None:
        publish(sync.apply_journal(graph(), batch, rows()), number)

    return journal_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
