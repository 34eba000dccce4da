"""Session helpers: one place for the settings every entry point relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "stratograph", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the cluster names one.

    Only where that setting is absent and the master is local a temporary folder is made and recorded on
    the context, since then driver and executors are one machine. A cluster without the setting is an error: a folder of the driver's
    machine would be lost to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="stratograph-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written in the shared folder: columns and compression keep many narrow rows small."""
    at = f"{shared_dir(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over at least as many tasks as there are cores, for work that is dear per row.

    A table of few, small files gives few tasks; only then are its rows dealt out. Large scans have tasks
    enough and stay where they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def data_dir(sf: str = "0.001") -> str:
    return os.path.join(os.environ.get("STRATOGRAPH_DATA", "/root/testdata"), f"sf{sf}")


class Files:
    """Small files and folders on whatever file system a path is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        return sorted(str(x.getPath().getName()) for x in self._fs.listStatus(self._path(self.at(folder)))) if self.exists(folder) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name) or self._fs.getFileStatus(self._path(self.at(name))).isDirectory():
            return None
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that must not exist yet: of two writers one fails."""
        stream = self._fs.create(self._path(self.at(name)), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return bool(self._fs.delete(self._path(self.at(name)), True))

    def rename(self, name: str, to: str) -> bool:
        return bool(self._fs.rename(self._path(self.at(name)), self._path(self.at(to))))
