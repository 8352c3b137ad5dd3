"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and single-machine runs."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("signaldeck")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that the cluster names in ``spark.checkpoint.dir``.

    Where the session names none, tables go next to the warehouse, which driver and
    executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/signaldeck-tables"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class LineageCut:
    """Written tables that cut the lineage of an iterative computation.

    Each :meth:`save` writes the DataFrame to a new Parquet table in the shared
    checkpoint folder and reads it back, so a lost executor costs a re-read and not a
    recomputation, and plans (with their inferred constraints) stay small.  A table is
    removed once its successor is complete, unless all are kept; the last one stays for
    its lazy readers until the application ends.
    """

    def __init__(self, spark: SparkSession, keep_all: bool = False) -> None:
        self._spark = spark
        self._keep_all = keep_all
        self._folder = f"{shared_folder(spark).rstrip('/')}/signaldeck-{uuid.uuid4().hex}"
        self._saved = 0

    def new_path(self) -> str:
        """A path below the folder that nothing was written to yet."""
        folder, files = self._hadoop(self._folder)
        if not self._saved:
            files.mkdirs(folder)
            files.deleteOnExit(folder)
        self._saved += 1
        return f"{self._folder}/{self._saved - 1}"

    def save(self, df: DataFrame) -> DataFrame:
        path = self.new_path()
        df.write.parquet(path)
        if self._saved > 1 and not self._keep_all:
            self.remove(f"{self._folder}/{self._saved - 2}")
        return self._spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove all tables, once nothing reads them any more."""
        if self._saved:
            self.remove(self._folder)
            self._saved = 0

    def remove(self, path: str) -> None:
        target, files = self._hadoop(path)
        files.delete(target, True)

    def _hadoop(self, path: str):
        context = self._spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(context._jsc.hadoopConfiguration())
