"""Archive with a commit log: a table of live files, a key index and atomic switches.

An archive folder holds

* ``data/write=<id>/project=/signal=/date=/``: record files, never changed once written;
* ``files/table=<id>``: one row per file of a write, with its partition, rows, bytes and bounds;
* ``keys/table=<id>/field=<name>``: (hash, project, file) of every id, trace and issue of a write,
  in order of the hash, so that a lookup reads the row groups that can hold its key;
* ``gone/table=<id>``: names of files that a commit took out;
* ``log/<version>.json``: one small entry per commit, which names the tables above.

A commit is one new log entry, put in place by a rename that fails where the version is
taken.  Nothing that was written counts before, so a job that fails between its writes
leaves the state as it was.  An entry may also switch the table of hot records.  Lists of
files are Spark tables; after ``fanout`` entries they are merged into a base.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.functions import scalars as S
from signaldeck.operators import search as Q
from signaldeck.schema import RECORD_COLUMNS, RECORD_DDL, conform, event_ms
from signaldeck.sources.archive import ARCHIVE_DDL, PARTITION, partitioned, read_records

KEY_FIELDS = ("id", "trace_id", "issue_id")
FANOUT = 16
# Row groups without a key are skipped within the files that the index names; filters fit the number of keys.
BLOOM = {
    **{f"parquet.bloom.filter.enabled#{field}": "true" for field in KEY_FIELDS},
    "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number": "10",
}
FILES_DDL = (
    "file string, project_id bigint, signal string, receive_date date, records bigint, min_event_ms bigint, max_event_ms bigint, "
    "min_received_ms bigint, max_received_ms bigint, logical_bytes bigint"
)
KEYS_DDL = "hash bigint, project bigint, file string, field string"


class CommitConflict(RuntimeError):
    """Another commit came between reading the state and changing it."""


@dataclass(frozen=True)
class Entry:
    """One commit.  ``base`` names tables of all live files and keys; else they add to the entries before."""

    version: int
    added: str | None = None
    gone: str | None = None
    base: str | None = None
    hot: str | None = None
    batch: str | None = None


class Archive:
    """A folder of archived records as seen through its commit log."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        self.spark, self.path, self._fanout = spark, path.rstrip("/"), fanout

    # --- the log ---------------------------------------------------------------

    def _hadoop(self):
        context = self.spark.sparkContext
        jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf), conf

    def entries(self, version: int | None = None) -> list[Entry]:
        """Commits since the last base, up to a version; one small file each."""
        jvm, files, _ = self._hadoop()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = sorted((int(n[:-5]) for n in names if n.endswith(".json")), reverse=True)
        out = []
        for number in numbers:
            if version is not None and number > version:
                continue
            stream = files.open(jvm.org.apache.hadoop.fs.Path(folder, f"{number:020d}.json"))
            try:
                out.append(Entry(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
            finally:
                stream.close()
            if out[-1].base:
                break
        return out[::-1]

    def version(self) -> int:
        """Number of the newest commit, -1 before the first."""
        found = self.entries()
        return found[-1].version if found else -1

    def _commit(self, after: int, **what: str | None) -> int:
        jvm, files, conf = self._hadoop()
        entry = Entry(after + 1, **what)
        path = jvm.org.apache.hadoop.fs.Path
        written, target = path(f"{self.path}/log/.{uuid.uuid4().hex}"), path(f"{self.path}/log/{entry.version:020d}.json")
        stream = files.create(written, False)
        stream.write(bytearray(json.dumps(asdict(entry)).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
        try:
            context.rename(files.makeQualified(written), files.makeQualified(target), options)
        except Exception as error:
            files.delete(written, False)
            if files.exists(target):
                raise CommitConflict(f"version {entry.version} was committed by another job") from error
            raise
        return entry.version

    def _append(self, **what: str | None) -> int:
        """Commit that holds whatever was committed meanwhile."""
        while True:
            try:
                version = self._commit(self.version(), **what)
                break
            except CommitConflict:
                continue
        if len(self.entries()) > self._fanout:
            self.rebase()
        return version

    def _named(self, kind: str, names: list[str], ddl: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], ddl)
        reader = self.spark.read.schema(f"{ddl}, `table` string").option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*(f"{self.path}/{kind}/table={n}" for n in names)).drop("table")

    def _live(self, kind: str, ddl: str, version: int | None) -> DataFrame:
        found = self.entries(version)
        tables = [n for e in found for n in (e.base, e.added) if n]
        rows = self._named(kind, tables, ddl)
        gone = [e.gone for e in found if e.gone]
        return rows.join(self._named("gone", gone, "file string"), "file", "left_anti") if gone else rows

    # --- reading ---------------------------------------------------------------

    def files(self, version: int | None = None) -> DataFrame:
        """Live files with partition, rows, bounds and bytes."""
        return self._live("files", FILES_DDL, version)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live partitions, as eviction plans want them, from the table of files alone."""
        return self.files(version).groupBy("project_id", "signal", "receive_date").agg(
            F.sum("records").alias("records"), F.min("min_event_ms").alias("min_event_ms"), F.max("max_event_ms").alias("max_event_ms"),
            F.min("min_received_ms").alias("min_received_ms"), F.max("max_received_ms").alias("max_received_ms"),
            F.sum("logical_bytes").alias("logical_bytes"),
        )

    def read_files(self, names: list[str]) -> DataFrame:
        """Records of the named files."""
        if not names:
            return self.spark.createDataFrame([], RECORD_DDL)
        reader = self.spark.read.schema(f"{ARCHIVE_DDL}, `write` string").option("basePath", f"{self.path}/data")
        rows = reader.parquet(*(f"{self.path}/data/{n}" for n in names))
        return rows.withColumnRenamed("project", "project_id").drop("date", "write").select(*RECORD_COLUMNS)

    @staticmethod
    def _names(files: DataFrame) -> list[str]:
        return [r["file"] for r in files.select("file").sort("file").toLocalIterator()]

    def read(self, project_id: int | None = None, signal: str | None = None, start_ms: int = 0,
             end_ms: int = Q.LONG_MAX // 1_000_000, version: int | None = None) -> DataFrame:
        """Live records of a project and signal in an event-time range; other files are not opened."""
        files = self.files(version).where((F.col("max_event_ms") >= start_ms) & (F.col("min_event_ms") <= end_ms))
        keep = F.lit(True)
        for column, value in (("project_id", project_id), ("signal", signal)):
            if value is not None:
                files, keep = files.where(F.col(column) == value), keep & (F.col(column) == value)
        return self.read_files(self._names(files)).where(keep & Q.time_range(start_ms, end_ms))

    def lookup(self, field: str, value: str, project_id: int, version: int | None = None) -> DataFrame:
        """Records whose ``field`` (one of ``KEY_FIELDS``) is ``value``: only files that hold the key are read."""
        if field not in KEY_FIELDS:
            raise ValueError(f"no index on {field!r}; there is one on {', '.join(KEY_FIELDS)}")
        keys = self._live("keys", KEYS_DDL, version).where(
            (F.col("field") == field) & (F.col("hash") == F.xxhash64(F.lit(value))) & (F.col("project") == project_id)
        )
        rows = self.read_files(self._names(keys.select("file").distinct()))
        return rows.where((F.col("project_id") == project_id) & (F.col(field) == value))

    def hot(self, version: int | None = None) -> DataFrame:
        """Records that no commit has archived yet, as the newest compaction left them."""
        found = [e.hot for e in self.entries(version) if e.hot]
        return self.spark.read.schema(RECORD_DDL).parquet(f"{self.path}/hot/{found[-1]}") if found else self.spark.createDataFrame([], RECORD_DDL)

    def records(self, version: int | None = None) -> DataFrame:
        """Hot and archived records, one per (project, id)."""
        return read_records(self.hot(version), self.read(version=version))

    def newest_page(self, project_id: int, signal: str, predicate: Column | None = None, limit: int = Q.DEFAULT_PAGE,
                    cursor: tuple[int, str] | None = None) -> DataFrame:
        """One page of matching records, newest first; reading stops once no older file can add to it.

        Files are taken by their latest event, twice as many in each round.  A page is
        full when its last row is later than everything in the files not taken.
        """
        files = self.files().where((F.col("project_id") == project_id) & (F.col("signal") == signal))
        if cursor is not None:
            files = files.where(F.col("min_event_ms") <= cursor[0] // 1_000_000)
        order = files.select("file", "max_event_ms", "records").sort(F.desc("max_event_ms"), "file").collect()  # names and bounds
        take, seen = 0, 0
        while take < len(order) and seen <= limit:
            seen += order[take]["records"]
            take += 1
        while True:
            rows = Q.matching(self.read_files([r["file"] for r in order[:take]]), project_id, signal, predicate, 0, Q.LONG_MAX // 1_000_000)
            found = Q.page(rows, limit, cursor)
            if take >= len(order):
                return found
            edge = found.where("has_more").agg(F.count("*").alias("n"), F.min(event_ms()).alias("last")).first()
            if edge["n"] >= limit and edge["last"] > order[take]["max_event_ms"]:
                return found
            take = min(max(2 * take, 1), len(order))

    # --- writing ---------------------------------------------------------------

    def _write(self, records: DataFrame) -> str:
        """Record files with their tables of files and keys; returns their name."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data/write={name}"
        rows = partitioned(conform(records)).hint("rebalance", *PARTITION).sortWithinPartitions(*PARTITION, "name", "ts_nano")
        writer = rows.write.partitionBy(*PARTITION).option("compression", "zstd").options(**BLOOM)
        writer.parquet(folder)
        back = self.spark.read.schema(ARCHIVE_DDL).parquet(folder)
        file = F.concat(F.lit(f"write={name}/"), F.substring_index(F.col("_metadata.file_path"), f"/write={name}/", -1)).alias("file")
        size = S.logical_bytes(*RECORD_COLUMNS)
        back.withColumn("project_id", F.col("project")).groupBy(file, "project_id", "signal", F.col("date").alias("receive_date")).agg(
            F.count("*").alias("records"), F.min(event_ms()).alias("min_event_ms"), F.max(event_ms()).alias("max_event_ms"),
            F.min("received_at_ms").alias("min_received_ms"), F.max("received_at_ms").alias("max_received_ms"),
            F.sum(size).cast("bigint").alias("logical_bytes"),
        ).write.parquet(f"{self.path}/files/table={name}")
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in KEY_FIELDS))
        keys = back.select(F.col("project"), file, F.explode(pairs).alias("k")).where("k.value IS NOT NULL")
        self._write_keys(keys.select(F.xxhash64("k.value").alias("hash"), "project", "file", F.col("k.field").alias("field")).distinct(), name)
        return name

    def _write_keys(self, keys: DataFrame, name: str) -> None:
        (
            keys.repartitionByRange("field", "hash").sortWithinPartitions("field", "hash")
            .write.partitionBy("field").option("compression", "zstd").parquet(f"{self.path}/keys/table={name}")
        )

    def append(self, records: DataFrame, batch: str | None = None) -> int:
        """Add records as one commit; returns its version.

        With ``batch``, a name such as that of a stream and its batch number, a second call
        for the same batch adds nothing.
        """
        if batch is not None and self.version() >= 0:
            log = self.spark.read.schema("version bigint, batch string").json(f"{self.path}/log")
            done = log.where(F.col("batch") == batch).first()
            if done is not None:
                return done["version"]
        return self._append(added=self._write(records), batch=batch)

    def compact(self, hot: DataFrame, cutoff_ms: int) -> int:
        """Archive hot records received before the cutoff; the rest become the hot table, in the same commit.

        Records that the archive holds already are not added again.
        """
        after = self.version()
        old = F.col("received_at_ms") < cutoff_ms
        stored = self.files(after)
        first = hot.where(old).agg(F.min("received_at_ms")).first()[0]
        if first is not None:
            overlap = stored.where((F.col("max_received_ms") >= first) & (F.col("min_received_ms") < cutoff_ms))
            done = self.read_files(self._names(overlap)).select("project_id", "id")
            moved = hot.where(old).join(done, ["project_id", "id"], "left_anti").select(*hot.columns)
        else:
            moved = hot.where(old)
        name = self._write(moved)
        hot.where(~old).select(*RECORD_COLUMNS).write.option("compression", "zstd").parquet(f"{self.path}/hot/{name}")
        return self._commit(after, added=name, hot=name)

    def drop(self, plan: DataFrame) -> int:
        """Take the partitions of an eviction plan out, as one commit."""
        after = self.version()
        keys = ["project_id", "signal", "receive_date"]
        return self._replace(after, self.files(after).join(plan.select(*keys), keys, "left_semi"), None)

    def merge_small(self, below_records: int) -> int | None:
        """Rewrite the files of fewer records, partition by partition where there are two at least, as one commit."""
        after = self.version()
        small = self.files(after).where(F.col("records") < below_records)
        keys = ["project_id", "signal", "receive_date"]
        several = small.groupBy(*keys).count().where("count > 1").select(*keys)
        names = self._names(small.join(several, keys, "left_semi"))
        if not names:
            return None
        chosen = self.spark.createDataFrame([(n,) for n in names], "file string")
        return self._replace(after, chosen, self._write(self.read_files(names)))

    def _replace(self, after: int, old: DataFrame, added: str | None) -> int:
        gone = uuid.uuid4().hex
        old.select("file").write.parquet(f"{self.path}/gone/table={gone}")
        return self._commit(after, added=added, gone=gone)

    def rebase(self) -> int | None:
        """Merge the tables of live files and keys, as one commit that readers begin with."""
        after = self.version()
        name = uuid.uuid4().hex
        hot = [e.hot for e in self.entries(after) if e.hot]
        self.files(after).write.parquet(f"{self.path}/files/table={name}")
        self._write_keys(self._live("keys", KEYS_DDL, after).select("hash", "project", "file", "field"), name)
        try:
            return self._commit(after, base=name, hot=hot[-1] if hot else None)
        except CommitConflict:
            return None  # the next append tries again

    def vacuum(self, keep_from: int) -> int:
        """Delete files that were taken out by ``keep_from`` or before; versions before it can't be read any more."""
        jvm, files, _ = self._hadoop()
        known = [e.version for e in self.entries(keep_from)]
        live = self.files(keep_from).select("file")
        log = self.spark.read.schema("version bigint, gone string").json(f"{self.path}/log").where("gone IS NOT NULL")
        names = [r["gone"] for r in log.where(F.col("version") <= (known[-1] if known else -1)).toLocalIterator()]
        dropped = 0
        for row in self._named("gone", names, "file string").distinct().join(live, "file", "left_anti").toLocalIterator():
            dropped += bool(files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{row['file']}"), False))
        return dropped
