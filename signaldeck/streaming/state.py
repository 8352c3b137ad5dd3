"""Keyed state of a stream as levelled runs in hash buckets.

A batch adds one run that holds its own keys only; ``fanout`` runs of a level are merged
to one of the next, so that what is written grows with the batches and not with the store.
A version, one small file per batch, names the runs that make up the state after it: a
replayed batch starts from the version before its own and writes the same run again.
Runs that no version kept needs are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: Versions kept for replays and readers.
KEPT = 8

# (batch, step): step 0 is the batch's own, later ones came between it and the next batch.
Version = tuple[int, int]


class DeltaState:
    """State under a folder; ``merge`` makes one row per key out of several, in any order.

    The number of buckets is fixed by the first batch.  Keys are hashed to them, unless
    ``place`` gives the bucket of a row, for example its day: a column of keys only.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame],
                 buckets: int = 16, fanout: int = 4, place: Column | None = None) -> None:
        self._spark, self._path, self._keys, self._merge, self._fanout = spark, path, keys, merge, fanout
        self._place = place
        context = spark.sparkContext
        self._hadoop = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(path).getFileSystem(context._jsc.hadoopConfiguration())
        versions = self.versions()
        last = self._entry(versions[-1]) if versions else {"buckets": buckets, "schema": None}
        self._buckets, self._schema = last["buckets"], last["schema"]

    def versions(self) -> list[Version]:
        folder = self._hadoop(f"{self._path}/versions")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        found = (n[:-5].split("-") for n in names if n.endswith(".json") and not n.startswith("."))
        return sorted((int(batch), int(step)) for batch, step in found)

    def _entry(self, version: Version) -> dict:
        stream = self._files.open(self._hadoop(f"{self._path}/versions/{version[0]}-{version[1]}.json"))
        try:
            return json.loads(self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _before(self, version: Version | None) -> list[list]:
        earlier = [v for v in self.versions() if version is None or v < version]
        return self._entry(earlier[-1])["runs"] if earlier else []

    def bucket(self) -> Column:
        if self._place is not None:
            return self._place.cast("int")
        return F.pmod(F.xxhash64(*self._keys), F.lit(self._buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the rows' keys fall into."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def _rows(self, runs: list[list], within: Column | None = None) -> DataFrame | None:
        if not runs:
            return None
        schema = StructType.fromJson(json.loads(self._schema)).add("bucket", IntegerType()).add("run", StringType())
        reader = self._spark.read.schema(schema).option("basePath", f"{self._path}/runs")
        held = [reader.parquet(f"{self._path}/runs/run={name}") for _, name, _ in runs]
        rows = held[0]
        for more in held[1:]:
            rows = rows.unionByName(more)
        if within is not None:
            rows = rows.filter(within)
        rows = rows.drop("run", "bucket")
        return rows if len(runs) == 1 else self._merge(rows)

    def before(self, batch_id: int, touched: list[int] | None = None) -> DataFrame | None:
        """State before a batch, of some buckets or all; None if there is none yet."""
        within = None if touched is None else F.col("bucket").isin(touched)
        return self._rows(self._before((batch_id, 0)), within)

    def read(self, batch_id: int | None = None, within: Column | None = None) -> DataFrame | None:
        """State after a batch, by default the newest; ``within`` chooses by ``bucket`` what is read."""
        return self._rows(self._before(None if batch_id is None else (batch_id + 1, 0)), within)

    def run(self, batch_id: int) -> DataFrame:
        """The rows that a batch itself added."""
        return self._rows([[0, f"{batch_id}-0-0", [batch_id, 0]]])

    def _write(self, rows: DataFrame, name: str) -> None:
        bucketed = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path}/runs/run={name}")

    def update(self, delta: DataFrame, batch_id: int) -> None:
        """Add a batch's rows, one per key, as the version after it."""
        self._add(delta, (batch_id, 0))

    def amend(self, delta: DataFrame) -> None:
        """Add rows between two batches, for example keys that are released."""
        last = self.versions()
        if last:
            self._add(delta, (last[-1][0], last[-1][1] + 1))

    def _add(self, delta: DataFrame, version: Version) -> None:
        runs = self._before(version)
        self._schema = self._schema or delta.schema.json()
        name = f"{version[0]}-{version[1]}-0"
        self._write(delta, name)
        runs = [*runs, [0, name, list(version)]]
        level = 0
        while len(full := [r for r in runs if r[0] == level]) >= self._fanout:
            merged = f"{version[0]}-{version[1]}-{level + 1}"
            self._write(self._rows(full), merged)
            runs = [r for r in runs if r[0] != level]
            runs.append([level + 1, merged, list(version)])
            level += 1
        target = self._hadoop(f"{self._path}/versions/{version[0]}-{version[1]}.json")
        stream = self._files.create(target, True)
        stream.write(bytearray(json.dumps({"buckets": self._buckets, "schema": self._schema, "runs": runs}).encode()))
        stream.close()
        self._expire(version)

    def _expire(self, newest: Version) -> None:
        """Remove versions that are too old to be asked for, and runs that only they name."""
        versions = [v for v in self.versions() if v <= newest]
        old, kept = versions[:-KEPT], versions[-KEPT:]
        if not old:
            return
        needed = {name for v in kept for _, name, _ in self._entry(v)["runs"]}
        for version in old:
            for _, name, _ in self._entry(version)["runs"]:
                if name not in needed:
                    self._files.delete(self._hadoop(f"{self._path}/runs/run={name}"), True)
            self._files.delete(self._hadoop(f"{self._path}/versions/{version[0]}-{version[1]}.json"), False)
