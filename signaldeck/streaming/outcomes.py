"""Live totals of a running stream: what it accepted, skipped and found amiss, batch by batch."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from signaldeck.schema import SIGNALS

OBSERVED = "outcomes"
STORED = "batch bigint, totals map<string, bigint>"


def outcome_names(reasons: Sequence[str], diagnostics: Sequence[str]) -> list[str]:
    """Names of all totals, in the order in which they are observed."""
    return ["accepted", *(f"accepted.{s}" for s in SIGNALS), "skipped", *(f"skipped.{r}" for r in reasons), *diagnostics]


def observe_outcomes(rows: DataFrame, reasons: Sequence[str], diagnostics: Sequence[str] = (),
                     reason: str = "reject_reason", diagnostic: str = "diagnostic") -> DataFrame:
    """The accepted rows of a stream, with totals attached to its progress events at no extra pass.

    ``reason`` is NULL for accepted rows; ``diagnostic`` names what is amiss with a row, or is NULL.
    """
    taken = F.col(reason).isNull()
    counts = [F.count_if(taken), *(F.count_if(taken & (F.col("signal") == s)) for s in SIGNALS), F.count_if(~taken)]
    counts += [F.count_if(F.col(reason) == r) for r in reasons] + [F.count_if(F.col(diagnostic) == d) for d in diagnostics]
    return rows.observe(OBSERVED, *(c.alias(f"n{i}") for i, c in enumerate(counts))).filter(taken).drop(reason, diagnostic)


class OutcomeCounts(StreamingQueryListener):
    """Stores the totals of every batch of an observed stream under ``path``; a batch that is run again replaces its own."""

    def __init__(self, spark: SparkSession, path: str, reasons: Sequence[str], diagnostics: Sequence[str] = ()) -> None:
        self._spark, self._path, self._names = spark, path, outcome_names(reasons, diagnostics)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(OBSERVED)
        if row is None:
            return
        totals = {name: row[i] for i, name in enumerate(self._names) if row[i]}
        context = self._spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self._path}/batch-{event.progress.batchId}.json")
        stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
        stream.write(bytearray(json.dumps({"batch": event.progress.batchId, "totals": totals}).encode()))
        stream.close()

    def settle(self) -> None:
        """Wait until the events of all batches that have ended are stored."""
        self._spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def stored_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Name and value of all totals so far, while the stream runs or afterwards."""
    batches = spark.read.schema(STORED).json(path)
    return batches.select(F.explode("totals").alias("name", "value")).groupBy("name").agg(F.sum("value").alias("value"))
