"""Decoded trace-agent payloads (v0.4 named spans, v0.5 dictionary-coded spans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.sources.otel import with_arrival

SPAN = (
    "struct<service: string, name: string, resource: string, trace_id: bigint, span_id: bigint, "
    "parent_id: bigint, start: bigint, duration: bigint, error: int, meta: map<string, string>, "
    "metrics: map<string, double>, type: string>"
)
# The twelve positions of a coded span, as named fields; texts are dictionary indexes
# and map keys are indexes written as text.
CODED_SPAN = (
    "struct<service: bigint, name: bigint, resource: bigint, trace_id: bigint, span_id: bigint, "
    "parent_id: bigint, start: bigint, duration: bigint, error: int, meta: map<string, bigint>, "
    "metrics: map<string, double>, type: bigint>"
)
V04_DDL = f"traces array<array<{SPAN}>>"
V05_DDL = f"dictionary array<string>, traces array<array<{CODED_SPAN}>>"


def read_spans_v04(spark: SparkSession, path: str, project_id: int,
                   received_at_ms: int | None = None, format: str = "json") -> DataFrame:
    """One row per payload of named spans."""
    rows = spark.read.schema(V04_DDL).format(format).load(path)
    return with_arrival(rows, project_id, received_at_ms)


def read_spans_v05(spark: SparkSession, path: str, project_id: int,
                   received_at_ms: int | None = None, format: str = "json") -> DataFrame:
    """One row per payload of dictionary-coded spans."""
    rows = spark.read.schema(V05_DDL).format(format).load(path)
    return with_arrival(rows, project_id, received_at_ms)


def spans(payloads: DataFrame) -> DataFrame:
    """One row per named span."""
    return payloads.select(
        "project_id", "received_at_ms", F.explode(F.flatten("traces")).alias("span")
    )
