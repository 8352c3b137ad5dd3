"""The record model: one wide table for errors, logs, metrics and traces.

A record keeps nine fixed columns, the *promoted* fields as typed columns (so
Parquet statistics, pushdown and codegen apply to them) and every other field in
one ``fields VARIANT`` object.  A field lives in exactly one place: its promoted
column when the value has the promoted type, else inside ``fields``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS = ("error", "log", "metric", "trace")

# Fixed columns of every record.
BASE_COLUMNS: dict[str, str] = {
    "project_id": "bigint",
    "id": "string",
    "signal": "string",
    "source": "string",
    "source_id": "string",
    "issue_id": "string",
    "ts_nano": "bigint",
    "received_at_ms": "bigint",
}

# field name -> (promoted column, type)
PROMOTED: dict[str, tuple[str, str]] = {
    "level": ("level", "string"),
    "message": ("message", "string"),
    "title": ("title", "string"),
    "logger": ("logger", "string"),
    "transaction": ("transaction", "string"),
    "environment": ("environment", "string"),
    "release": ("release", "string"),
    "server": ("server", "string"),
    "trace_id": ("trace_id", "string"),
    "span_id": ("span_id", "string"),
    "parent_span_id": ("parent_span_id", "string"),
    "span.kind": ("span_kind", "string"),
    "span.status": ("span_status", "string"),
    "resource.service.name": ("service_name", "string"),
    "source_record_id": ("source_record_id", "string"),
    "error.type": ("error_type", "string"),
    "error.value": ("error_value", "string"),
    "error.handled": ("error_handled", "boolean"),
    "issue.title": ("issue_title", "string"),
    "issue.fingerprint": ("issue_fingerprint", "string"),
    "name": ("name", "string"),
    "type": ("type", "string"),
    "unit": ("unit", "string"),
    "temporality": ("temporality", "string"),
    "stream_id": ("stream_id", "string"),
    "monotonic": ("monotonic", "boolean"),
    "value": ("value", "double"),
    "cumulative_value": ("cumulative_value", "double"),
    "duration_ns": ("duration_ns", "bigint"),
    "start_timestamp_unix_nano": ("start_nano", "bigint"),
}

RECORD_COLUMNS: dict[str, str] = {
    **BASE_COLUMNS,
    **{column: kind for column, kind in PROMOTED.values()},
    "fields": "variant",
    "raw": "string",
}

# Schema of stored records, as DDL for readers and streams.
RECORD_DDL = ", ".join(f"`{name}` {kind}" for name, kind in RECORD_COLUMNS.items())


def conform(df: DataFrame) -> DataFrame:
    """Bring a partial record table to the full column list (missing -> NULL)."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in RECORD_COLUMNS.items()
        ]
    )


def int_div(column: Column, divisor: int | Column) -> Column:
    """Integer division that stays in BIGINT."""
    divisor = divisor if isinstance(divisor, Column) else F.lit(divisor)
    return F.call_function("div", column, divisor.cast("bigint"))


def event_ms(ts_nano: str | Column = "ts_nano") -> Column:
    """Event time in whole milliseconds."""
    return int_div(F.col(ts_nano) if isinstance(ts_nano, str) else ts_nano, 1_000_000)
