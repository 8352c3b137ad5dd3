"""Row summaries and per-record reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.functions import scalars as S
from signaldeck.functions import variants as V
from signaldeck.functions.stage import staged
from signaldeck.schema import PROMOTED

MAX_RAW_BYTES = 65_536


def _first_text(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(column), F.lit("")) for column in columns])


def listing(records: DataFrame) -> DataFrame:
    """One row per record: text, level, origin, status, duration and one-line summary."""
    return records.select(
        "project_id",
        "id",
        "signal",
        "ts_nano",
        F.coalesce(_first_text("message", "title", "name"), F.col("id")).alias("text"),
        F.coalesce(_first_text("level"), F.lit("info")).alias("level"),
        F.coalesce(_first_text("logger", "service_name"), F.col("source")).alias("origin"),
        F.coalesce(_first_text("span_status"), F.lit("unset")).alias("status"),
        S.human_duration(F.col("duration_ns")).alias("duration"),
        summary().alias("summary"),
    )


def summary() -> Column:
    """One-line summary by signal: error title, log message, metric or span name."""
    picked = F.when(F.col("signal") == "error", F.col("title")).when(
        F.col("signal") == "log", F.col("message")
    ).otherwise(F.col("name"))
    return F.coalesce(picked, F.col("signal"))


def field_entries() -> Column:
    """Promoted and other fields of a record as one MAP<STRING, VARIANT>."""
    promoted = V.field_map(*[(name, V.of(F.col(column))) for name, (column, _) in PROMOTED.items()])
    return V.merge(promoted, V.object_or_empty(F.col("fields")))


def merged_fields() -> Column:
    """All fields of a record as one VARIANT object; record columns override."""
    own = V.field_map(
        ("id", V.of(F.col("id"))),
        ("project.id", V.of(F.col("project_id"))),
        ("source", V.of(F.col("source"))),
        ("signal", V.of(F.col("signal"))),
        ("received", V.of(F.col("received_at_ms"))),
        ("source_id", V.of(F.col("source_id"))),
        ("issue", V.of(F.col("issue_id"))),
        ("timestamp", V.of(F.col("ts_nano"))),
    )
    return F.to_variant_object(V.merge(own, field_entries()))


def truncated(text: Column, max_bytes: int) -> Column:
    """Longest whole-character prefix of at most ``max_bytes`` UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    # A UTF-8 character has at most four bytes, so one of four cuts is at a boundary.
    cuts = [
        F.try_validate_utf8(F.substring(data, 1, max_bytes - back).cast("string"))
        for back in range(4)
    ]
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(F.coalesce(*cuts))


def truncate_raw(df: DataFrame, max_bytes: int = MAX_RAW_BYTES) -> DataFrame:
    """Cut ``raw`` at the byte limit on a character boundary and flag it."""
    return df.withColumns(
        {
            "raw_truncated": F.coalesce(F.octet_length("raw") > max_bytes, F.lit(False)),
            "raw": truncated(F.col("raw"), max_bytes),
        }
    )


def record_view(records: DataFrame, raw: bool = False) -> DataFrame:
    """(project_id, id, signal, fields) with one merged field object; raw on request."""
    columns = [F.col("project_id"), F.col("id"), F.col("signal"), merged_fields().alias("fields")]
    if not raw:
        return records.select(*columns)
    return truncate_raw(records.select(*columns, "raw"))


def prefixed_fields(records: DataFrame, prefix: str) -> DataFrame:
    """Fields under a prefix as (key without prefix, VARIANT value) rows."""
    wanted = F.map_filter(field_entries(), lambda name, _: name.startswith(prefix))
    return records.select("project_id", "id", F.explode(wanted).alias("_name", "value")).select(
        "project_id", "id", F.substring(F.col("_name"), len(prefix) + 1, 2**31 - 1).alias("key"), "value"
    )


def collapse_frames(df: DataFrame, frames: str, out: str = "frame_groups") -> DataFrame:
    """Consecutive non-app frames of a stack become one group, inside the row.

    ``frames`` names an array of structs with ``in_app``; ``out`` becomes an array of
    (in_app, frames).  Group starts are found first, then each group is the slice up to
    the next start, so the work is linear in the number of frames.
    """
    app = F.transform(F.col(frames), lambda frame: F.coalesce(frame["in_app"], F.lit(False)))
    # A frame starts a group when it, or the frame before it, is an app frame.
    opens = F.zip_with(
        app,
        F.slice(F.concat(F.array(F.lit(True)), app), F.lit(1), F.size(frames)),
        lambda own, before: own | before,
    )
    starts = F.filter(
        F.transform(opens, lambda flag, i: F.when(flag, i)), lambda i: i.isNotNull()
    )
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size(frames)))
    groups = F.zip_with(
        F.col("_starts"),
        ends,
        lambda start, end: F.struct(
            F.coalesce(F.get(F.col(frames), start)["in_app"], F.lit(False)).alias("in_app"),
            F.slice(F.col(frames), start + 1, end - start).alias("frames"),
        ),
    )
    grouped = staged(staged(df, _starts=starts), **{out: groups})
    # Without frames there is one end (0) but no start.
    return grouped.withColumn(
        out, F.filter(out, lambda group: group["frames"].isNotNull())
    ).drop("_starts")
