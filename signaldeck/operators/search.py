"""Record search: typed field predicates as Column builders, time range, paging.

Predicates on promoted fields are written so that the native comparison reaches
the Parquet scan; the VARIANT branch only decides rows whose promoted column is
NULL (field absent, of another JSON type, an array, or held as an attribute).
"""

from __future__ import annotations

import functools
import operator as op
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signaldeck.functions import variants as V
from signaldeck.schema import PROMOTED, event_ms

# The searchable field names, reserved prefixes and aliases.
KNOWN_FIELDS = frozenset(
    "id event_id source source_id signal issue project.id timestamp event.timestamp received "
    "received_at message title level logger transaction platform environment release dist server "
    "server_name trace trace_id span_id parent_span_id trace.op trace.status sdk.name sdk.version "
    "user.id user.email user.username user.ip http.method http.url error.type error.value "
    "error.handled stack.filename stack.function stack.module name kind type unit value "
    "firstSeen lastSeen timesSeen".split()
)
RESERVED_PREFIXES = ("project.", "event.", "error.", "stack.", "http.", "user.", "sdk.", "trace.")
ALIASES = {
    "event_id": "source_id",
    "event.timestamp": "timestamp",
    "received_at": "received",
    "server_name": "server",
    "trace": "trace_id",
    "kind": "type",
}
# Fields that are record columns: (column, type)
RECORD_FIELDS = {
    "id": ("id", "string"),
    "project.id": ("project_id", "double"),
    "source": ("source", "string"),
    "signal": ("signal", "string"),
    "received": ("received_at_ms", "double"),
    "timestamp": ("ts_nano", "double"),
    "source_id": ("source_id", "string"),
    "issue": ("issue_id", "string"),
}
DEFAULT_PAGE = 50
DEFAULT_RANGE_MS = 3_600_000

Literal = str | bool | int | float


class UnsupportedField(ValueError):
    """A field under a reserved prefix that is not a known field."""


def tag_key(field: str) -> str | None:
    return field[5:-1] if field.startswith("tags[") and field.endswith("]") and len(field) > 6 else None


def validate_field(field: str) -> str:
    if field in KNOWN_FIELDS or tag_key(field) or not field.startswith(RESERVED_PREFIXES):
        return field
    raise UnsupportedField(f"{field!r} is under a reserved prefix and no known field")


def variant_field(field: str) -> Column:
    """VARIANT of a field: its own name, else the attribute of that name."""
    key = tag_key(field)
    own = V.get(F.col("fields"), ALIASES.get(field, field))
    attribute = V.get(F.col("fields"), f"attribute.{key or field}")
    return F.coalesce(own, attribute)


def native_column(field: str) -> tuple[Column, str] | None:
    """Record or promoted column of a field and its type; None for other fields."""
    canonical = ALIASES.get(field, field)
    found = RECORD_FIELDS.get(canonical) or PROMOTED.get(canonical)
    return (F.col(found[0]), found[1]) if found else None


def field(name: str) -> Column:
    """All values of a field as ARRAY<VARIANT> (empty when the field is absent)."""
    validate_field(name)
    native = native_column(name)
    rest = V.elements(variant_field(name))
    if native is None:
        return rest
    return F.when(native[0].isNotNull(), F.array(V.of(native[0]))).otherwise(rest)


def _literal_type(value: Literal) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "double"


def _comparable(native_type: str, literal_type: str) -> bool:
    numeric = ("double", "bigint")
    return native_type == literal_type or (native_type in numeric and literal_type in numeric)


def _test(name: str, literal_type: str, test: Callable[[Column], Column],
          prune: Callable[[Column], Column] | None = None) -> Column:
    """True when any value of the field has the literal's type and passes ``test``."""
    validate_field(name)
    native = native_column(name)
    rest = F.exists(
        V.elements(variant_field(name)),
        lambda value: F.coalesce(test(V.typed(value, literal_type)), F.lit(False)),
    )
    if native is None:
        return rest
    column, column_type = native
    if not _comparable(column_type, literal_type):
        return column.isNull() & rest
    if name in ("id", "source", "signal", "project.id", "timestamp", "event.timestamp",
                "received", "received_at"):
        return test(column)
    # First conjunct: pushable to the scan, at most weaker than the test and spelled
    # differently (equal disjuncts would be factored out and hide it from pushdown).
    # Second conjunct: the exact decision.
    return ((prune or test)(column) | column.isNull()) & (test(column) | rest)


def eq(name: str, value: Literal) -> Column:
    """Any value of the field equals the literal; types must agree."""
    return _test(name, _literal_type(value), lambda v: v == F.lit(value),
                 lambda v: v.eqNullSafe(F.lit(value)))


def in_(name: str, values: list[Literal]) -> Column:
    """Any value of the field equals any of the literals."""
    by_type: dict[str, list[Literal]] = {}
    for value in values:
        by_type.setdefault(_literal_type(value), []).append(value)
    if not by_type:
        return F.lit(False)
    parts = [
        eq(name, group[0])
        if len(group) == 1
        else _test(name, kind, lambda v, g=group: v.isin(g),
                   lambda v, g=group: functools.reduce(op.or_, [v.eqNullSafe(F.lit(x)) for x in g]))
        for kind, group in by_type.items()
    ]
    return functools.reduce(op.or_, parts)


def _ordered(name: str, value: Literal, test: Callable, prune: Callable) -> Column:
    if isinstance(value, bool):
        return F.lit(False)  # booleans have equality only
    bound = F.lit(value)
    return _test(name, _literal_type(value), lambda v: test(v, bound), lambda v: prune(v, bound))


def gt(name: str, value: Literal) -> Column:
    return _ordered(name, value, op.gt, op.ge)


def ge(name: str, value: Literal) -> Column:
    return _ordered(name, value, op.ge, lambda v, bound: (v > bound) | v.eqNullSafe(bound))


def lt(name: str, value: Literal) -> Column:
    return _ordered(name, value, op.lt, op.le)


def le(name: str, value: Literal) -> Column:
    return _ordered(name, value, op.le, lambda v, bound: (v < bound) | v.eqNullSafe(bound))


def like_pattern(pattern: str) -> str:
    for special in ("\\", "%", "_"):
        pattern = pattern.replace(special, "\\" + special)
    return pattern.replace("*", "%")


def glob(name: str, pattern: str) -> Column:
    """Case-sensitive whole-value match where ``*`` stands for any text."""
    if "*" not in pattern:
        return eq(name, pattern)
    head = pattern.split("*", 1)[0]
    return _test(name, "string", lambda v: v.like(like_pattern(pattern)),
                 (lambda v: v >= F.lit(head)) if head else None)


def has(name: str) -> Column:
    """The field has a value: JSON null counts, an empty array does not."""
    validate_field(name)
    native = native_column(name)
    rest = F.size(V.elements(variant_field(name))) > 0
    return rest if native is None else native[0].isNotNull() | rest


def text(phrase: str) -> Column:
    """Case-insensitive phrase in the message, title or name."""
    needle = F.lower(F.lit(phrase))
    return functools.reduce(
        op.or_,
        [F.lower(F.col(column)).contains(needle) for column in ("message", "title", "name")],
    )


def all_of(*predicates: Column) -> Column:
    return functools.reduce(op.and_, predicates, F.lit(True))


def any_of(*predicates: Column) -> Column:
    return functools.reduce(op.or_, predicates)


def not_(predicate: Column) -> Column:
    """Two-valued NOT: true where the predicate is false or cannot be decided."""
    return ~F.coalesce(predicate, F.lit(False))


def checked_range(start_ms: int | None, end_ms: int | None, now_ms: int | None = None,
                  since_ms: int = DEFAULT_RANGE_MS) -> tuple[int, int]:
    """Closed range; the end defaults to now and the start to one hour before."""
    if end_ms is None:
        if now_ms is None:
            raise ValueError("an open range needs end_ms or now_ms")
        end_ms = now_ms
    if start_ms is None:
        start_ms = max(end_ms - since_ms, 0)
    if start_ms > end_ms:
        raise ValueError("the range ends before it starts")
    return start_ms, end_ms


LONG_MAX = 2**63 - 1


def time_range(start_ms: int, end_ms: int, ts_nano: str = "ts_nano") -> Column:
    """Event time in [start_ms, end_ms], as bounds on the stored nanoseconds."""
    start_ms, end_ms = checked_range(start_ms, end_ms)
    upper = min(end_ms * 1_000_000 + 999_999, LONG_MAX)
    return F.col(ts_nano).between(start_ms * 1_000_000, upper)


def _check_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError("a page has one row at least")
    return limit


def below(cursor: tuple[int, str], time: str = "ts_nano", key: str = "id") -> Column:
    """Keyset continuation: strictly before (time, id) in newest-first order."""
    nano, identifier = cursor
    return (F.col(time) <= nano) & ((F.col(time) < nano) | (F.col(key) < identifier))


def page(df: DataFrame, limit: int = DEFAULT_PAGE, cursor: tuple[int, str] | None = None,
         time: str = "ts_nano", key: str = "id", copies: int = 1) -> DataFrame:
    """Newest ``limit`` rows below the cursor plus ``has_more``.

    ``copies`` is how many rows may share one id (2 for hot + archive); the page
    is taken before de-duplication so that no full shuffle is needed.
    """
    _check_limit(limit)
    rows = df if cursor is None else df.filter(below(cursor, time, key))
    newest = [F.col(time).desc(), F.col(key).desc()]
    top = rows.orderBy(*newest).limit((limit + 1) * copies)
    if copies > 1:
        top = top.dropDuplicates(["project_id", key]) if "project_id" in df.columns else top.dropDuplicates([key])
    # At most (limit + 1) * copies rows reach this unpartitioned window.
    ranked = top.withColumn("_rank", F.row_number().over(W.orderBy(*newest)))
    ranked = ranked.withColumn("has_more", F.max("_rank").over(W.partitionBy()) > limit)
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def next_cursor(rows: list, time: str = "ts_nano", key: str = "id") -> tuple[int, str] | None:
    """Cursor after a collected page, or None on the last one."""
    if not rows or not rows[-1]["has_more"]:
        return None
    last = min(rows, key=lambda row: (row[time], row[key]))
    return last[time], last[key]


def matching(df: DataFrame, project_id: int, signal: str | None, predicate: Column | None,
             start_ms: int, end_ms: int) -> DataFrame:
    """Records of a project and signal in the range that satisfy the predicate."""
    rows = df.filter(F.col("project_id") == project_id)
    if signal is not None:
        rows = rows.filter(F.col("signal") == signal)
    rows = rows.filter(time_range(start_ms, end_ms))
    return rows if predicate is None else rows.filter(predicate)


def search_records(hot: DataFrame, project_id: int, signal: str, predicate: Column | None = None,
                   start_ms: int = 0, end_ms: int = LONG_MAX // 1_000_000, limit: int = DEFAULT_PAGE,
                   cursor: tuple[int, str] | None = None, archive: DataFrame | None = None) -> DataFrame:
    """One page of matching records, newest first, over hot and archived rows."""
    rows = matching(hot, project_id, signal, predicate, start_ms, end_ms)
    if archive is None:
        return page(rows, limit, cursor)
    old = matching(archive, project_id, signal, predicate, start_ms, end_ms)
    return page(rows.unionByName(old, allowMissingColumns=True), limit, cursor, copies=2)


# Name under which an issue row appears as the ``source`` of a record.
ISSUE_SOURCE = "issues"


def issues_as_records(issues: DataFrame) -> DataFrame:
    """Issue rows in record form so that the same predicates apply to them."""
    seen = V.field_map(
        ("firstSeen", V.of(F.col("first_seen_ms"))),
        ("lastSeen", V.of(F.col("last_seen_ms"))),
        ("timesSeen", V.of(F.col("total_seen"))),
    )
    last_nano = F.col("last_seen_ms") * 1_000_000
    values = {
        "id": F.col("issue_id"),
        "signal": F.lit("error"),
        "source": F.lit(ISSUE_SOURCE),
        "source_id": F.lit(None).cast("string"),
        "ts_nano": last_nano,
        "received_at_ms": F.col("last_seen_ms"),
        "message": F.col("title"),
        "fields": F.to_variant_object(seen),
    }
    missing = {
        column: F.lit(None).cast(kind)
        for column, kind in PROMOTED.values()
        if column not in issues.columns and column not in values
    }
    return issues.withColumns({**values, **missing})


def search_issues(issues: DataFrame, project_id: int, predicate: Column | None = None,
                  start_ms: int = 0, end_ms: int = LONG_MAX // 1_000_000, limit: int = DEFAULT_PAGE,
                  cursor: tuple[int, str] | None = None) -> DataFrame:
    """One page of issues by last-seen time, newest first."""
    columns = issues.columns
    start_ms, end_ms = checked_range(start_ms, end_ms)
    rows = issues.filter(
        (F.col("project_id") == project_id) & F.col("last_seen_ms").between(start_ms, end_ms)
    )
    rows = issues_as_records(rows)
    if predicate is not None:
        rows = rows.filter(predicate)
    return page(rows, limit, cursor).select(*columns, "has_more")


def next_issue_cursor(rows: list) -> tuple[int, str] | None:
    """Cursor after a collected page of issues, or None on the last one."""
    if not rows or not rows[-1]["has_more"]:
        return None
    last = min(rows, key=lambda row: (row["last_seen_ms"], row["issue_id"]))
    return last["last_seen_ms"] * 1_000_000, last["issue_id"]
