"""Typed access to VARIANT values (no implicit coercion between JSON types)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from signaldeck.functions.stage import once

ARRAY_OF_VARIANT = "array<variant>"
MAP_OF_VARIANT = "map<string,variant>"


def path(*keys: str) -> str:
    """JSON path of nested object keys; dots inside a key are literal."""
    return "$" + "".join(f"['{key}']" if '"' in key else f'["{key}"]' for key in keys)


def get(value: Column, *keys: str) -> Column:
    """Sub-value at the keys; SQL NULL only when a key is missing."""
    if not any('"' in key and "'" in key for key in keys):
        # One path copies only what it ends at.
        return F.try_variant_get(value, path(*keys), "variant") if keys else value
    for key in keys:
        if '"' in key and "'" in key:
            # No path can name such a key.
            value = F.element_at(F.try_variant_get(value, "$", MAP_OF_VARIANT), key)
        else:
            value = F.try_variant_get(value, path(key), "variant")
    return value


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return kind(value) == "STRING"


def is_number(value: Column) -> Column:
    name = kind(value)
    return name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")


def is_bool(value: Column) -> Column:
    return kind(value) == "BOOLEAN"


def is_array(value: Column) -> Column:
    return kind(value).startswith("ARRAY")


def is_object(value: Column) -> Column:
    # The type alone: naming the schema of a document reads all of it.
    return F.when(value.isNotNull(), F.try_variant_get(value, "$", "struct<>").isNotNull())


def as_string(value: Column) -> Column:
    return F.when(is_string(value), F.try_variant_get(value, "$", "string"))


def as_double(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def as_bigint(value: Column) -> Column:
    return F.when(kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def as_bool(value: Column) -> Column:
    return F.when(is_bool(value), F.try_variant_get(value, "$", "boolean"))


def has_type(value: Column, sql_type: str) -> Column:
    """Whether the value has exactly the JSON type behind ``sql_type``."""
    return {
        "string": is_string,
        "double": is_number,
        "bigint": lambda v: kind(v) == "BIGINT",
        "boolean": is_bool,
    }[sql_type](value)


def typed(value: Column, sql_type: str) -> Column:
    """Value when it has exactly the JSON type behind ``sql_type``, else NULL."""
    return {
        "string": as_string,
        "double": as_double,
        "bigint": as_bigint,
        "boolean": as_bool,
    }[sql_type](value)


def array_or_none(value: Column) -> Column:
    # Only an array can be read as one.
    return F.try_variant_get(value, "$", ARRAY_OF_VARIANT)


def array_or_empty(value: Column) -> Column:
    return F.coalesce(array_or_none(value), F.array().cast(ARRAY_OF_VARIANT))


def object_or_empty(value: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(value, "$", MAP_OF_VARIANT),
        F.create_map().cast(MAP_OF_VARIANT),
    )


def elements(value: Column) -> Column:
    """All values of a field: array members, or the value itself; none if missing."""
    return (
        F.when(value.isNull(), F.array().cast(ARRAY_OF_VARIANT))
        .when(is_array(value), F.try_variant_get(value, "$", ARRAY_OF_VARIANT))
        .otherwise(F.array(value))
    )


def of(value: Column) -> Column:
    """Plain SQL value -> VARIANT (NULL stays NULL)."""
    return value.cast("variant")


def json_null() -> Column:
    return F.parse_json(F.lit("null"))


def field_map(*entries: tuple[str, Column]) -> Column:
    """MAP<STRING, VARIANT> of the entries whose value is present."""
    return F.map_filter(
        F.create_map(*[part for name, value in entries for part in (F.lit(name), value)]),
        lambda _, value: value.isNotNull(),
    )


def merge(*maps: Column) -> Column:
    """Union of maps; on equal keys the earlier map wins."""
    if len(maps) == 1:
        return maps[0]
    entries = F.flatten(F.array(*map(F.map_entries, maps)))
    return _map_of(entries, MAP_OF_VARIANT, lambda old, new: F.coalesce(old, new))


def map_of_pairs(pairs: Column, kind: str = MAP_OF_VARIANT) -> Column:
    """Map of an array of (key, value) structs; the last value of a key wins."""
    return _map_of(pairs, kind, lambda old, new: F.coalesce(new, old))


def _map_of(pairs: Column, kind: str, chosen: Callable[[Column, Column], Column]) -> Column:
    """Map of (key, value) structs; only where a key repeats, its values meet one by one."""

    def built(pairs: Column) -> Column:
        keys = pairs.getField("key")
        folded = F.aggregate(
            pairs,
            F.create_map().cast(kind),
            lambda done, pair: F.map_zip_with(
                done, F.create_map(pair["key"], pair["value"]), lambda _, old, new: chosen(old, new)
            ),
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(pairs)).otherwise(folded)

    return once(pairs, built)


def prefix_keys(values: Column, prefix: str) -> Column:
    return F.transform_keys(values, lambda key, _: F.concat(F.lit(prefix), key))
