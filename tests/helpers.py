"""Small record tables for tests."""

import json

from pyspark.sql import functions as F

from signaldeck.schema import BASE_COLUMNS, PROMOTED, conform

TYPES = {**BASE_COLUMNS, **{column: kind for column, kind in PROMOTED.values()}, "raw": "string"}


def records(spark, rows):
    """Record table of dicts; ``fields`` is a plain dict, missing columns are NULL."""
    names = sorted({name for row in rows for name in row} - {"fields"})
    schema = ", ".join(f"`{name}` {TYPES[name]}" for name in names) + ", fields string"
    data = [tuple(row.get(name) for name in names) + (json.dumps(row.get("fields", {})),) for row in rows]
    return conform(spark.createDataFrame(data, schema).withColumn("fields", F.parse_json("fields")))


def metric(id, ts, value, **more):
    return {"project_id": 1, "id": id, "signal": "metric", "source": "otlp", "ts_nano": ts, "received_at_ms": 0,
            "name": "m", "type": "distribution", "value": value, **more}
