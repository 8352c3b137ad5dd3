"""Envelope files: a header line, then pairs of item header and payload.

One row per envelope with its items as an array, so that an envelope is accepted or
rejected as a whole inside its row.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signaldeck.functions import variants as V
from signaldeck.functions.stage import once, staged
from signaldeck.sources.otel import with_arrival

# Executors get the splitter itself and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Greatest size of an envelope after decompression, unless the caller sets another.
MAX_ENVELOPE_BYTES = 20 * 1024 * 1024

FRAMED = "header string, items array<struct<header: string, payload: string>>, frame_error string"


BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_envelopes(spark: SparkSession, path: str, project_id: int,
                   received_at_ms: int | None = None, max_bytes: int = MAX_ENVELOPE_BYTES) -> DataFrame:
    """Envelope files (plain or .gz), one envelope per file, as framed envelopes."""
    files = spark.read.format("binaryFile").load(path)
    return _framed_files(files, project_id, received_at_ms, max_bytes)


def stream_envelopes(spark: SparkSession, path: str, project_id: int, received_at_ms: int | None = None,
                     max_bytes: int = MAX_ENVELOPE_BYTES, files_per_batch: int = 1000) -> DataFrame:
    """Framed envelopes of files as they arrive; the checkpoint remembers the files that were read.

    Spark's own file source lists and opens the files, so that any store it reaches will do.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("maxFilesPerTrigger", files_per_batch).load(path)
    return _framed_files(files, project_id, received_at_ms, max_bytes)


def _framed_files(files: DataFrame, project_id: int, received_at_ms: int | None, max_bytes: int) -> DataFrame:
    rows = files.select(F.col("path").alias("envelope_id"), F.col("content").alias("body"))
    return frame_envelopes(with_arrival(rows, project_id, received_at_ms), max_bytes)


def frame_envelopes(bodies: DataFrame, max_bytes: int = MAX_ENVELOPE_BYTES) -> DataFrame:
    """Split envelope bodies (BINARY ``body``) into header and items.

    A body of more than ``max_bytes`` after decompression is a framing error.

    Bodies whose lines agree with the declared payload lengths are split by built-in
    expressions.  The rest (payloads with newlines, compressed or malformed bodies)
    goes through a byte-level splitter, the only Python in this path.
    """
    text = F.col("_text")
    bodies = staged(bodies, _text=F.try_validate_utf8(F.col("body").cast("string")))
    lines = F.split(text, "\n", -1)
    # One newline at the very end closes the last line and starts none.
    lines = F.when(text.endswith("\n"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    split = staged(bodies, _lines=lines)
    count = F.floor((F.size("_lines") - 1) / 2).cast("int")
    pairs = F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.get("_lines", i * 2 - 1).alias("header"), F.get("_lines", i * 2).alias("payload")
        ),
    )
    split = staged(split, items=pairs)

    def consistent(item: Column) -> Column:
        fits = lambda declared: declared.isNull() | (V.as_bigint(declared) == F.octet_length(item["payload"]))
        good = lambda header: V.is_object(header) & once(V.get(header, "length"), fits)
        return F.coalesce(once(F.try_parse_json(item["header"]), good), F.lit(False))

    plain = (
        F.col("_lines").isNotNull()
        & (F.size("_lines") % 2 == 1)
        & (F.octet_length("body") <= max_bytes)
        & F.forall("items", consistent)
    )
    split = staged(split, _plain=F.coalesce(plain, F.lit(False)))
    carried = [field for field in bodies.schema if field.name not in ("body", "_text")]
    keep = [field.name for field in carried]
    simple = split.filter("_plain").select(
        *keep, F.get("_lines", F.lit(0)).alias("header"), "items",
        F.lit(None).cast("string").alias("frame_error"),
    )
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in carried)
    rest = split.filter(~F.col("_plain")).select(*keep, "body")
    framed = rest.mapInPandas(partial(_frame_batches, max_bytes), f"{schema}, {FRAMED}")
    return simple.unionByName(framed)


def _frame_batches(max_bytes: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        framed = [split_body(bytes(body), max_bytes) for body in batch["body"]]
        out = batch.drop(columns="body")
        out["header"] = [header for header, _, _ in framed]
        out["items"] = [items for _, items, _ in framed]
        out["frame_error"] = [error for _, _, error in framed]
        yield out


def unpacked(body: bytes, max_bytes: int) -> bytes:
    """The body, decompressed if it is gzip; never more than ``max_bytes`` and one are unpacked."""
    if body[:2] != b"\x1f\x8b":
        return body
    parts, size = [], 0
    while body:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(body, max_bytes + 1 - size))
        size += len(parts[-1])
        if size > max_bytes:
            break
        if not member.eof:
            raise ValueError("compressed body is cut off")
        body = member.unused_data.lstrip(b"\0")
    return b"".join(parts)


def split_body(body: bytes, max_bytes: int = MAX_ENVELOPE_BYTES) -> tuple[str | None, list[dict], str | None]:
    """(header, items, error) of one body, by byte positions."""
    try:
        body = unpacked(body, max_bytes)
        if len(body) > max_bytes:
            raise ValueError("body too large")

        def line_end(start: int) -> int:
            found = body.find(b"\n", start)
            return len(body) if found < 0 else found

        end = line_end(0)
        head, at, items = body[:end], end + 1, []
        while at < len(body):
            end = line_end(at)
            line = body[at:end]
            declared = json.loads(line)
            if not isinstance(declared, dict):
                raise ValueError("header line of an item is no object")
            at = end + 1
            if "length" in declared:
                size = declared["length"]
                if type(size) is not int or not 0 <= size <= max(len(body) - at, 0):
                    raise ValueError("fewer bytes left than an item declares")
                end = at + size
                if end < len(body) and body[end] != 0x0A:
                    raise ValueError("bytes behind the declared end of an item")
            elif at >= len(body):
                raise ValueError("body ends behind an item header")
            else:
                end = line_end(at)
            items.append({"header": line.decode(), "payload": body[at:end].decode()})
            at = end + 1
        return head.decode(), items, None
    except (ValueError, zlib.error) as error:
        return None, [], str(error)
