"""Envelope items -> error, log and metric records in canonical fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signaldeck.functions import ids
from signaldeck.functions import scalars as S
from signaldeck.functions import variants as V
from signaldeck.functions.stage import once, staged
from signaldeck.schema import PROMOTED, conform

SOURCE = "sentry"
# Item size limit, item kinds, metric kinds, reject reason.
MAX_ITEM_BYTES = 1024 * 1024
SIGNAL_OF_KIND = {"event": "error", "log": "log", "trace_metric": "metric"}
METRIC_KINDS = ("counter", "gauge", "distribution")
MALFORMED = "malformed"

# Where canonical fields come from.
TOP_LEVEL = (
    "level logger transaction platform environment release dist trace_id span_id parent_span_id"
).split()
POINTERS = {
    "user.id": ("user", "id"),
    "user.email": ("user", "email"),
    "user.username": ("user", "username"),
    "user.ip": ("user", "ip_address"),
    "http.method": ("request", "method"),
    "http.url": ("request", "url"),
    "http.query": ("request", "query_string"),
    "http.cookies": ("request", "cookies"),
    "http.environment": ("request", "env"),
    "http.headers": ("request", "headers"),
    "http.body": ("request", "data"),
    "trace_id": ("contexts", "trace", "trace_id"),
    "span_id": ("contexts", "trace", "span_id"),
    "parent_span_id": ("contexts", "trace", "parent_span_id"),
    "trace.op": ("contexts", "trace", "op"),
    "trace.status": ("contexts", "trace", "status"),
}
FROM_ENVELOPE_TRACE = ("trace_id", "environment", "release")
FROM_SDK_ATTRIBUTE = "level logger transaction platform environment release dist".split()
FROM_ATTRIBUTE = {"logger": "logger.name", "server": "server.address"}
FRAME_NAMES = {
    "filename": "filename",
    "path": "abs_path",
    "module": "module",
    "function": "function",
    "line": "lineno",
    "column": "colno",
    "in_app": "in_app",
    "context_line": "context_line",
    "pre_context": "pre_context",
    "post_context": "post_context",
    "variables": "vars",
}
STACK_FIELDS = ("filename", "function", "module")

UUID = (
    r"^(urn:uuid:)?(\{?)([0-9a-fA-F]{32}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(\}?)$"
)


# --- parsing and validation ---------------------------------------------------

def parsed(envelopes: DataFrame) -> DataFrame:
    """Framed envelopes with parsed headers and payloads (``envelope``, ``items``)."""
    items = F.transform(
        "items",
        lambda item, i: F.struct(
            i.alias("index"),
            F.try_parse_json(item["header"]).alias("header"),
            F.try_parse_json(item["payload"]).alias("body"),
            F.octet_length(item["payload"]).alias("size"),
        ),
    )
    return staged(envelopes, items=items, envelope=F.try_parse_json("header"))


def item_kind(item: Column) -> Column:
    return V.as_string(V.get(item["header"], "type"))


def uuid_text(value: Column) -> Column:
    """UUID in any usual spelling -> 32 lowercase digits; NULL when it is none."""
    return F.when(value.rlike(UUID), F.translate(F.regexp_replace(value, "^urn:uuid:|[^0-9a-fA-F]", ""), "ABCDEF", "abcdef"))


def event_time(value: Column, received_at_ms: Column) -> Column:
    """Event time in ns: seconds as a number, RFC 3339 text, else the arrival time."""
    given = F.coalesce(S.seconds_to_nano(V.as_double(value)), S.rfc3339_nano(V.as_string(value)))
    return F.when(value.isNull(), received_at_ms * 1_000_000).otherwise(given)


def valid_time(value: Column) -> Column:
    return once(value, lambda given: given.isNull() | event_time(given, F.lit(0)).isNotNull())


def valid_event(item: Column, envelope: Column) -> Column:
    """JSON object with one event id (UUID) in envelope and payload, and a valid time."""
    texts = F.array(*[V.as_string(V.get(owner, "event_id")) for owner in (envelope, item["body"])])
    given = F.transform(F.filter(texts, lambda text: text.isNotNull()), uuid_text)
    same = once(given, lambda found: (F.size(found) > 0) & F.forall(found, lambda one: one == F.get(found, F.lit(0))))
    return V.is_object(item["body"]) & same & valid_time(V.get(item["body"], "timestamp"))


def valid_telemetry(entry: Column, kind: Column) -> Column:
    """Rules of one log or metric entry inside a batch item."""
    text = lambda name: V.as_string(V.get(entry, name))
    log = text("level").isin(*S.LEVELS) & text("body").isNotNull()
    metric = (
        text("name").isNotNull()
        & V.as_double(V.get(entry, "value")).isNotNull()
        & text("type").isin(*METRIC_KINDS)
    )
    common = V.is_object(entry) & valid_time(V.get(entry, "timestamp")) & text("trace_id").isNotNull()
    return F.coalesce(common & F.when(kind == "log", log).otherwise(metric), F.lit(False))


def valid_batch(item: Column) -> Column:
    """``items`` is an array of valid entries, as many as ``item_count`` says."""
    kind = item_kind(item)
    listed = V.array_or_none(V.get(item["body"], "items"))
    declared = V.as_bigint(V.get(item["header"], "item_count"))
    return once(listed, lambda entries: (declared == F.size(entries)) & F.forall(entries, lambda e: valid_telemetry(e, kind)))


def valid_item(item: Column, envelope: Column) -> Column:
    kind = item_kind(item)
    known = F.when(kind == "event", valid_event(item, envelope)).otherwise(valid_batch(item))
    fits = item["size"] <= MAX_ITEM_BYTES
    good = kind.isNotNull() & (~kind.isin(*SIGNAL_OF_KIND) | (fits & known))
    return F.coalesce(good, F.lit(False))


def validate_envelopes(envelopes: DataFrame) -> DataFrame:
    """Parsed envelopes with ``valid``: false as soon as any part is malformed."""
    envelope = F.col("envelope")
    good = (
        F.col("frame_error").isNull()
        & V.is_object(envelope)
        & F.forall("items", lambda item: valid_item(item, envelope))
    )
    return staged(parsed(envelopes), valid=F.coalesce(good, F.lit(False)))


def rejects(envelopes: DataFrame) -> DataFrame:
    """(project_id, reason) rows: malformed envelopes, and items of unknown kind."""
    checked = validate_envelopes(envelopes)
    bad = checked.filter(~F.col("valid")).select("project_id", F.lit(MALFORMED).alias("reason"))
    unknown = checked.filter("valid").select("project_id", F.explode("items").alias("item"))
    unknown = unknown.select("project_id", item_kind(F.col("item")).alias("reason")).filter(
        ~F.col("reason").isin(*SIGNAL_OF_KIND)
    )
    return bad.unionByName(unknown)


# --- exceptions and issue identity --------------------------------------------

def _exceptions(raw: Column) -> Column:
    return V.array_or_empty(V.get(raw, "exception", "values"))


def last_exception(raw: Column) -> Column:
    """The primary exception: the last of the chain; NULL when there is none."""
    return F.try_element_at(_exceptions(raw), F.lit(-1))


def frames_of(owner: Column) -> Column:
    return V.array_or_empty(V.get(owner, "stacktrace", "frames"))


def normalize_exceptions(raw: Column, chain: Column | None = None) -> Column:
    """Exception chain, primary first, in short names; else the top-level stack trace.

    VARIANT array, NULL when there is neither.  ``chain`` is the chain if it is at hand.
    """

    def frames(owner: Column) -> Column:
        listed = V.array_or_none(V.get(owner, "stacktrace", "frames"))
        renamed = F.transform(
            listed,
            lambda frame: V.field_map(*[(name, V.get(frame, key)) for name, key in FRAME_NAMES.items()]),
        )
        return F.to_variant_object(renamed)

    def exception(value: Column) -> Column:
        return V.field_map(
            ("type", V.get(value, "type")),
            ("module", V.get(value, "module")),
            ("message", V.get(value, "value")),
            ("mechanism", V.get(value, "mechanism", "type")),
            ("handled", V.of(V.as_bool(V.get(value, "mechanism", "handled")))),
            ("frames", frames(value)),
        )

    chain, top = _exceptions(raw) if chain is None else chain, frames_of(raw)
    top_level = V.field_map(("type", V.of(F.lit("Stacktrace"))), ("frames", frames(raw)))
    listed = F.when(F.size(chain) > 0, F.transform(F.reverse(chain), exception)).when(
        F.size(top) > 0, F.array(top_level)
    )
    return F.to_variant_object(listed)


def all_frames(raw: Column, chain: Column | None = None) -> Column:
    """Frames of all exceptions, then of the top-level stack."""
    chain = _exceptions(raw) if chain is None else chain
    return F.concat(F.flatten(F.transform(chain, frames_of)), frames_of(raw))


def stack_values(raw: Column, name: str, frames: Column | None = None) -> Column:
    """One frame field over all exceptions and the top-level stack; NULL when empty."""
    values = F.transform(all_frames(raw) if frames is None else frames, lambda frame: V.get(frame, name))
    present = F.filter(values, lambda value: value.isNotNull())
    return F.to_variant_object(once(present, lambda found: F.when(F.size(found) > 0, found)))


def message_of(raw: Column, exception: Column | None = None) -> Column:
    """Message precedence: message, its formatted form, log entry, exception value."""
    exception = last_exception(raw) if exception is None else exception
    return F.coalesce(
        V.as_string(V.get(raw, "message")),
        V.as_string(V.get(raw, "message", "formatted")),
        V.as_string(V.get(raw, "logentry", "formatted")),
        V.as_string(V.get(raw, "logentry", "message")),
        V.as_string(V.get(exception, "value")),
    )


def title_of(raw: Column, exception: Column | None = None) -> Column:
    exception = last_exception(raw) if exception is None else exception
    kind = V.as_string(V.get(exception, "type"))
    value = V.as_string(V.get(exception, "value"))
    with_value = F.concat(kind, F.lit(": "), value)
    return F.coalesce(with_value, kind, message_of(raw, exception), F.lit("Error"))


def fingerprint_of(raw: Column, title: Column, exception: Column | None = None) -> Column:
    """Issue fingerprint: the explicit parts; else type and last in-app frame; else the
    unformatted message; else the title."""
    parts = F.transform(
        F.filter(V.array_or_empty(V.get(raw, "fingerprint")), V.is_string), V.as_string
    )
    explicit = F.nullif(F.concat_ws("\0", parts), F.lit(""))
    exception = last_exception(raw) if exception is None else exception
    in_app = lambda f: F.coalesce(V.as_bool(V.get(f, "in_app")), F.lit(False))
    last = lambda listed: F.try_element_at(listed, F.lit(-1))
    frame = once(frames_of(exception), lambda frames: F.coalesce(last(F.filter(frames, in_app)), last(frames)))
    place = lambda f: [F.coalesce(V.as_string(V.get(f, name)), F.lit("")) for name in ("module", "function", "filename")]
    kind = V.as_string(V.get(exception, "type"))
    by_frame = once(frame, lambda f: F.when(kind.isNotNull() & f.isNotNull(), F.concat_ws("\0", kind, *place(f))))
    plain = V.as_string(F.coalesce(V.get(raw, "logentry", "message"), V.get(raw, "message")))
    return F.coalesce(explicit, by_frame, plain, title)


# --- canonical fields ------------------------------------------------------------

def _tags(raw: Column) -> Column:
    tags = V.get(raw, "tags")
    listed = F.filter(
        F.transform(V.array_or_empty(tags), V.array_or_none),
        lambda pair: F.coalesce((F.size(pair) >= 2) & V.is_string(F.get(pair, 0)), F.lit(False)),
    )
    of_pairs = V.map_of_pairs(
        F.transform(
            listed,
            lambda pair: F.struct(
                V.as_string(F.get(pair, 0)).alias("key"), F.get(pair, 1).alias("value")
            ),
        )
    )
    return F.when(V.is_object(tags), V.object_or_empty(tags)).otherwise(of_pairs)


def _attributes(raw: Column) -> Column:
    given = V.object_or_empty(V.get(raw, "attributes"))
    return F.transform_values(given, lambda _, value: F.coalesce(V.get(value, "value"), value))


def with_canonical_fields(rows: DataFrame) -> DataFrame:
    """Add ``_fields`` (MAP<STRING, VARIANT>) to rows of (signal, raw VARIANT, envelope)."""
    raw, envelope = F.col("raw"), F.col("envelope")
    signal = F.col("signal")
    error = signal == "error"
    # What several fields are taken from is computed once per row.
    rows = staged(rows, _tags=_tags(raw), _attributes=_attributes(raw), _chain=F.when(error, _exceptions(raw)))
    chain, exception = F.col("_chain"), F.col("_exception")
    rows = staged(
        rows, _own=V.merge(F.col("_tags"), F.col("_attributes")), _frames=F.when(error, all_frames(raw, chain)),
        _exception=F.try_element_at("_chain", F.lit(-1)),
    )
    rows = staged(rows, _message=F.when(error, message_of(raw, exception)), _title=F.when(error, title_of(raw, exception)))
    own, title = F.col("_own"), F.col("_title")

    sources: dict[str, list[Column]] = {name: [V.get(raw, name)] for name in TOP_LEVEL}
    sources["server"] = [V.get(raw, "server_name")]
    for name, keys in POINTERS.items():
        sources.setdefault(name, []).append(V.get(raw, *keys))
    for name in FROM_ENVELOPE_TRACE:
        sources[name].append(V.get(envelope, "trace", name))
    for name in FROM_SDK_ATTRIBUTE:
        sources[name].append(own[f"sentry.{name}"])
    for name, attribute in FROM_ATTRIBUTE.items():
        sources[name].append(own[attribute])
    for name in ("name", "version"):
        sources[f"sdk.{name}"] = [
            V.get(raw, "sdk", name), V.get(envelope, "sdk", name), own[f"sentry.sdk.{name}"]
        ]
    fixed = {name: F.coalesce(*values) for name, values in sources.items()}

    counter = V.as_string(V.get(raw, "type")) == "counter"
    body = V.get(raw, "body")
    by_signal = {
        "error": {
            "message": V.of(F.col("_message")),
            "title": V.of(title),
            "issue.title": V.of(title),
            "issue.fingerprint": V.of(fingerprint_of(raw, title, exception)),
            "name": V.get(raw, "transaction"),
            "error.type": V.get(exception, "type"),
            "error.value": V.get(exception, "value"),
            "error.handled": V.of(V.as_bool(V.get(exception, "mechanism", "handled"))),
            "level": F.coalesce(fixed["level"], V.of(F.lit("error"))),
            "error.exceptions": normalize_exceptions(raw, chain),
            "breadcrumbs": V.get(raw, "breadcrumbs", "values"),
            **{f"stack.{name}": stack_values(raw, name, F.col("_frames")) for name in STACK_FIELDS},
        },
        "log": {"message": body, "title": body},
        "metric": {
            **{name: V.get(raw, name) for name in ("name", "unit", "value")},
            **counter_to_sum(counter, V.get(raw, "type")),
        },
    }
    special = F.when(error, V.field_map(*by_signal["error"].items())).when(
        signal == "log", V.field_map(*by_signal["log"].items())
    ).otherwise(V.field_map(*by_signal["metric"].items()))

    contexts = F.map_filter(
        V.object_or_empty(V.get(raw, "contexts")), lambda name, _: name != "trace"
    )
    families = [
        V.prefix_keys(V.object_or_empty(V.get(raw, "sdk")), "sdk."),
        V.prefix_keys(V.object_or_empty(V.get(envelope, "sdk")), "sdk."),
        V.prefix_keys(V.object_or_empty(V.get(raw, "user")), "user."),
        V.prefix_keys(V.object_or_empty(V.get(raw, "contexts", "trace")), "trace."),
        V.prefix_keys(contexts, "context."),
        V.prefix_keys(F.col("_tags"), "tag."),
        V.prefix_keys(own, "attribute."),
    ]
    fields = V.merge(special, V.field_map(*fixed.items()), *families)
    parts = ["_tags", "_attributes", "_own", "_chain", "_frames", "_exception", "_message", "_title"]
    return staged(rows, _fields=fields).drop(*parts)


def counter_to_sum(is_counter: Column, kind: Column) -> dict[str, Column]:
    """A counter is a monotonic delta sum; other metric kinds keep their type."""
    is_counter = F.coalesce(is_counter, F.lit(False))
    return {
        "type": F.when(is_counter, V.of(F.lit("sum"))).otherwise(kind),
        "temporality": F.when(is_counter, V.of(F.lit("delta"))),
        "monotonic": F.when(is_counter, V.of(F.lit(True))),
    }


def promote(rows: DataFrame) -> DataFrame:
    """Move fields of ``_fields`` that have their promoted type into columns."""
    fields = F.col("_fields")
    typed = rows.withColumns(
        {column: V.typed(fields[name], kind) for name, (column, kind) in PROMOTED.items()}
    )
    # Each field is asked for itself: a list of the moved ones would be made anew for every field.
    kinds = F.create_map(*[F.lit(text) for name, (_, kind) in PROMOTED.items() for text in (name, kind)])

    def moved(name: Column, value: Column) -> Column:
        fits = [F.when(kinds[name] == kind, V.has_type(value, kind)) for kind in sorted({k for _, k in PROMOTED.values()})]
        return F.coalesce(*fits, F.lit(False))

    kept = F.map_filter("_fields", lambda name, value: ~moved(name, value))
    return conform(typed.withColumn("fields", F.to_variant_object(kept)))


# --- records -----------------------------------------------------------------------

def _accepted(envelopes: DataFrame) -> DataFrame:
    rows = validate_envelopes(envelopes).filter("valid")
    return rows.select("project_id", "received_at_ms", "envelope", F.explode("items").alias("item"))


def _entries(envelopes: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per event and per batch entry of the wanted item kinds, in one pass."""
    item, kind = F.col("item"), F.col("_kind")
    items = staged(_accepted(envelopes), _kind=item_kind(item)).filter(kind.isin(kinds))
    listed = F.when(kind == "event", F.array(item["body"])).otherwise(
        V.array_or_empty(V.get(item["body"], "items"))
    )
    rows = staged(items, _listed=listed)
    rows = rows.select("*", F.posexplode("_listed").alias("_position", "raw")).drop("_listed")
    identity = F.struct(
        "envelope", item["header"].alias("header"), item["index"].alias("index"), "_position", "raw"
    )
    event_id = F.coalesce(
        uuid_text(V.as_string(V.get(F.col("envelope"), "event_id"))),
        uuid_text(V.as_string(V.get(F.col("raw"), "event_id"))),
    )
    entry_id = ids.uuid5(ids.BATCH_NAMESPACE, F.to_json(identity))
    signal = F.when(kind == "event", "error").when(kind == "log", "log").otherwise("metric")
    return rows.select(
        "project_id", "received_at_ms", "envelope", "raw",
        F.when(kind == "event", event_id).otherwise(entry_id).alias("id"),
        signal.alias("signal"),
    )


def _records(rows: DataFrame) -> DataFrame:
    time = event_time(V.get(F.col("raw"), "timestamp"), F.col("received_at_ms"))
    rows = with_canonical_fields(rows.withColumns({"ts_nano": time, "source": F.lit(SOURCE)}))
    rows = rows.withColumns({"source_id": F.col("id"), "raw": F.to_json("raw")})
    return promote(rows)


def events_to_errors(envelopes: DataFrame) -> DataFrame:
    """Event items of valid envelopes as error records."""
    return _records(_entries(envelopes, ["event"]))


def explode_items(envelopes: DataFrame, kind: str | None = None) -> DataFrame:
    """Entries of log and metric batch items as records ('log', 'trace_metric' or both)."""
    return _records(_entries(envelopes, ["log", "trace_metric"] if kind is None else [kind]))


def envelope_records(envelopes: DataFrame) -> DataFrame:
    """All records of valid envelopes."""
    return _records(_entries(envelopes, list(SIGNAL_OF_KIND)))
