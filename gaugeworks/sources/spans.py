"""Request spans from OTLP/JSON bodies: flattened, checked, and taken or refused batch by
batch. Bodies come as rows (batch_id, body, received_us), however they were landed; they
are read as VARIANT, so types and the shape of attributes count as they were sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import bounded_identity, nanos_to_micros, normal_key, variant_integer, variant_kind, variant_number, variant_text

SPAN = "claude_code.llm_request"
MOST_SPANS, MOST_BYTES = 32, 1 << 20
#: Aliases of each field in order of preference.
ALIASES = {
    "model": ["gen_ai.request.model", "model", "gen_ai.response.model"],
    "duration_ms": ["duration_ms"],
    "ttft_ms": ["ttft_ms"],
    "output": ["output_tokens", "gen_ai.usage.output_tokens"],
    "request_id": ["request_id", "gen_ai.response.id", "client_request_id"],
    "attempt": ["attempt"],
}
#: Parts of key names that tell of content or credentials; no body that has
#: such a key is taken.
SENSITIVE = [
    "prompt", "user_prompt", "source code", "source_code", "tool.input", "tool.output", "tool.params",
    "tool.result", "request.body", "response.body", "raw request", "raw_request", "raw response",
    "raw_response", "credential", "authorization", "api_key", "api key", "file.path",
    "file_path", "file.content", "file_content", "message.content", "message_content", "raw_body",
    "path", "content",
]
#: Further attributes that a target span may have; they are not kept.
IGNORED = [
    "span.type", "gen_ai.system", "query_source", "agent_id", "parent_agent_id", "speed",
    "llm_request.context", "input_tokens", "cache_read_tokens", "cache_creation_tokens", "success",
    "status_code", "error", "response.has_tool_call", "stop_reason", "gen_ai.response.finish_reasons",
    "session.id", "app.version", "app.entrypoint", "organization.id", "user.account_uuid", "user.account_id",
    "user.id", "user.email", "terminal.type", "user.groups", "identity.source", "workflow.run_id", "workflow.name",
]
ALLOWED = [k for keys in ALIASES.values() for k in keys] + IGNORED
_MAP = "map<string,variant>"


def sensitive(doc: Column) -> Column:
    """Whether any "key" at any depth of a parsed body has a sensitive name. The body is
    written anew from its VARIANT, which leaves no escaped letters and no blanks."""
    keys = F.regexp_extract_all(F.to_json(doc), F.lit(r'(?<!\\)"key":"((?:[^"\\]|\\.)*)"'), F.lit(1))
    parts = "|".join(sorted({p.replace(".", "_").replace(" ", "_") for p in SENSITIVE}))
    return F.exists(F.array_distinct(keys), lambda k: normal_key(k).rlike(f"{parts}|^(code|auth)$|^auth_|_auth$"))


def _object(value: Column) -> Column:
    """Whether a VARIANT is an object. Its type's name would tell, but that is made of the types
    of all that the object holds, at every level anew."""
    return F.try_variant_get(value, "$", _MAP).isNotNull()


def _objects(value: Column, path: str) -> Column:
    """The objects of the array at a path; null if it is no array of objects."""
    found = F.try_variant_get(value, path, "array<variant>")
    return F.when(F.forall(found, _object), found)


def _each(df: DataFrame, found: Column, place: str, name: str) -> DataFrame:
    """A row for each element with its place; one row with nulls where there is none."""
    return df.select("*", F.posexplode_outer(found).alias(place, name))


def _judged(bodies: DataFrame) -> DataFrame:
    """(batch_id, place, code, fields...): of each body what its spans come to, in their order;
    code is null for a span that makes a request and for a body without target spans."""
    if "received_us" not in bodies.columns:
        bodies = bodies.withColumn("received_us", F.lit(None).cast("bigint"))
    read = bodies.select("batch_id", "received_us", (F.octet_length("body") > MOST_BYTES).alias("large"), F.try_parse_json("body").alias("doc"))
    read = read.withColumn("resources", F.when(_object(F.col("doc")), _objects(F.col("doc"), "$.resourceSpans")))
    whole = F.when(F.col("large"), "REJECTED_BATCH_SIZE").when(F.col("resources").isNull(), "INVALID_OTLP_JSON").when(sensitive(F.col("doc")), "REJECTED_CONTENT_FIELD")
    told = read.select("batch_id", "received_us", whole.alias("whole"), F.when(whole.isNull(), F.col("resources")).alias("resources"))

    rows = _each(told, F.col("resources"), "i", "resource").withColumn("scopes", _objects(F.col("resource"), "$.scopeSpans"))
    rows = _each(rows, F.col("scopes"), "j", "scope").withColumn("spans", _objects(F.col("scope"), "$.spans"))
    rows = _each(rows, F.col("spans"), "k", "span")
    trace = (F.col("i").isNotNull() & F.col("scopes").isNull()) | (F.col("j").isNotNull() & F.col("spans").isNull())
    target = F.coalesce(variant_text(F.try_variant_get("span", "$.name", "variant")) == SPAN, F.lit(False))
    place = F.struct(*[F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in "ijk"])
    rows = rows.where(F.col("whole").isNotNull() | trace | target).select("batch_id", "received_us", "whole", place.alias("place"), trace.alias("trace"), target.alias("target"), "span", _objects(F.col("span"), "$.attributes").alias("attributes"))

    # Each attribute is read once, and its fields are taken before the shuffle: a VARIANT of a part has the names of its whole body with it.
    rows = rows.withColumn("entries", F.transform("attributes", lambda a: F.try_variant_get(a, "$", _MAP)))
    listed = F.forall("entries", lambda e: (F.size(e) == 2) & (variant_kind(e["key"]) == "STRING") & F.map_contains_key(e, "value") & variant_text(e["key"]).isin(*ALLOWED))
    rows = rows.withColumn("listed", listed)
    pairs = F.transform("entries", lambda e: F.struct(variant_text(e["key"]).alias("key"), F.map_values(F.try_variant_get(e["value"], "$", _MAP)).alias("values")))
    rows = rows.withColumn("pairs", F.when(F.col("listed"), pairs))
    single = F.forall("pairs", lambda p: F.coalesce(F.size(p["values"]) == 1, F.lit(False))) & (F.size(F.array_distinct("pairs.key")) == F.size("pairs"))

    def having(name: str) -> Column:
        return F.get(F.get("pairs.values", F.array_position("pairs.key", name).cast("int") - 1), F.lit(0))

    named = {k: f"__{i}" for i, k in enumerate(k for keys in ALIASES.values() for k in keys)}
    rows = rows.withColumns({c: having(k) for k, c in named.items()})
    held = lambda field: [F.col(named[k]) for k in ALIASES[field]]
    text = lambda field: F.coalesce(*map(variant_text, held(field)))
    fields = rows.select(
        "batch_id", "place", "whole", "trace", "target", F.col("attributes").isNotNull().alias("attributes"), "listed", F.coalesce(single, F.lit(False)).alias("single"),
        text("request_id").alias("request_id"), text("model").alias("model_raw"), variant_number(*held("duration_ms")).alias("duration_ms"), variant_number(*held("ttft_ms")).alias("ttft_ms"),
        variant_integer(F.coalesce(*held("output"))).alias("output_total"), variant_integer(*held("attempt")).alias("attempt"),
        F.coalesce(nanos_to_micros(F.try_variant_get("span", "$.endTimeUnixNano", "string")), F.col("received_us")).alias("observed_us"),
    )
    fields = fields.withColumn("nth", F.sum(F.col("target").cast("int")).over(Window.partitionBy("batch_id").orderBy("place")))
    made = (F.col("request_id") != "") & (F.col("model_raw") != "") & (F.col("duration_ms") > 0) & F.col("ttft_ms").between(F.lit(0), F.col("duration_ms")) & (F.col("output_total") >= 0) & (F.col("attempt") >= 1)
    code = (
        F.when(F.col("whole").isNotNull(), F.col("whole")).when(F.col("trace"), "UNSUPPORTED_REQUEST_TRACE").when(F.col("nth") > MOST_SPANS, "REJECTED_BATCH_SIZE")
        .when(~F.col("attributes"), "INVALID_REQUEST_FIELDS").when(~F.coalesce("listed", F.lit(False)), "REJECTED_UNALLOWLISTED_FIELD")
        .when(~F.col("single") | ~F.coalesce(made, F.lit(False)), "INVALID_REQUEST_FIELDS").when(~(bounded_identity(F.col("request_id")) & bounded_identity(F.col("model_raw"))), "REJECTED_FIELD_VALUE")
    )
    return fields.withColumn("code", code)


def decoded(bodies: DataFrame) -> DataFrame:
    """Performance facts of the batches whose every target span makes a request; one that
    doesn't refuses its batch. A span without an end took place when it was received. Bodies
    are bounded, so the verdict is a window over one batch's few spans."""
    told = _judged(bodies).withColumn("refused", F.max(F.col("code").isNotNull()).over(Window.partitionBy("batch_id")))
    kept = told.where(~F.col("refused") & F.col("target"))
    start = F.col("observed_us") - F.round(F.col("duration_ms") * 1000).cast("bigint")
    return kept.select("batch_id", "request_id", "model_raw", "observed_us", start.alias("range_start_us"), "duration_ms", "ttft_ms", "output_total", (F.col("attempt") > 1).alias("is_retry"))


def rejections(bodies: DataFrame) -> DataFrame:
    """(batch_id, code) of the batches that are refused: the first reason in the order in which
    a body is read. A body without target spans is taken and gives no fact."""
    found = F.when(F.col("code").isNotNull(), F.struct("place", "code"))  # a filter on the code would be pushed down and read each attribute anew for every use
    return _judged(bodies).groupBy("batch_id").agg(F.min(found).alias("f")).where("f IS NOT NULL").select("batch_id", F.col("f.code").alias("code"))
