"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
#: The offset basis (as the display code has it) and prime of the 64-bit hash.
FNV_BASIS, FNV_PRIME = 1469598103934665603, 1099511628211


def iso_micros(text: Column) -> Column:
    """Epoch microseconds of a date and time with a zone; anything else is null."""
    return F.when(text.rlike(_TIME), F.unix_micros(F.try_to_timestamp(text)))


def strict_int(variant: Column, path: str) -> Column:
    """The integer at a path of a VARIANT: 12 and 12.0 are, "12", 12.5 and true aren't."""
    value = F.try_variant_get(variant, path, "variant")
    number = F.try_variant_get(value, "$", "double")
    whole = F.try_variant_get(value, "$", "bigint")
    return F.when(~F.schema_of_variant(value).isin("STRING", "BOOLEAN", "VOID") & (number == whole.cast("double")), whole)


def variant_kind(value: Column) -> Column:
    """The type name of a VARIANT."""
    return F.schema_of_variant(value)


def variant_text(value: Column) -> Column:
    """The text of a VARIANT that is one, else null."""
    return F.when(variant_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def variant_number(value: Column) -> Column:
    """A number, or the number that a text writes out."""
    text = variant_text(value)
    return F.when(text.isNull(), F.try_variant_get(value, "$", "double")).when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def variant_integer(value: Column) -> Column:
    """A whole number, or the digits of one in a text."""
    text = variant_text(value)
    number = F.try_variant_get(value, "$", "double")
    return F.when(text.isNull(), F.when(number == F.floor(number), F.try_variant_get(value, "$", "bigint"))).when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def lenient_number(text: Column) -> Column:
    return text.try_cast("double")


def nanos_to_micros(text: Column) -> Column:
    """Whole microseconds, by whole division: a double has too few digits."""
    return F.call_function("div", text.try_cast("bigint"), F.lit(1000).cast("bigint"))


def number_text(x: Column) -> Column:
    """Whole numbers without decimals, others with one."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", x.cast("double")))


def compact_text(x: Column) -> Column:
    """Thousands with a k."""
    return F.when(x >= 1000, F.concat(number_text(F.round(x / 1000.0, 1)), F.lit("k"))).otherwise(number_text(x))


def age_text(seconds: Column, retained: Column | None = None) -> Column:
    s = F.floor(seconds).cast("bigint")
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
    return text if retained is None else F.when(retained, F.concat(text, F.lit(" · Retained"))).otherwise(text)


def utc_text(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normal_key(key: Column) -> Column:
    return F.translate(F.lower(key), "-. ", "___")


def bounded_identity(text: Column) -> Column:
    return (F.octet_length(text) <= 256) & ~text.rlike(r"[\x00-\x1F\x7F]")


def short_label(text: Column) -> Column:
    return F.when(F.length(text) <= 8, text).otherwise(F.concat(F.substring(text, 1, 7), F.lit("...")))


def file_identity(path: Column) -> Column:
    """The id in rollout-<stamp>-<id>.jsonl, else the name of a .jsonl file; null for others.
    A folder of that name with part files in it, as Spark lands a log, counts as the file."""
    name = F.regexp_extract(path, r"([^/=]*)\.jsonl(?:/part-[^/]*)?$", 1)
    rollout = F.regexp_extract(name, r"^rollout-.{20}([^_]+)", 1)
    return F.when(name == "", None).when(rollout != "", rollout).when(~name.startswith("rollout-"), name)


def prefix_fingerprint(content: Column, offset: Column) -> Column:
    """SHA-256 of the first 64 KiB before an offset and of the last, where they don't overlap."""
    block = F.lit(65_536)
    start = F.greatest(block, offset - block)
    head = F.substring(content, F.lit(1), F.least(block, offset).cast("int"))
    tail = F.substring(content, (start + 1).cast("int"), F.greatest(F.lit(0), offset - start).cast("int"))
    return F.sha2(F.concat(head, tail), 256)


def fnv_slot(text: Column | str, slots: Column | str) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes modulo a number of slots, null of null. Products
    are taken as decimals, which hold 64 times 41 bits, and cut to 64 bits."""
    text, slots = (F.col(c) if isinstance(c, str) else c for c in (text, slots))
    shown = F.hex(F.encode(text, "UTF-8"))
    word = lambda x: x.cast("decimal(20,0)")

    def step(h: Column, i: Column) -> Column:
        low, byte = (h % 256).cast("int"), F.conv(shown.substr(2 * i - 1, F.lit(2)), 16, 10).cast("int")
        mixed = word(h - low.cast("decimal(20,0)") + low.bitwiseXOR(byte).cast("decimal(20,0)"))
        return word(mixed * F.lit(FNV_PRIME).cast("decimal(13,0)") % F.lit(str(1 << 64)).cast("decimal(20,0)"))

    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).when(text.isNotNull(), F.array().cast("array<int>"))
    return (F.aggregate(places, F.lit(FNV_BASIS).cast("decimal(20,0)"), step) % slots.cast("decimal(20,0)")).cast("bigint")
