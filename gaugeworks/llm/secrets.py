"""Secret scan with corpus-wide ownership frequency.

A task finds the base spans (assigned values, access keys, hexadecimal runs) and, as
further candidates, bare tokens: whatever could stand in an assignment, whole and split at
'=' and '.'. A first pass over the texts leaves a sieve of the values that stand in a base
span or are random enough alone; only tokens that pass it are kept. Every candidate value is
hashed, without '.' and '=' at its end; per hash the corpus gives the number of distinct
repositories and owners. A value seen with more than `max_owners` owners, or in more than
`max_repositories` repositories, is a widely copied example; one seen with few, and that either stands in a base span somewhere or is random enough by itself, is
owner-specific and live-looking: every bare occurrence of it becomes a span too.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import fresh, materialize, sieve, sifted, slices, text_key

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A bare token: a run of what a value may hold. Between full stops it is random enough by
#: itself from this many bits a character and characters, with both cases and a digit.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_DIGIT = re.compile(r"[0-9]")
ENTROPY, ENTROPY_CHARS = 3.5, 24
MAX_OWNERS, MAX_REPOSITORIES = 3, 8
_CANDIDATES = "array<struct<hash:binary,kind:string,start:int,stop:int,alike:boolean>>"
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, value) of the base kinds, leftmost and non-overlapping in each."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found + [("hex", m.start(), m.end(), m[0]) for m in _LONG_HEX.finditer(text)]


def random_enough(value: str) -> bool:
    if len(value) < ENTROPY_CHARS or value.lower() == value or value.upper() == value or not _DIGIT.search(value):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= ENTROPY


def bare(token: str) -> Iterator[tuple[int, int]]:
    """Places in a token of what may be a value of its own: between any two of its ends, '='
    and '.' that are next to each other, next among their kind, or the token's ends."""
    if "=" not in token and "." not in token:
        yield 0, len(token)
        return
    cuts = {(0, len(token))}
    for marks in ("=", ".", "=."):
        at = 0
        for i, c in enumerate(token + marks[0]):
            if c in marks:
                cuts.add((at, i))
                at = i + 1
    for a, z in sorted(cuts):
        if len(token[a:z].rstrip(".=")) >= LEAST["assign"]:
            yield a, z - (len(token[a:z]) - len(token[a:z].rstrip(".")))


def value_hash(value: str) -> bytes:
    return hashlib.blake2b(value.rstrip(".=").encode(), digest_size=16).digest()


def _place(value: bytes) -> int:
    return int.from_bytes(value[:4], "little")


def candidates(text: str, known: bytes | None = None) -> list[tuple[bytes, str, int, int, bool]]:
    """(hash of the value, kind, start, stop, whether it is live-looking by itself); of the
    bare ones those that are, and those that are in the sieve `known`."""
    found = [(value_hash(value), kind, a, z, True) for kind, a, z, value in base_spans(text)]
    more = {}
    for m in TOKEN.finditer(text):
        for a, z in bare(m[0]):
            value, start = m[0][a:z], m.start() + a
            alike = "." not in value and random_enough(value)
            if alike or known is not None:
                more[value_hash(value), start] = ("bare", start, start + len(value), alike)
    if known is not None and more:
        near = sifted(known, np.array([_place(h) for h, _ in more], np.int64))
        more = {k: v for (k, v), x in zip(more.items(), near, strict=True) if x or v[3]}
    return found + [(h, *rest) for (h, _), rest in more.items()]


def scan(docs: DataFrame, text_col: str = "text", repository: Column | None = None, owner: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, repository, owner, row and candidates of every row, written out;
    row tells rows apart for good, even where all their columns agree. Bare candidates are
    those whose value may be live."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            found = {_place(c[0]) for t in b.column("__text") if t.is_valid for c in candidates(t.as_py())}
            yield pa.record_batch([pa.array(sorted(found), pa.int64())], ["place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            found = [[dict(zip(("hash", "kind", "start", "stop", "alike"), c, strict=True)) for c in candidates(t.as_py(), known.value)] if t.is_valid else [] for t in b.column("__text")]
            kind = pa.list_(pa.struct([("hash", pa.binary()), ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("alike", pa.bool_())]))
            names = [n for n in b.schema.names if n != "__text"]
            yield pa.record_batch([*[b.column(n) for n in names], pa.array(found, kind)], [*names, "candidates"])

    rows = docs.select(*keep, repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.col(text_col).cast("string").alias("__text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    known = sieve(materialize(rows.select("__text").mapInArrow(places, "place long").distinct(), "secrets-places"))
    found = rows.mapInArrow(run, ", ".join([*kept, f"candidates {_CANDIDATES}"]))
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(hash, repositories, owners, occurrences, verdict: example or live or other). A null
    repository or owner counts as one of its own. Distinct pairs are combined before they
    meet, so a widely copied value costs its distinct owners and not its occurrences."""
    each = scanned.select("repository", "owner", F.inline("candidates"))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    pairs = each.groupBy("hash", known("repository").alias("r"), known("owner").alias("o")).agg(F.count("*").alias("n"), F.bool_or("alike").alias("alike"))
    repositories = pairs.groupBy("hash", "r").agg(F.sum("n").alias("n"), F.bool_or("alike").alias("alike")).groupBy("hash").agg(F.count("*").alias("repositories"), F.sum("n").alias("occurrences"), F.bool_or("alike").alias("alike"))
    owners = pairs.groupBy("hash", "o").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("owners"))
    verdict = F.when((F.col("owners") > max_owners) | (F.col("repositories") > max_repositories), "example").when(F.col("alike"), "live").otherwise("other")
    return repositories.join(owners, "hash").select("hash", "repositories", "owners", "occurrences", verdict.alias("verdict"))


def cleared(found: list[dict]) -> list[dict]:
    """Spans in order of start, without the owned ones that meet a base span or lie within
    another owned one: one pass over the sorted ends of each kind."""
    base = sorted((x["start"], x["stop"]) for x in found if x["kind"] != "owned")
    starts, upto, most = [a for a, _ in base], [], 0
    for _, stop in base:
        most = max(most, stop)
        upto.append(most)
    held, most = set(), -1
    for start, stop in sorted({(x["start"], x["stop"]) for x in found if x["kind"] == "owned"}, key=lambda x: (x[0], -x[1])):
        before = bisect.bisect_left(starts, stop)
        if stop <= most or (before and upto[before - 1] > start):
            held.add((start, stop))
        most = max(most, stop)
    return [x for x in found if x["kind"] != "owned" or (x["start"], x["stop"]) not in held]


_SPAN = "struct<start:int,order:int,stop:int,kind:string,verdict:string>"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, spans: sorted array of kind, start, stop, verdict) for every row of `docs`:
    all base spans, each with its value's verdict, and the bare occurrences of live
    values as kind "owned" where no base span or longer such value covers them. Places count
    code points. A null or empty text has no spans; rows that repeat have equal ones; an empty
    table gives no rows; of other columns only those of repository and owner are read. owner:
    by default a document's source, repository: the part of a source in one language."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    (own,) = fresh(docs, "own_id")
    rows = scan(docs.withColumn(own, F.col(id_col)), text_col, repository, owner, (own,))
    verdicts = materialize(ownership(rows, max_owners, max_repositories).select("hash", "verdict"), "secrets-verdicts")
    each = rows.where(F.size("candidates") > 0).select("row", F.inline("candidates"))
    told = each.join(verdicts, "hash").where("kind <> 'bare' OR verdict = 'live'")
    order = F.element_at(F.create_map(*[F.lit(x) for k, v in {"assign": 0, "access": 1, "hex": 2, "bare": 3}.items() for x in (k, v)]), F.col("kind"))
    kind = F.when(F.col("kind") == "bare", "owned").otherwise(F.col("kind"))
    found = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", order.cast("int").alias("order"), "stop", kind.alias("kind"), "verdict"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("row"), pa.array([cleared(x) for x in b.column("spans").to_pylist()], b.column("spans").type)], ["row", "spans"])

    found = found.mapInArrow(run, f"row long, spans array<{_SPAN}>")
    return rows.select("row", F.col(own).alias("doc_id")).join(found, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>", **settings) -> DataFrame:
    """`docs` with every span replaced by `mark` (overlapping spans by one); texts without
    spans and other columns stay as they are. Found by id and text: rows that share both
    have equal spans."""
    columns = docs.columns
    key, of_id, of_text, held = fresh(docs, "own_key", "of_id", "of_text", "spans")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).cast("string").alias("i"), text_key(text_col).alias("t")))
    found = spans(keyed, key, text_col, **settings).where(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id.i").alias(of_id), F.col("doc_id.t").alias(of_text)).agg(F.first("spans").alias(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts = b.column(text_col).to_pylist()
            for i, own in enumerate(b.column(held).to_pylist()):
                if own:
                    out, at = [], 0
                    for s in own:
                        if s["start"] >= at:
                            out += [texts[i][at : s["start"]], mark]
                        at = max(at, s["stop"])
                    texts[i] = "".join(out) + texts[i][at:]
            yield pa.record_batch([pa.array(texts, b.schema.field(c).type) if c == text_col else b.column(c) for c in columns], columns)

    same = F.col(id_col).cast("string").eqNullSafe(F.col(of_id)) & (text_key(text_col) == F.col(of_text))
    return docs.join(found, same, "left").select(*columns, held).mapInArrow(run, docs.schema)
