"""Substring duplicates by relative Lempel-Ziv parsing against indexed reference blocks.

1. Windows of `window` words are grouped by an anchor, the least hash among a window's
   runs of `anchor` words: neighbouring windows mostly share it and form one piece, and
   equal windows have equal anchors wherever they stand. Anchors that stand in one place
   only are settled by a count; their words never leave their task.
2. The pieces of the other anchors are cut out of the texts with their words and dealt by
   anchor, so all pieces that could hold a copy of each other lie in one reference block.
   Of pieces with the same words one is sent for a slice of texts and one is kept in the block.
3. A block is indexed by a suffix array over its words. Every piece is factored greedily:
   at a place the longest match anywhere else in the block is taken as a factor, if it has
   `window` words at least, and the index is asked again at the first window that crosses
   the factor's boundary; words are compared as words, not by hashes.
4. Factors are joined back to all places where their piece stands.

An anchor in more than `common` places is dealt out by whole windows instead, so a block
stays small whatever is common in the corpus; that number is an exact count and the
factors cover the same words either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import fresh, materialize, partitions, slices, text_key
from gaugeworks.llm.words import Rolling, sliding_min, words_of

WINDOW, ANCHOR = 35, 12
#: Places from which an anchor is dealt by whole windows; windows of a piece at most.
COMMON, PIECE = 4_000, 256
#: Words that are indexed at once (more where one anchor has more).
BLOCK_WORDS = 1 << 20
_SLICE = 8 << 20
_PLACE = pa.struct([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32())])


def pieces_of(texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of each run of windows that share an anchor: its text's row, its first window, its
    number of windows (PIECE at most), the anchor, and whether a window may repeat in it."""
    w = words_of(texts)
    n = len(w.starts) - window + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    runs, reach = Rolling(w.hashes, 0xD1B54A32D192ED03).runs(anchor), window - anchor
    least = sliding_min(runs, reach + 1)
    near = np.zeros(len(runs) + 1, np.int64)
    for d in range(1, reach + 1):
        near[1:-d] |= runs[d:] == runs[:-d]
    near = np.cumsum(near)
    at = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    doc, least = w.doc[at], least[at]
    if not len(at):
        return at, at, at, least, at.astype(bool)
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    parts = -(-size // PIECE)
    which = np.repeat(np.arange(len(head)), parts)
    step = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
    first = head[which] + step
    again = (size > reach + 1)[which] | (near[at[first] + np.minimum(PIECE, size[which] - step) + reach] > near[at[first]])
    return doc[first], at[first] - w.first[doc[first]], np.minimum(PIECE, size[which] - step), least[first], again


def longest_matches(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest match that starts at any other place, and
    that place, by a suffix array (prefix doubling) and the common prefixes of neighbours in
    it. The last value, and values that end a sequence, must occur nowhere else."""
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    while n and int(levels[-1].max()) < n - 1:
        rank, h = levels[-1], 1 << (len(levels) - 1)
        behind = np.zeros(n, np.int64)
        behind[: max(n - h, 0)] = rank[h:] + 1
        levels.append(np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64))
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        same = levels[k][a] == levels[k][b]
        for x in (a, b, common):
            x[same] += 1 << k
    before, after = np.append([0], common), np.append(common, [0])
    length, source = np.empty(n, np.int64), np.empty(n, np.int64)
    length[order] = np.maximum(before, after)
    source[order] = np.where(before >= after, np.append([-1], order[:-1]), np.append(order[1:], [-1])) if n else order
    return length, source


def parsed(ids: np.ndarray, first: np.ndarray, stop: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (sequence, start, stop, source) of the sequences ids[first:stop], each
    followed by a value of its own, against all of `ids`. At a place the longest match is
    taken; the next place asked is that of the first window which the factor doesn't hold."""
    length, source = longest_matches(ids)
    good = np.flatnonzero(length >= window)
    out, lead = [], np.searchsorted(good, first)
    for k in np.flatnonzero(np.searchsorted(good, stop) > lead):
        i, end = int(lead[k]), int(stop[k])
        while i < len(good) and good[i] < end:
            at = int(good[i])
            out.append((int(k), at, at + int(length[at]), int(source[at])))
            i = int(np.searchsorted(good, at + int(length[at]) - window + 1))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _anchored(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            doc, start, size, least, again = pieces_of(b.column("text"), window, anchor)
            yield pa.record_batch(
                [b.column("doc_id").take(pa.array(doc)), b.column("text_key").take(pa.array(doc)), pa.array(least.view(np.int64)), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(again)],
                ["doc_id", "text_key", "anchor", "start", "size", "again"],
            )

    return rows.mapInArrow(run, "doc_id long, text_key long, anchor long, start int, size int, again boolean")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(block, content: digest of the words, words, at: places): of each slice of texts, each
    piece once. Whole windows of common anchors have their digest as block and need no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            found: dict[tuple[int, bytes], tuple[bytes | None, list]] = {}
            for doc, key, text, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "places")), strict=True):
                words = text.encode().split()
                for p in places:
                    start, common = p["start"], p["common"]
                    for a, z in [(start + i, start + i + window) for i in range(p["size"])] if common else [(start, start + p["size"] + window - 1)]:
                        piece = b" ".join(words[a:z])
                        content = hashlib.blake2b(piece, digest_size=16).digest()
                        block = int.from_bytes(content[:8], "little", signed=True) if common else p["anchor"]
                        found.setdefault((block, content), (None if common else piece, []))[1].append({"doc_id": doc, "text_key": key, "start": a})
            held = [pa.array(x, kind) for x, kind in zip(zip(*((*k, *v) for k, v in found.items()), strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.list_(_PLACE)), strict=True)] if found else []
            if held:
                yield pa.record_batch(held, ["block", "content", "words", "at"])

    return texts.mapInArrow(run, "block long, content binary, words binary, at array<struct<doc_id:long,text_key:long,start:int>>")


def _block_factors(window: int, block_words: int):
    """Factors of the pieces of a partition that comes ordered by block, a bounded number of
    words at a time; a piece that stands in two places is one factor whole."""
    names = ["block", "content", "start", "stop", "source_id", "source_start", "other_id", "other_start"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def factored(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        out = [(r["block"], r["content"], 0, r["size"], r["least"]["doc_id"], r["least"]["start"], r["most"]["doc_id"], r["most"]["start"]) for r in rows if r["times"] > 1]
        held = [r for r in rows if r["words"] is not None]
        if any(r["times"] == 1 for r in held):
            flat: list[bytes] = []
            size = np.array([r["size"] for r in held])
            first = np.cumsum(size + 1) - size - 1
            for k, r in enumerate(held):
                flat += r["words"].split()
                flat.append(b" %d" % k)
            ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
            del flat
            once = np.flatnonzero(np.array([r["times"] for r in held]) == 1)
            for k, a, z, s in parsed(ids, first[once], (first + size)[once], window):
                r, of = held[once[k]], int(np.searchsorted(first, s, side="right")) - 1
                source = held[of]["least"]
                to = source["start"] + s - int(first[of])
                out.append((r["block"], r["content"], a - int(first[once[k]]), z - int(first[once[k]]), source["doc_id"], to, source["doc_id"], to))
        if out:
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for b in batches:
            for r in b.to_pylist():
                if words >= block_words and r["block"] != held[-1]["block"]:
                    yield from factored(held)
                    held, words = [], 0
                held.append(r)
                words += r["size"] if r["words"] is not None else 8
        if held:
            yield from factored(held)

    return run


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, common: int = COMMON, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Duplicate factors (doc_id, text_key, start, stop: words from start to stop - 1;
    source_id, source_start: a copy of them). Their union holds exactly the words in
    windows of `window` words that start anywhere else too, in the same document or
    another; repeated rows are copies of each other. Factors may overlap. A null text
    and a text of fewer words have none; null ids are kept as null; an empty table
    gives no rows; other columns are not read."""
    rows = _keyed(docs, id_col, text_col)
    n = partitions(docs.sparkSession)
    anchors = _anchored(rows, window, anchor)
    several = anchors.groupBy("anchor").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > common).alias("common"))
    several = materialize(several, "substring-anchors")
    places = anchors.join(several, "anchor").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size", "anchor", "common")).alias("places"))
    pieces = _cut(_beside(rows, places, "inner"), window)
    told = pieces.select("block", "content", "words", F.size("at").alias("times"), F.array_min("at").alias("least"), F.array_max("at").alias("most"))
    own = told.repartition(n, "block").groupBy("block", "content").agg(F.first("words").alias("words"), F.sum("times").alias("times"), F.min("least").alias("least"), F.max("most").alias("most"))
    sized = own.withColumn("size", F.when(F.col("words").isNull(), window).otherwise(F.size(F.split(F.col("words").cast("string"), " "))))
    found = sized.sortWithinPartitions("block").mapInArrow(_block_factors(window, block_words), "block long, content binary, start int, stop int, source_id long, source_start int, other_id long, other_start int")
    held = pieces.select("block", "content", F.inline("at").alias("doc_id", "text_key", "place")).join(found, ["block", "content"])
    self = F.col("doc_id").eqNullSafe(F.col("source_id")) & (F.col("place") + F.col("start") == F.col("source_start"))
    source = lambda name: F.when(self, F.col(f"other_{name}")).otherwise(F.col(f"source_{name}")).alias(f"source_{name}")
    return held.select("doc_id", "text_key", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop"), source("id"), source("start"))


def _beside(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Rows of (doc_id, text_key, ...) beside those of `other` with the same two."""
    renamed = other.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"})
    return rows.join(renamed, rows.doc_id.eqNullSafe(renamed.of_id) & (rows.text_key == renamed.of_key), how).drop("of_id", "of_key")


def _cover(spans: list, n: int) -> np.ndarray:
    """True at words that a span covers."""
    edges = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edges[s["start"]] += 1
        edges[s["stop"]] -= 1
    return np.cumsum(edges[:-1]) > 0


def _grouped(found: DataFrame) -> DataFrame:
    """All factors of a document; their number follows its length."""
    return found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def digests(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of `docs`; the digest is of
    the words outside all factors, joined by one space. A null text has no words; rows that
    repeat have equal results; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                words = text.as_py().encode().split()
                gone = _cover(spans.as_py(), len(words)) if spans.is_valid else None
                kept = words if gone is None else [w for w, g in zip(words, gone, strict=True) if not g]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.record_batch([b.column("doc_id"), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    texts = _beside(_keyed(docs, id_col, text_col), _grouped(found), "left")
    return texts.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_factors(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the words of all factors cut out of the text, each with the blanks
    behind it; other texts and columns, whatever their names, stay as they are: a null text
    stays null, rows that repeat have equal results, an empty table gives no rows."""
    schema = docs.schema
    spans, of_id, of_key = fresh(docs, "spans", "of_id", "of_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts = b.column(text_col).to_pylist()
            hit = b.column(spans).is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(hit):
                w = words_of(pa.array([texts[i]], pa.string()), hashed=False)
                gone = _cover(b.column(spans)[int(i)].as_py(), len(w.starts))
                after = np.append(w.starts[1:], w.offsets[-1])
                edges = np.zeros(w.offsets[-1] + 1, np.int64)
                np.add.at(edges, w.starts[gone], 1)
                np.add.at(edges, after[gone], -1)
                texts[i] = w.data[: w.offsets[-1]][np.cumsum(edges[:-1]) == 0].tobytes().decode()
            cols = [pa.array(texts, b.schema.field(c).type) if c == text_col else b.column(c) for c in schema.names]
            yield pa.record_batch(cols, schema.names)

    grouped = _grouped(found).withColumnsRenamed({"doc_id": of_id, "text_key": of_key, "spans": spans})
    same = docs[id_col].cast("long").eqNullSafe(grouped[of_id]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == grouped[of_key])
    return docs.join(grouped, same, "left").select(*[docs[c] for c in docs.columns], spans).mapInArrow(run, schema)
