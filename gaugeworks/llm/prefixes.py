"""The prefix trie of conversations: each distinct sequence of first turns is a node.

Turns lie in order of conversation and turn over range partitions, so a long conversation
is split like any other rows. A numpy scan gives each turn the polynomial fingerprint of
its conversation up to it (modulo 2^64: fp_k = fp_(k-1) * M + hash of the turn k); where a
conversation runs on into the next partition, what the earlier ones hold is carried over,
one row a border. Fingerprints are linear, so those of a rebuilt conversation (a prefix of
another one, then a suffix of its own) follow from the two without the turns.

Rows of equal depth and fingerprint are candidates of one node, represented by that of the
smallest conversation. Each is verified against it: the fingerprint before the turn and
the turn itself (role and text) must be equal, or the very same row of the table. Rows
that fail are collisions: they are held against a new representative among them, and so
on; the number of that representative becomes part of the node's name from there on down.
By induction over depth, two conversations share a node if and only if all their turns up
to it are equal, whatever the fingerprints.

Sums over subtrees need no pass by level. A conversation is the smallest member of its
nodes from some depth on, so each node belongs to one conversation; bytes and leaves of a
subtree are sums over the node's members of what they own below it.

Defined results: rows without conv_id are no conversation's; null roles and texts are
empty; turns of equal number are ordered by role, then text; equal rows are turns of their
own. An empty table gives no rows. The digest of a node's ends is one sequential SHA-256,
so one task streams them in order (never held together), also where a third of all
conversations end in one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gaugeworks.llm.shared import materialize, partitions

#: Odd, so that powers have inverses modulo 2^64.
MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Conversations take over turns of the one at the start of their run of so many ids, up to
#: one turn less than MOST by the checksum of the id.
RUN, MOST = 5, 9
#: Leading characters by which turns of equal number are dealt to partitions.
_LEAD = 32
_KEY = ["depth", "fp", "path"]


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2^64 for whole n from 0 on."""
    out, n = np.ones(len(n), np.uint64), n.astype(np.int64)
    while n.any():
        out[n & 1 == 1] *= np.uint64(base)
        base, n = base * base % (1 << 64), n >> 1
    return out


@F.pandas_udf(LongType())
def _moved(fp: pd.Series, to: pd.Series, off: pd.Series, by: pd.Series) -> pd.Series:
    """fp where the `by` last turns follow the prefix `to` in place of `off`."""
    fp, to, off = (x.to_numpy(np.int64).view(np.uint64) for x in (fp, to, off))
    return pd.Series((fp + (to - off) * _powers(MULTIPLIER, by.to_numpy())).view(np.int64))


@F.pandas_udf(LongType())
def _before(fp: pd.Series, turn_hash: pd.Series) -> pd.Series:
    """The fingerprint before the last turn."""
    fp, last = fp.to_numpy(np.int64).view(np.uint64), turn_hash.to_numpy(np.int64).view(np.uint64)
    return pd.Series(((fp - last) * np.uint64(_INVERSE)).view(np.int64))


def scan(conv: np.ndarray, turn_hash: np.ndarray, n_bytes: np.ndarray, held: tuple[int, int, int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the conversation from 1, fingerprint, bytes) up to each row of rows sorted
    by conversation; `held` is (conversation, place, fingerprint, bytes) of the row before."""
    m = len(conv)
    at = np.arange(m)
    new = np.concatenate([[held is None or held[0] != conv[0]], conv[1:] != conv[:-1]])
    first = np.maximum.accumulate(np.where(new, at, 0))
    up, down = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(m, base, np.uint64))]) for base in (MULTIPLIER, _INVERSE))
    weighed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turn_hash.view(np.uint64) * down[:m], dtype=np.uint64)])
    summed = np.concatenate([[0], np.cumsum(n_bytes)])
    fp = (weighed[1:] - weighed[first]) * up[:m]
    place, size = at - first + 1, summed[1:] - summed[first]
    if held is not None and held[0] == conv[0]:
        k = int(np.argmax(new)) if new.any() else m
        place[:k] += held[1]
        fp[:k] += np.uint64(held[2]) * up[1 : k + 1]
        size[:k] += held[3]
    return place, fp, size


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, part = None, TaskContext.get().partitionId()
    for b in batches:
        if b.num_rows:
            conv, hashes, sizes = (b.column(c).to_numpy() for c in ("conv_id", "turn_hash", "n_bytes"))
            place, fp, size = scan(conv, hashes, sizes, held)
            held = int(conv[-1]), int(place[-1]), int(fp[-1]), int(size[-1])
            own = [pa.array(np.full(b.num_rows, part)), pa.array(place), pa.array(fp.view(np.int64)), pa.array(size)]
            yield pa.record_batch([*own, *b.columns], ["part", "k", "fp", "upto", *b.schema.names])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a conversation but its first, what all parts before it hold."""
    for b in batches:
        out = []
        for conv, parts in zip(b.column("conv_id").to_pylist(), b.column("parts").to_pylist(), strict=True):
            n = fp = size = 0
            for p in parts:
                if n:
                    out.append((conv, p["part"], n, fp - (1 << 64) * (fp >> 63), size))
                fp = (fp * pow(MULTIPLIER, p["last"]["k"], 1 << 64) + p["last"]["fp"]) % (1 << 64)
                n, size = n + p["last"]["k"], size + p["last"]["upto"]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["conv_id", "part", "k0", "fp0", "upto0"])


def scanned(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx from 1, fp, upto: bytes so far, turn_hash, n_bytes, role, text) of each turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role"), text("text"))
    rows = rows.withColumn("turn_hash", F.xxhash64("role", "text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "conv_id", F.asc_nulls_first("turn"), F.left("role", F.lit(_LEAD)), F.left("text", F.lit(_LEAD)))
    ordered = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").drop("turn")
    schema = "part long, k long, fp long, upto long, conv_id long, role string, text string, turn_hash long, n_bytes long"
    turns = materialize(ordered.mapInArrow(_scanned, schema), "prefix-turns")
    ends = turns.groupBy("conv_id", "part").agg(F.max_by(F.struct("k", "fp", "upto"), "k").alias("last"))
    spread = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "last"))).alias("parts")).where(F.size("parts") > 1)
    over = materialize(spread.mapInArrow(_carried, "conv_id long, part long, k0 long, fp0 long, upto0 long"), "prefix-carried")
    columns = ["conv_id", "turn_hash", "n_bytes", "role", "text"]
    if not over.head(1):
        return turns.select(F.col("k").alias("idx"), "fp", "upto", *columns)
    whole = turns.join(F.broadcast(over), ["conv_id", "part"], "left")  # at most a row a partition
    have = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select((F.col("k") + have("k0")).alias("idx"), _moved("fp", have("fp0"), F.lit(0).cast("long"), "k").alias("fp"), (F.col("upto") + have("upto0")).alias("upto"), *columns)


def rebuilt(turns: DataFrame, run: int = RUN, most: int = MOST, bits: int = 64) -> DataFrame:
    """(conv_id, depth from 0, fp, prev: fp one turn before, n_bytes, upto, src_conv and
    src_idx: the turn's row) of the conversations rebuilt as the module says, from scanned
    turns. `bits` below 64 keeps so many of the fingerprints, to make them collide."""
    head = turns.where(F.col("idx") < most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("idx", "fp", "upto", "turn_hash", "n_bytes"))).alias("turns"))
    head = materialize(head, "prefix-heads")
    start = F.col("conv_id") - F.col("conv_id") % run
    own = head.select("conv_id", start.alias("base"), F.col("turns").alias("own"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    both = own.join(head.select(F.col("conv_id").alias("base"), F.col("turns").alias("first")), "base", "left")
    taken = F.least("h", F.coalesce(F.size("first"), F.lit(0))).cast("int")
    at = lambda turns, n, field: F.coalesce(F.get(turns, n - 1)[field], F.lit(0))
    own_h = F.least("h", F.size("own")).cast("int")
    per = both.select(
        "conv_id", "base", "h", taken.alias("taken"), F.slice("first", F.lit(1), taken).alias("first"),
        at(F.col("first"), taken, "fp").alias("to_fp"), at(F.col("own"), own_h, "fp").alias("off_fp"),
        (at(F.col("first"), taken, "upto") - at(F.col("own"), own_h, "upto")).alias("more"),
    )
    per = materialize(per, "prefix-starts")

    none = F.lit(None).cast("long")
    root = per.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "fp")], none.alias("prev"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("upto"), none.alias("src_conv"), none.alias("src_idx"))
    x = F.col("x")
    before = per.where("taken > 0").select("conv_id", "base", F.explode("first").alias("x"))
    before = before.select("conv_id", x["idx"].alias("depth"), x["fp"].alias("fp"), _before(x["fp"], x["turn_hash"]).alias("prev"), x["n_bytes"].alias("n_bytes"), x["upto"].alias("upto"), F.col("base").alias("src_conv"), x["idx"].alias("src_idx"))
    rest = turns.drop("role", "text").join(per.drop("first"), "conv_id").where("idx > h").withColumn("fp", _moved("fp", "to_fp", "off_fp", F.col("idx") - F.col("h")))
    rest = rest.select("conv_id", (F.col("taken") + F.col("idx") - F.col("h")).alias("depth"), "fp", _before("fp", "turn_hash").alias("prev"), "n_bytes", (F.col("upto") + F.col("more")).alias("upto"), F.col("conv_id").alias("src_conv"), F.col("idx").alias("src_idx"))
    rows = before.unionByName(rest)
    if bits < 64:
        rows = rows.withColumns({c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) for c in ("fp", "prev")})
    return materialize(root.unionByName(rows), "prefix-rows")


def _representatives(rows: DataFrame, name: str) -> DataFrame:
    """(key, n, rep: the row of the smallest conversation), one row a key, written out so
    that AQE can split a hot key where rows are joined to it."""
    fields = [c for c in ("conv_id", "prev", "prev_path", "src_conv", "src_idx", "n_bytes", "upto") if c in rows.columns]
    return materialize(rows.groupBy(*[c for c in _KEY if c in rows.columns]).agg(F.count("*").alias("n"), F.min(F.struct(*fields)).alias("rep")), name)


def collisions(rows: DataFrame, candidates: DataFrame, turns: DataFrame) -> DataFrame | None:
    """(depth, fp, prev, src_conv, src_idx, m): rows that differ from their candidate's
    representative, verified turn by turn; rows of equal m (from 1) agree with each other.
    None if all agree."""
    key, src = ["depth", "fp"], ["src_conv", "src_idx"]
    same_row = (F.col("src_conv") == F.col("rep.src_conv")) & (F.col("src_idx") == F.col("rep.src_idx")) & (F.col("prev") == F.col("rep.prev"))
    doubtful = rows.where("depth > 0").join(candidates.where("n > 1 AND depth > 0"), key).where(~same_row)
    pending = materialize(doubtful.groupBy(*key, "prev", *src).agg(F.min("conv_id").alias("conv_id"), F.first("rep").alias("rep")), "prefix-doubtful")
    if not pending.head(1):
        return None
    needed = pending.select(*src).unionByName(pending.select("rep.src_conv", "rep.src_idx")).distinct()
    texts = turns.select(F.col("conv_id").alias("src_conv"), F.col("idx").alias("src_idx"), "role", "text")
    texts = materialize(texts.join(materialize(needed, "prefix-needed"), src, "left_semi"), "prefix-texts")
    other = texts.select(F.col("src_conv").alias("rep_conv"), F.col("src_idx").alias("rep_idx"), F.col("role").alias("rep_role"), F.col("text").alias("rep_text"))

    found, m = None, 0
    while True:
        own = pending.join(texts, src).withColumns({"rep_conv": F.col("rep.src_conv"), "rep_idx": F.col("rep.src_idx")})
        equal = (F.col("prev") == F.col("rep.prev")) & (F.col("role") == F.col("rep_role")) & (F.col("text") == F.col("rep_text"))
        told = materialize(own.join(other, ["rep_conv", "rep_idx"]).select(*pending.columns, equal.alias("equal")), "prefix-verified")
        if m:
            marked = told.where("equal").select(*key, "prev", *src, F.lit(m).alias("m"))
            found = marked if found is None else found.unionByName(marked)
        rest = told.where("NOT equal").drop("equal", "rep")
        if not rest.head(1):
            return found
        reps = materialize(rest.groupBy(*key).agg(F.min(F.struct("conv_id", "prev", *src)).alias("rep")), "prefix-collisions")
        pending, m = rest.join(reps, key), m + 1


def _named(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows with `path` (numbers of the representatives, where not the first, down to
    the row's depth) and `prev_path` (down to one less)."""
    key = ["depth", "fp", "prev", "src_conv", "src_idx"]
    splits = rows.join(materialize(marks, "prefix-marks"), key).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "m"))).alias("splits"))
    joined = rows.join(materialize(splits, "prefix-splits"), "conv_id", "left")
    upto = lambda d: F.coalesce(F.array_join(F.transform(F.filter("splits", lambda s: s["depth"] <= d), lambda s: F.concat_ws(":", s["depth"].cast("string"), s["m"].cast("string"))), ","), F.lit(""))
    return materialize(joined.withColumns({"path": upto(F.col("depth")), "prev_path": upto(F.col("depth") - 1)}).drop("splits"), "prefix-named")


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes in which conversations end; `rows` are their last ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            done = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [*_KEY, "ends_sha256"])
            out.clear()
            return done

        for b in batches:
            for *key, conv in zip(*[b.column(c).to_pylist() for c in (*_KEY, "conv_id")], strict=True):
                if key == now:
                    digest.update(b",%d" % conv)
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(b"%d" % conv)
            yield flushed()
        if now is not None:
            out.append((*now, digest.hexdigest()))
        yield flushed()

    dealt = rows.select(*_KEY, "conv_id").repartition(partitions(rows.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return dealt.mapInArrow(run, "depth long, fp long, path string, ends_sha256 string")


def trie(conversations: DataFrame, run: int = RUN, most: int = MOST, bits: int = 64) -> DataFrame:
    """(conv_id: smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens: bytes of turns that need no second reading in the subtree, ends_sha256),
    one row a node. `run` of 1 takes the conversations as they are."""
    turns = scanned(conversations)
    rows = rebuilt(turns, run, most, bits)
    candidates = _representatives(rows, "prefix-candidates")
    marks = collisions(rows, candidates, turns)
    if marks is None:
        rows, nodes = rows.withColumns({"path": F.lit(""), "prev_path": F.lit("")}), candidates.withColumns({"path": F.lit(""), "rep": F.col("rep").withField("prev_path", F.lit(""))})
    else:
        rows = _named(rows, marks)
        nodes = _representatives(rows, "prefix-split-nodes")

    rep: Column = F.col("rep")
    flat = nodes.select(*_KEY, F.col("n").alias("n_convs"), rep["conv_id"].alias("conv_id"), (rep["upto"] - rep["n_bytes"]).alias("before"), (F.col("depth") - 1).alias("up_depth"), rep["prev"].alias("up_fp"), rep["prev_path"].alias("up_path"))
    counted = flat.where("depth > 0").groupBy("up_depth", "up_fp", "up_path").agg(F.count("*").alias("n_children"))
    counted = counted.select(F.col("up_depth").alias("depth"), F.col("up_fp").alias("fp"), F.col("up_path").alias("path"), "n_children")
    parents = flat.select(F.col("depth").alias("up_depth"), F.col("fp").alias("up_fp"), F.col("path").alias("up_path"), F.col("conv_id").alias("parent_conv_id"))
    tree = flat.join(parents, ["up_depth", "up_fp", "up_path"], "left").join(materialize(counted, "prefix-children"), _KEY, "left")
    tree = materialize(tree.select(*_KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "before"), "prefix-nodes")

    owned = tree.groupBy("conv_id").agg(F.min(F.struct("depth", "before"))["before"].alias("mine"), F.max(F.col("n_children") == 0).cast("int").alias("leaf"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "upto")).alias("last"))
    each = last.join(owned, "conv_id", "left").select("conv_id", F.col("last.depth").alias("length"), F.coalesce("mine", F.col("last.upto")).alias("mine"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = rows.join(materialize(each, "prefix-conversations"), "conv_id")
    shared = F.greatest(F.lit(0).cast("long"), F.col("mine") - (F.col("upto") - F.col("n_bytes")))
    sums = materialize(members.groupBy(*_KEY).agg(F.sum(shared).alias("saved_tokens"), F.sum("leaf").alias("n_leaves")), "prefix-sums")
    ends = materialize(_ends(members.where("depth = length")), "prefix-ends")
    out = tree.join(sums, _KEY).join(ends, _KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
