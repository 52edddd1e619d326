"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints within `budget` differing bits agree on one of budget + 1 blocks of bits.
Each distinct fingerprint goes once to the bucket of every block; a task then walks
the binary trie over its buckets' remaining bits with pairs of nodes, adds up the bits
in which the two prefixes differ and drops a pair once the sum exceeds the budget.
Pairs whose nodes lie in one class already are dropped too, so a dense group of near
copies costs about its size and not its square; a class, not a pair list, is what
comes out. Buckets above `bucket_rows` are split again by the bits that are left.

`near_copies` is the same join for a fixed similarity of texts. One fingerprint of word
shingles cannot tell 0.8 from less (at a Jaccard similarity of 0.8 some 10 of 64 bits
differ), so each text has several fingerprints of its distinct runs of two words, which an
edit changes less: `SIM_PRINTS` whose bits are majorities, and `MIN_PRINTS` whose bits are
each one bit of the least of the runs' hashes. Of those a pair's bits differ with half of
what its sets don't share: of two texts at 0.8, one of which goes on where the other ends,
6 of 64 where the majorities' differ in 9. A pair within the budget in any fingerprint is a
candidate, and the exact similarity of the two shingle sets decides. First the pairs by which the trie walks grow
their classes are held against each other, fewer than a bucket has texts; classes of
confirmed pairs are formed and the walks are done again over them with other pairs. A walk
over the classes that still have neighbours finds the buckets in which texts of two of them
meet; the shingle sets go to those buckets only, and a last walk holds all candidate pairs
against each other inside its tasks. So a large
group of near copies sends about as many pairs as it has texts, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.components import components
from gaugeworks.llm.jaccard import SHINGLE as SHINGLE_WORDS
from gaugeworks.llm.jaccard import SIMILARITY, confirmed, sets_of, similarity
from gaugeworks.llm.shared import materialize, partitions, slices, text_key
from gaugeworks.llm.words import mix, words_of

BITS = 64
SEED = 42
SHINGLE = 4
BUDGET = 4
#: Rows of a bucket above which it is split by further bits.
BUCKET_ROWS = 4_000_000
#: Fingerprints of a text in near_copies, by majorities and by least hashes, and the words in
#: a run that they are made of.
SIM_PRINTS, MIN_PRINTS, PRINT_RUN = 2, 14, 2
#: Rounds of near_copies over pairs that connect classes, before all others are looked at.
ROUNDS = 2
_CHUNK, _LEAF, _PAIRS = 32_768, 32, 1 << 21
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 of a text's word shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    n = max(1, len(words) - shingle + 1)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 8192):
        counts += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep` columns, fp): one row per document, fp the signed 64-bit
    fingerprint. Null and word-less texts have fingerprint 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text"))
    names = ["doc_id", *keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("__text")], np.uint64)
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(fps.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, schema)


def block_masks(budget: int, fixed: int = 0) -> list[int]:
    """The bits outside `fixed` cut into budget + 1 runs, each joined with `fixed`."""
    free = [i for i in range(BITS - 1, -1, -1) if not fixed >> i & 1]
    return [fixed | sum(1 << int(i) for i in part) for part in np.array_split(free, budget + 1) if len(part)]


def _mask_first(fps: np.ndarray, mask: int) -> np.ndarray:
    """The same bits with those of the mask on top."""
    order = sorted(range(BITS), key=lambda i: (not mask >> i & 1, -i))
    out, to, i = np.zeros_like(fps), BITS, 0
    while i < BITS:
        j = i
        while j + 1 < BITS and order[j + 1] == order[j] - 1:
            j += 1
        size = j - i + 1
        to -= size
        out |= (fps >> np.uint64(order[j]) & np.uint64((1 << size) - 1)) << np.uint64(to)
        i = j + 1
    return out


def _products(a: np.ndarray, az: np.ndarray, b: np.ndarray, bz: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each a..az with its b..bz, about _PAIRS at a time."""
    rows = np.maximum(1, _PAIRS // np.maximum(1, bz - b))
    parts = -(-(az - a) // rows)
    of = np.repeat(np.arange(len(a)), parts)
    low = a[of] + (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * rows[of]
    high = np.minimum(low + rows[of], az[of])
    area = (high - low) * (bz - b)[of]
    cut = np.searchsorted(np.cumsum(area) // _PAIRS, np.arange(int(area.sum()) // _PAIRS + 2))
    for first, last in zip(cut[:-1], cut[1:], strict=True):
        x = slice(first, last)
        if first < last:
            at = np.repeat(np.arange(first, last), area[x])
            step = np.arange(len(at)) - np.repeat(np.cumsum(area[x]) - area[x], area[x])
            wide = (bz - b)[of[at]]
            yield low[at] + step // wide, b[of[at]] + step % wide


def trie_classes(values: np.ndarray, top: int, budget: int) -> np.ndarray:
    """For each of the sorted `values`, the index of the first value of its class: values
    that agree in their `top` first bits are linked where at most `budget` bits differ, and
    classes are what links connect."""
    label = np.arange(len(values))
    for _ in trie_pairs(values, top, budget, label):
        pass
    return label


def trie_pairs(values: np.ndarray, top: int, budget: int, label: np.ndarray, merging: bool = True, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of the sorted `values` that agree in their `top` first bits, differ in
    `budget` bits at most and have two labels. With `merging` the label of a pair is made
    one, the lesser, as soon as it is met, so the pairs given connect the classes and are
    fewer than the values; without, labels stay and every such pair is given. A label is the
    index of its first value when merging. Which pairs connect a class depends on `seed`."""
    n, rng = len(values), np.random.default_rng(seed)

    def merge(i: np.ndarray, j: np.ndarray) -> bool:
        changed = False
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return changed
            changed = True
            np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def changes() -> np.ndarray:
        return np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])

    heads = values >> np.uint64(BITS - top)
    edge = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if n else np.empty(0, np.int64)
    lo, hi = edge, np.concatenate([edge[1:], [n]])[: len(edge)].astype(np.int64)
    if merging and n and not seed:
        near = np.flatnonzero((label[1:] != label[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= budget) & (heads[1:] == heads[:-1]))
        merge(near, near + 1)
        yield near, near + 1
    several = hi - lo > 1
    lo, hi = lo[several], hi[several]
    if not len(lo):
        return
    seen = changes()
    stack = [(top, lo[i : i + _CHUNK], hi[i : i + _CHUNK], lo[i : i + _CHUNK], hi[i : i + _CHUNK], np.zeros(len(lo[i : i + _CHUNK]), np.int8)) for i in range(0, len(lo), _CHUNK)]
    while stack:
        depth, a, az, b, bz, diff = stack.pop()
        one = (seen[az - 1] == seen[a]) & (seen[bz - 1] == seen[b]) & (label[a] == label[b])
        a, az, b, bz, diff = (x[~one] for x in (a, az, b, bz, diff))
        area = (az - a) * (bz - b)
        small = (area <= _LEAF) | (depth == BITS)
        if small.any():
            for i, j in _products(*(x[small] for x in (a, az, b, bz))):
                hit = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget) & (label[i] != label[j])
                i, j = i[hit], j[hit]
                if not merging and len(i):
                    yield i, j
                if merging and len(i):
                    order = np.argsort(np.bitwise_count(values[i] ^ values[j]) + rng.random(len(i)))
                    i, j = i[order], j[order]
                while merging and len(i):
                    # of each label that has a lesser one beside it the nearest pair: a forest
                    _, first = np.unique(np.maximum(label[i], label[j]), return_index=True)
                    yield i[first], j[first]
                    merge(i[first], j[first])
                    apart = label[i] != label[j]
                    i, j, seen = i[apart], j[apart], changes()
        a, az, b, bz, diff = (x[~small] for x in (a, az, b, bz, diff))
        if not len(a):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        over = ~np.uint64(2 * int(bit) - 1)
        am, bm = (np.searchsorted(values, (values[x] & over) | bit) for x in (a, b))
        twin = a == b
        parts = [(a, am, b, bm, diff, slice(None)), (am, az, bm, bz, diff, slice(None)), (a, am, bm, bz, diff + 1, slice(None)), (am, az, b, bm, diff + 1, ~twin)]
        children = [np.concatenate(x) for x in zip(*(tuple(y[keep] for y in p) for *p, keep in parts), strict=True)]
        live = (children[1] > children[0]) & (children[3] > children[2]) & (children[4] <= budget)
        live &= (children[0] != children[2]) | (children[1] - children[0] > 1)
        children = [x[live] for x in children]
        stack += [(depth + 1, *(x[i : i + _CHUNK] for x in children)) for i in range(0, len(children[0]), _CHUNK)]


def buckets(fps: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of `fps` (kind int, fp long, any others) once for every bucket they are in,
    with the bucket's mask, dealt out so that a bucket lies in one partition. Any two of one
    kind within `budget` bits share a bucket."""
    spark, n, kept = fps.sparkSession, partitions(fps.sparkSession), fps.columns
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    masks, key = block_masks(budget), ["kind", "mask", "bits"]
    rows = fps.select(*kept, F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks])).alias("mask"))
    ready = []
    while True:
        rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        large = rows.groupBy(*key).count().where(F.col("count") > bucket_rows).select(*key)
        finer = {m: block_masks(budget, m) for m in masks if bin(m).count("1") < BITS - budget}
        if not finer or not large.head(1):
            ready.append(rows)
            break
        large = materialize(large, "simhash-large")
        ready.append(rows.join(large, key, "left_anti").select(*kept, "mask", "bits"))
        into = F.create_map(*[x for m, k in finer.items() for x in (F.lit(signed(m)).cast("long"), F.array(*[F.lit(signed(y)).cast("long") for y in k]))])
        rows = materialize(rows.join(large, key, "left_semi").select(*kept, F.explode(into[F.col("mask")]).alias("mask")), "simhash-finer")
        masks = sorted({x for k in finer.values() for x in k})
    for more in ready[1:]:
        ready[0] = ready[0].unionByName(more)
    return ready[0].repartition(n, *key).select(*kept, "mask")


def _per_mask(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, int]]:
    """Of each kind and mask in a partition: its rows by fingerprint with the mask's bits on
    top, those numbers, and how many bits the mask has."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    kind, mask = table.column("kind").to_numpy(), table.column("mask").to_numpy()
    order = np.lexsort((mask, kind))
    kind, mask = kind[order], mask[order]
    new = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (mask[1:] != mask[:-1])))
    for a, z in zip(new, np.append(new[1:], len(order)), strict=True):
        own = table.take(pa.array(order[a:z]))
        bits = int(mask[a]) & (1 << BITS) - 1
        moved = _mask_first(own.column("fp").to_numpy().view(np.uint64), bits)
        sort = np.argsort(moved, kind="stable")
        yield own.take(pa.array(sort)), moved[sort], bits.bit_count()


def links(fps: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) between the distinct values of `fp` whose closure joins exactly the
    fingerprints that chains of at most `budget` differing bits connect: within each
    bucket every member of a class points to its first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, moved, top in _per_mask(batches):
            fp = own.column("fp").to_numpy()
            first = trie_classes(moved, top, budget)
            keep = fp != fp[first]
            yield pa.record_batch([pa.array(fp[keep]), pa.array(fp[first][keep])], ["u", "v"])

    return buckets(fps.select(F.lit(0).alias("kind"), "fp"), budget, bucket_rows).mapInArrow(run, "u long, v long")


def candidates(fps: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS, merging: bool = True, seed: int = 0) -> DataFrame:
    """Pairs (u, v), u > v, of the nodes in `fps` (kind, fp, node, label) that have two labels
    and are within `budget` bits in some kind: with `merging` so many of them as connect the
    labels of a bucket that such pairs connect (which ones, `seed` decides), else all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, moved, top in _per_mask(batches):
            node, label = own.column("node").to_numpy(), own.column("label").to_numpy()
            if merging:
                _, first, of = np.unique(label, return_index=True, return_inverse=True)
                label = first[of]
            for i, j in trie_pairs(moved, top, budget, label, merging, seed):
                yield pa.record_batch([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["u", "v"])

    return buckets(fps, budget, bucket_rows).mapInArrow(run, "u long, v long").where("u <> v").distinct()


def _labels(own: pa.Table) -> np.ndarray:
    """The labels of the rows, each as the place of the first row that has it."""
    _, first, of = np.unique(own.column("label").to_numpy(), return_index=True, return_inverse=True)
    return first[of]


def _own_pairs(own: pa.Table, moved: np.ndarray, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one kind and mask that have two labels and are within the budget, each
    only in the first kind and block that it meets in."""
    blocks = block_masks(budget)
    kind, mask = own.column("kind")[0].as_py(), own.column("mask")[0].as_py() & (1 << BITS) - 1
    prints = own.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(own.num_rows, -1)
    for i, j in trie_pairs(moved, top, budget, _labels(own), merging=False):
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            apart = prints[a] ^ prints[b]
            mine = (np.bitwise_count(apart) <= budget).argmax(axis=1) == kind
            if mask in blocks:
                shared = (apart[:, kind][:, None] & np.array(blocks, np.uint64)) == 0
                mine &= shared.argmax(axis=1) == blocks.index(mask)
            yield a[mine], b[mine]


def meeting(fps: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of `fps` (kind, fp, node, label, fps) once for every bucket, named by kind and
    mask, in which a pair with another label has to be looked at. Most rows meet nobody in most
    of their buckets, and needn't bring their shingle sets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, moved, top in _per_mask(batches):
            met = np.zeros(own.num_rows, bool)
            for i, j in _own_pairs(own, moved, top, budget):
                met[i] = met[j] = True
            yield from own.filter(pa.array(met)).to_batches()

    return buckets(fps, budget, bucket_rows).mapInArrow(run, "kind int, fp long, node long, label long, fps array<long>, mask long")


def verified(met: DataFrame, least: float, budget: int = BUDGET) -> DataFrame:
    """Pairs (u, v) of the nodes in `met` (rows of `meeting` with their shingles) that have two
    labels, are within `budget` bits in some kind and are at least `least` similar: every pair
    is held against each other where its first kind and block meet, unless pairs before it
    have joined the two already. Only pairs that are alike leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, moved, top in _per_mask(batches):
            node, held = own.column("node").to_numpy(), own.column("shingles").combine_chunks()
            ends, every = held.offsets.to_numpy(), held.values.to_numpy().view(np.uint64)
            sets = [every[x:z] for x, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            label, up = _labels(own), list(range(len(node)))

            def root(x: int, up: list[int] = up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for i, j in _own_pairs(own, moved, top, budget):
                out = []
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = root(int(label[x])), root(int(label[y]))
                    small, large = sorted((len(sets[x]), len(sets[y])))
                    if p != q and small >= least * large and similarity(sets[x], sets[y]) >= least:
                        up[max(p, q)] = min(p, q)
                        out.append((max(node[x], node[y]), min(node[x], node[y])))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    bucket = ["kind", "mask", F.col("fp").bitwiseAND(F.col("mask"))]
    return met.repartition(partitions(met.sparkSession), *bucket).mapInArrow(run, "u long, v long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep` columns, fp, component_id, root) for every row of `docs`:
    component_id is the smallest id (nulls apart) of the documents that links of at most
    `budget` bits reach, the row itself included; root names the component. Rows that share
    an id and a text have equal results; an empty table gives no rows; other columns are not
    read. Aggregates are written out before they are joined, so both sides of a join come
    from plain shuffles and AQE can split a hot key."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, keep), "simhash")
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = materialize(components(links(least, budget), "simhash-classes"), "simhash-nodes")
    roots = least.join(joined, least.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    of_root = materialize(roots.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    return rows.join(roots.join(of_root, "root").select("fp", "component_id", "root"), "fp").select("doc_id", *keep, "fp", "component_id", "root")


def hex_fingerprint(fp: str = "fp"):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: Odd factors that order the runs in as many ways as there are bits of minwise fingerprints.
_FACTORS = mix(np.arange(1, MIN_PRINTS * BITS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def prints_of(values: np.ndarray) -> np.ndarray:
    """The fingerprints of the distinct hashes; all are 0 without any."""
    own = np.unique(values)
    if not len(own):
        return np.zeros(SIM_PRINTS + MIN_PRINTS, np.uint64)
    counts = np.zeros((SIM_PRINTS, BITS), np.int64)
    for i in range(0, len(own), 1024):
        h = mix(own[i : i + 1024] ^ mix(np.arange(1, SIM_PRINTS + 1, dtype=np.uint64))[:, None])
        counts += np.unpackbits(h.view(np.uint8).reshape(SIM_PRINTS, -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    short, least = mix(own).astype(np.uint32), np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 128):
        np.minimum(least, (short[i : i + 128, None] * _FACTORS).min(axis=0), out=least)
    odd = mix(least.astype(np.uint64) + np.arange(len(least), dtype=np.uint64) * np.uint64(1 << 32)) & np.uint64(1)
    bits = np.concatenate([(2 * counts > len(own)).ravel(), odd.astype(bool)])
    return np.packbits(bits, bitorder="little").view(np.uint64)


def sketches(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(doc_id, `keep` columns, text_hash, node, fps): node stands for the text's words, in
    lower case (ASCII) and in their order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, text_key(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("__text"))
    names = ["doc_id", *keep, "text_hash"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "node long, fps array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            w = words_of(b.column("__text"), lower=True)
            own = [w.hashes[a:z] for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64)
            runs = w.hashes.copy()
            for j in range(1, PRINT_RUN):
                runs[: len(runs) - j] = mix(runs[: len(runs) - j] ^ mix(w.hashes[j:] + np.uint64(j)))
            parts = [runs[a : max(a, z - PRINT_RUN + 1)] if z - a >= PRINT_RUN else w.hashes[a:z] for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            found = np.concatenate([prints_of(x) for x in parts])
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * (SIM_PRINTS + MIN_PRINTS), pa.int32()), pa.array(found.view(np.int64)))
            yield pa.record_batch([*[b.column(c) for c in names], pa.array(nodes.view(np.int64)), held], [*names, "node", "fps"])

    return rows.mapInArrow(run, schema)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, least: float = SIMILARITY, budget: int = BUDGET, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep` columns, root) for every row of `docs`: root names the component of
    links between texts whose sets of `shingle` words are at least `least` similar (Jaccard).
    Links are confirmed exactly; a pair is missed only where no fingerprint of its runs of
    words is within the budget. Texts of the same words in the same order are linked, word-less ones
    (also null) among themselves; rows that repeat have equal results; an empty table gives no
    rows; other columns are not read."""
    rows = materialize(sketches(docs, id_col, text_col, keep), "near")
    nodes = materialize(rows.groupBy("node").agg(F.first("fps").alias("fps")), "near-nodes")
    label = edges = tried = None
    labelled = lambda: nodes.join(label, "node", "left").select("node", "fps", F.coalesce("component", "node").alias("label"))
    for seed in range(ROUNDS):
        told = nodes.withColumn("label", F.col("node")) if label is None else labelled()
        pairs = candidates(told.select(F.posexplode("fps").alias("kind", "fp"), "node", "label"), budget, seed=seed)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "near-pairs")
        found = confirmed(docs, text_col, rows, pairs, "near-confirmed", shingle, least)
        if edges is None:
            # a node without a pair here has no neighbour, and has none in later rounds
            met = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
            nodes = materialize(nodes.join(met, "node", "left_semi"), "near-nodes")
        edges, tried = (found, pairs) if edges is None else (edges.unionByName(found), tried.unionByName(pairs))
        label = materialize(components(edges, "near-classes"), "near-labels")
    # classes that a pair which was not alike still lies between: any other pair does, too
    of = lambda c, to: label.select(F.col("node").alias(c), F.col("component").alias(to))
    both = tried.join(of("u", "p"), "u", "left").join(of("v", "q"), "v", "left").select(F.coalesce("p", "u").alias("p"), F.coalesce("q", "v").alias("q")).where("p <> q")
    open_classes = both.select(F.col("p").alias("label")).unionByName(both.select(F.col("q").alias("label"))).distinct()
    rest = materialize(labelled().join(open_classes, "label", "left_semi"), "near-open")
    each = rest.select(F.posexplode("fps").alias("kind", "fp"), "node", "label", "fps")
    met = materialize(meeting(each, budget), "near-met")
    sets = sets_of(docs, text_col, rows, met, "near-sets", shingle)
    more = materialize(verified(met.join(sets, "node"), least, budget), "near-verified")
    if more.head(1):
        label = materialize(components(edges.unionByName(more), "near-classes"), "near-labels")
    return rows.join(label, "node", "left").select("doc_id", *keep, F.coalesce("component", "node").alias("root"))
