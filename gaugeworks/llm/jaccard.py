"""Exact similarity of pairs of texts by the share of word shingles that they have in
common: the check behind candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialize, sieve, sifted, slices, text_key
from gaugeworks.llm.words import mix, words_of

SHINGLE, SIMILARITY = 5, 0.8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(hash of the words in their order, sorted distinct shingle hashes) of each text: words
    in lower case (ASCII); fewer than `size` words are one shingle; a word-less text has none."""
    w = words_of(texts, lower=True)
    n = max(0, len(w.hashes) - size + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs = mix(runs * _STEP + w.hashes[j : j + n])
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        own = xxhash.xxh64_intdigest(w.hashes[a:z].tobytes())
        yield own, np.unique(runs[a : z - size + 1]) if z - a >= size else np.array([own] if z > a else [], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted distinct values; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _texts(docs: DataFrame, text_col: str, rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(node, text) of the nodes in `pairs`. Texts pass a sieve in their own tasks, so that
    few others are shuffled; of equal texts a task sends one."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    of_node = materialize(rows.groupBy("node").agg(F.min("text_hash").alias("text_hash")).join(wanted, "node"), name)

    shared = sieve(of_node.select("text_hash"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sifted(shared.value, b.column("text_hash").to_numpy())))

    own = docs.select(text_key(text_col).alias("text_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    once = own.mapInArrow(passing, "text_hash long, text string").groupBy("text_hash").agg(F.first("text").alias("text"))
    return once.join(of_node, "text_hash").select("node", "text")


def sets_of(docs: DataFrame, text_col: str, rows: DataFrame, nodes: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """(node, shingles: sorted distinct hashes) of the `nodes`."""
    texts = _texts(docs, text_col, rows, nodes.select(F.col("node").alias("u"), F.col("node").alias("v")), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            held = [own.view(np.int64) for _, own in shingle_sets(b.column("text"), shingle)]
            yield pa.record_batch([b.column("node"), pa.array(held, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def confirmed(docs: DataFrame, text_col: str, rows: DataFrame, pairs: DataFrame, name: str, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Those of the `pairs` (u, v) of nodes whose shingle sets are at least `least` similar."""
    pairs = materialize(pairs, name)
    texts = materialize(_texts(docs, text_col, rows, pairs, name), name)
    a, b = texts.select(F.col("node").alias("u"), F.col("text").alias("a")), texts.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "a"):
            for x in slices([part], "b"):
                sets = zip(shingle_sets(x.column("a"), shingle), shingle_sets(x.column("b"), shingle), strict=True)
                yield x.select(["u", "v"]).filter(pa.array([similarity(p, q) >= least for (_, p), (_, q) in sets], pa.bool_()))

    return materialize(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), name)
