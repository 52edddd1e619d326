"""Deleted interpolation: a bigram, a unigram and a uniform estimate mixed with weights
that depend on how often the context was seen, the weights learned by
expectation-maximisation on held-out counts.

Tokens are dealt out once: those of a slice of documents go, grouped by the predicted
word, to the shard of that word (of word and context where the word is frequent), so a
shard has every occurrence of its bigrams. Each shard then asks the owners of all its
words for their counts, which the owners add up from what the shards have counted. With
the answers a shard fills the histogram that EM needs and, once the weights are known,
adds up the scores of its share of each document. Nothing is kept whole anywhere: the
driver sees the histogram, whose cells are a fixed grid, and the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import partitions, slices
from gaugeworks.llm.words import mix, words_of

FOLDS = 10
#: Remainder of the documents kept out of training, and of the training documents whose
#: counts are deleted to learn the weights.
HELD_OUT, DELETED = 0, 1
#: Cells of the histogram for each doubling of a probability; rounds of EM.
GRID, ROUNDS = 8, 60
#: Documents sampled for frequent words at most, and the share of tokens that makes one.
SAMPLE_DOCS, FREQUENT = 20_000, 0.002
END = np.uint64(0x3C6EF372FE94F82B)
_SLICE = 8 << 20
#: Tokens that are scored at once.
_CHUNK = 1 << 18
_NEVER = -(1 << 20)


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo FOLDS; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of each text (its lower-cased words, then the end): its hash, that
    of the token before it (the end, at a text's start), and its row."""
    w = words_of(texts, lower=True)
    return np.insert(w.hashes, w.first[1:], END), np.insert(w.hashes, w.first[:-1], END), np.repeat(np.arange(len(w.first) - 1), np.diff(w.first) + 1)


def _identity(shard: int) -> int:
    return shard


def _home(uid: int, n: int) -> int:
    """The task that adds up the scores of a slice: by a mixed hash of its number, so that the
    first slices of many partitions don't meet in one."""
    return int(mix(np.array([uid], np.uint64))[0] % np.uint64(n))


def _dealt(docs: DataFrame, n: int) -> RDD:
    """(shard, message): ("docs", slice, ids, folds) once a slice, and for each shard
    ("tokens", slice, folds, words, tokens a word, contexts, context and row a token)."""
    rows = docs.select("doc_id", "text")
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    often = np.array([END])
    if total >= 4_000:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                word, times = np.unique(words_of(b.column("text"), lower=True).hashes, return_counts=True)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(times)], ["word", "n"])

        drawn = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        counts = drawn.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        least = (counts.agg(F.sum("n")).first()[0] or 0) * FREQUENT
        found = counts.where(F.col("n") >= max(least, 16)).select("word").toPandas()["word"].to_numpy(np.int64)
        often = np.unique(np.append(found.view(np.uint64), END))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, "text", _SLICE)):
            uid = part << 24 | k
            ids = b.column("doc_id").to_pylist()
            folds = np.fromiter(map(fold, ids), np.uint8, len(ids))
            word, before, doc = tokens(b.column("text"))
            named = mix(word)
            hot = np.isin(word, often)
            named[hot] = mix(named[hot] ^ before[hot])
            shard = (named % np.uint64(n)).astype(np.int32)
            order = np.lexsort((word, shard))
            shard, word, before, doc = shard[order], word[order], before[order], doc[order]
            cut = np.searchsorted(shard, np.arange(n + 1))
            to, out = [_home(uid, n)], [_packed(uid, 0, b.column("doc_id").is_valid().to_numpy(zero_copy_only=False), b.column("doc_id").fill_null(0).to_numpy(), folds)]
            for s in np.flatnonzero(np.diff(cut)):
                x = slice(cut[s], cut[s + 1])
                own, times = np.unique(word[x], return_counts=True)
                contexts, at = np.unique(before[x], return_inverse=True)
                small = lambda v: v.astype(np.uint16 if len(v) and v.max() < 1 << 16 else np.uint32)
                to.append(int(s))
                out.append(_packed(uid, 1, folds, own, small(times), contexts, small(at), small(doc[x])))
            yield pa.record_batch([pa.array(to, pa.int32()), pa.array(out, pa.binary())], ["shard", "message"])

    return rows.mapInArrow(deal, "shard int, message binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(n, _identity)


_KINDS = [np.uint8, np.uint16, np.uint32, np.int64, np.uint64, np.float64, np.bool_]


def _packed(uid: int, tag: int, *arrays: np.ndarray) -> bytes:
    head = [uid, tag, len(arrays)]
    for a in arrays:
        head += [_KINDS.index(a.dtype.type), len(a)]
    return np.array(head, np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(data: bytes) -> tuple[int, int, list[np.ndarray]]:
    uid, tag, n = np.frombuffer(data, np.int64, 3)
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 24), 24 + 16 * n, []
    for kind, size in head.reshape(-1, 2):
        out.append(np.frombuffer(data, _KINDS[kind], size, at))
        at += out[-1].nbytes
    return int(uid), int(tag), out


class _Shard:
    """A shard's tokens. words: all words and contexts, ordered by owner and hash."""

    def __init__(self, messages: list[bytes], n: int):
        held = []
        self.docs: list[tuple[int, list[np.ndarray]]] = []
        for uid, tag, arrays in map(_unpacked, messages):
            if tag:
                held.append((uid, arrays))
            else:
                self.docs.append((uid, arrays))
        empty = np.empty(0, np.uint64)
        every = np.unique(np.concatenate([empty, *(a[1] for _, a in held), *(a[3] for _, a in held)]))
        owner = (mix(every) % np.uint64(n)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        self.words, self.owner = every[order], owner[order]
        place = np.empty(len(every), np.int32)
        place[order] = np.arange(len(every), dtype=np.int32)
        find = lambda x: place[np.searchsorted(every, x)]
        none = np.empty(0, np.int32)
        self.slices = [uid for uid, _ in held]
        self.rows = [len(a[0]) for _, a in held]
        first = np.cumsum([0, *self.rows])
        self.word = np.concatenate([none, *(np.repeat(find(a[1]), a[2]) for _, a in held)])
        self.before = np.concatenate([none, *(find(a[3])[a[4]] for _, a in held)])
        self.row = np.concatenate([none, *(a[5].astype(np.int32) + np.int32(f) for (_, a), f in zip(held, first, strict=False))])
        self.fold = np.concatenate([np.empty(0, np.uint8), *(a[0] for _, a in held)])[self.row]

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in training documents, and in those deleted to learn weights."""
        return np.bincount(at[self.fold != HELD_OUT], minlength=size), np.bincount(at[self.fold == DELETED], minlength=size)


def _asked(n: int):
    def run(part: int, pairs: Iterator) -> Iterator[tuple[int, bytes]]:
        shard = _Shard([m for _, m in pairs], n)
        train, deleted = shard.counted(shard.word, len(shard.words))
        cut = np.searchsorted(shard.owner, np.arange(n + 1))
        for o in range(n):
            x = slice(cut[o], cut[o + 1])
            yield o, _packed(part, 2, shard.words[x], train[x].astype(np.uint32), deleted[x].astype(np.uint32))

    return run


def _answered(n: int):
    def run(part: int, pairs: Iterator) -> Iterator[tuple[int, bytes]]:
        asked = [(uid, *arrays) for uid, _, arrays in (_unpacked(m) for _, m in pairs)]
        if not asked:
            return
        words, at = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        train = np.bincount(at, np.concatenate([a[2] for a in asked]), len(words)).astype(np.int64)
        deleted = np.bincount(at, np.concatenate([a[3] for a in asked]), len(words)).astype(np.int64)
        sums = np.array([train.sum(), (train > 0).sum(), (train - deleted).sum(), (train > deleted).sum()], np.int64)
        first = 0
        for uid, own, *_ in asked:
            x = at[first : first + len(own)]
            first += len(own)
            yield uid, _packed(part, 3, train[x], deleted[x], sums)

    return run


class _Counts:
    """A shard with the whole corpus' counts of its words and its bigrams."""

    def __init__(self, pairs: Iterator, n: int):
        messages, answers = [], []
        for _, m in pairs:
            (answers if np.frombuffer(m, np.int64, 2)[1] == 3 else messages).append(m)
        self.shard = shard = _Shard(messages, n)
        told = sorted((uid, arrays) for uid, _, arrays in map(_unpacked, answers))
        none = np.empty(0, np.int64)
        self.train = np.concatenate([none, *(a[0] for _, a in told)])
        self.deleted = np.concatenate([none, *(a[1] for _, a in told)])
        self.n, self.v, self.n_less, self.v_less = np.sum([a[2] for _, a in told], axis=0) if told else (0, 0, 0, 0)
        pair = shard.word.astype(np.int64) * max(len(shard.words), 1) + shard.before
        own, at = np.unique(pair, return_inverse=True)
        self.pair = at.astype(np.int32) if len(own) < 1 << 31 else at
        del pair, own, at
        self.pair_train, self.pair_deleted = shard.counted(self.pair, int(self.pair.max()) + 1 if len(self.pair) else 0)


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + log2 of its count, rounded down."""
    return np.frexp(context_count.astype(np.float64))[1]


def _parts(joint: np.ndarray, context: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return joint / np.maximum(context, 1), word / max(n, 1)


def _histogram(n: int):
    def run(pairs: Iterator) -> Iterator[tuple[tuple[int, int, int], int]]:
        c = _Counts(pairs, n)
        at = np.flatnonzero(c.shard.fold == DELETED)
        less = c.train - c.deleted
        context, word = less[c.shard.before[at]], less[c.shard.word[at]]
        joint = (c.pair_train - c.pair_deleted)[c.pair[at]]
        p2, p1 = _parts(joint, context, word, c.n_less)
        grid = lambda p: np.where(p > 0, np.rint(GRID * np.log2(np.maximum(p, 1e-300))), _NEVER).astype(np.int64)
        cells, times = np.unique(np.stack([bucket(context), grid(p2), grid(p1)]), axis=1, return_counts=True)
        for cell, t in zip(cells.T.tolist(), times.tolist(), strict=True):
            yield tuple(cell), t
        yield (-1, int(c.v_less), 0), 1

    return run


def learn(histogram: dict[tuple[int, int, int], int], uniform: float, rounds: int = ROUNDS) -> dict[int, tuple[float, float, float]]:
    """Weights of bigram, unigram and uniform estimate for each bucket of context counts,
    by EM on a histogram of (bucket, bigram cell, unigram cell)."""
    if not histogram:
        return {}
    cells, times = np.array(list(histogram)), np.array(list(histogram.values()), np.float64)
    value = lambda q: np.where(q == _NEVER, 0.0, 2.0 ** (np.maximum(q, -(1 << 12)) / GRID))
    out = {}
    for b in np.unique(cells[:, 0]):
        own = cells[:, 0] == b
        p = np.stack([value(cells[own, 1]), value(cells[own, 2]), np.full(own.sum(), uniform)])
        w = np.array([0.4 if b else 0.0, 0.5, 0.1])
        for _ in range(rounds):
            share = w[:, None] * p
            w = (share / share.sum(axis=0) * times[own]).sum(axis=1)
            w /= w.sum()
        w = np.maximum(w, [0, 1e-9, 1e-9])
        out[int(b)] = tuple((w / w.sum()).tolist())
    return out


def _weights_table(weights: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """Weights by bucket; a bucket without held-out counts takes those of the next lower
    one that has some, the first ones a plain unigram estimate."""
    table, last = np.empty((66, 3)), (0.0, 0.9, 0.1)
    for b in range(66):
        last = weights.get(b, last)
        table[b] = last
    table[0] = [0.0, table[0][1] + table[0][0], table[0][2]]
    return table


def _scored(n: int, table: np.ndarray):
    def run(pairs: Iterator) -> Iterator[tuple[int, bytes]]:
        c = _Counts(pairs, n)
        shard = c.shard
        size = sum(shard.rows)
        sums = [np.zeros(size) for _ in range(4)]
        for k in range(0, len(shard.row), _CHUNK):
            x = slice(k, k + _CHUNK)
            row, context, word, joint = shard.row[x], c.train[shard.before[x]], c.train[shard.word[x]], c.pair_train[c.pair[x]]
            p2, p1 = _parts(joint, context, word, c.n)
            w = table[bucket(context)]
            score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (c.v + 1))
            base = np.log10((word + 0.1) / (c.n + 0.1 * (c.v + 1)))
            for total, value in zip(sums, (np.ones(len(row)), word > 0, base, score), strict=True):
                np.add.at(total, row, value)
        first = 0
        for uid, rows in zip(shard.slices, shard.rows, strict=True):
            x = slice(first, first + rows)
            first += rows
            some = np.flatnonzero(sums[0][x])
            yield _home(uid, n), _packed(uid, 4, some.astype(np.uint32), *(s[x][some].astype(kind) for s, kind in zip(sums, (np.uint32, np.uint32, np.float64, np.float64), strict=True)))
        for uid, arrays in shard.docs:
            yield _home(uid, n), _packed(uid, 5, *arrays, np.array([c.n], np.int64))

    return run


def _added(pairs: Iterator) -> Iterator[tuple]:
    """Rows of documents from the shards' sums, a slice at a time."""
    held: dict[int, list] = {}
    docs: dict[int, list[np.ndarray]] = {}
    for _, m in pairs:
        uid, tag, arrays = _unpacked(m)
        if tag == 5:
            docs[uid] = arrays
        else:
            held.setdefault(uid, []).append(arrays)
    for uid, (valid, ids, folds, total) in docs.items():
        sums = np.zeros((4, len(ids)))
        for at, *values in held.pop(uid, []):
            for s, v in zip(sums, values, strict=True):
                s[at] += v
        for i in range(len(ids)):
            yield (int(ids[i]) if valid[i] else None, bool(folds[i] == HELD_OUT), int(sums[0, i]), int(sums[1, i]), int(total[0]), float(sums[2, i]), float(sums[3, i]))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row
    of `docs`. A null text is empty: its end is its one token. Rows that repeat count as
    often as they stand; an empty table gives no rows; other columns are not read."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = _dealt(rows, n)
    asked = dealt.mapPartitionsWithIndex(_asked(n)).partitionBy(n, _identity)
    answers = asked.mapPartitionsWithIndex(_answered(n)).partitionBy(n, _identity)
    both = dealt.union(answers)
    assert both.getNumPartitions() == n, "tokens and answers lie in the same partitions"
    cells = dict(both.mapPartitions(_histogram(n)).reduceByKey(lambda a, b: a + b, min(n, 8)).collect())
    sizes = [k for k in cells if k[0] < 0]
    for k in sizes:
        del cells[k]
    table = _weights_table(learn(cells, 1 / (1 + max((k[1] for k in sizes), default=0))))
    added = both.mapPartitions(_scored(n, table)).partitionBy(n, _identity).mapPartitions(_added)
    return spark.createDataFrame(added, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
