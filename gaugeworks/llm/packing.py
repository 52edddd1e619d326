"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokens come from a byte-level BPE tokenizer. Its splitting pattern never looks past a
blank, so a slice of texts is cut at blanks, each distinct unit is encoded once, and a
text's ids are gathered from those of its units; texts for which that doesn't hold
(other Unicode blanks, special tokens written out) are encoded whole.

Packing is hierarchical: every partition packs its pieces by best fit in decreasing
size and closes the bins that are nearly full; the others go on as single items of
their filled size to the next round, where fewer partitions pack them again, until one
partition is left or a round no longer saves bins.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialize, slices
from gaugeworks.llm.words import hash_spans, words_of

LENGTH, END = 1024, 2
#: Free places up to which a bin counts as nearly full; items of a partition in a round.
SLACK, ITEMS = 8, 50_000
#: Bytes of units and their ids that a worker remembers; then it starts anew.
REMEMBER = 96 << 20
_LINES = 500
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]|<\|")


def default_tokenizer() -> tuple[str, str | None]:
    """Where the public byte-level BPE vocabulary lies: the tokenizer's file and the same
    vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoder_of(path: str, ranks: str | None) -> UnitEncoder:
    """This worker's encoder, which its tasks share."""
    return UnitEncoder(path, ranks)


class UnitEncoder:
    """Ids of slices of texts; remembers the ids of units between slices. With the ranks
    of the same vocabulary, units are merged by them, which gives the same ids in a
    quarter of the time."""

    def __init__(self, path: str, ranks: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.encode
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            by_rank = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.merged = lambda texts: [by_rank.encode_ordinary(t) for t in texts]
        self.line = self.merged(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encodes units. Those with a visible character at both ends (but for one space
        before it) and no line break are encoded many to a text, one a line, as a line
        break is a token of its own beside them; other blanks may merge with it."""
        plain = np.array(["\n" not in t and t[-1] > " " and not t[-1].isspace() and not t.removeprefix(" ")[0].isspace() for t in texts], bool) & (len(self.line) == 1)
        lines = np.flatnonzero(plain)
        texts_of = ["\n".join([texts[i] for i in lines[k : k + _LINES].tolist()]) for k in range(0, len(lines), _LINES)]
        many = [np.array(x, np.uint32) for x in self.merged(texts_of)]
        one = [np.array(x, np.uint32) for x in self.merged([texts[i] for i in np.flatnonzero(~plain).tolist()])]
        ends = [np.append(np.flatnonzero(x == self.line[0]), len(x)) for x in many]
        starts = [np.append(0, e[:-1] + 1) for e in ends]
        shift = np.cumsum([len(self.ids), *map(len, many), *map(len, one)])
        at = np.concatenate([np.empty(0, np.int64), *(s + d for s, d in zip(starts, shift, strict=False)), shift[len(many) : -1]])
        size = np.concatenate([np.empty(0, np.int64), *(e - s for s, e in zip(starts, ends, strict=True)), [len(x) for x in one]]).astype(np.int64)
        hashes = hashes[np.concatenate([lines, np.flatnonzero(~plain)])]
        self.ids = np.concatenate([self.ids, *many, *one])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null counts as empty."""
        w = words_of(texts, hashed=False)
        data, bounds = w.data, w.offsets
        before = np.empty(len(w.starts), np.int64)
        before[1:] = w.ends[:-1]
        lead = w.first[:-1][np.diff(w.first) > 0]
        before[lead] = bounds[:-1][np.diff(w.first) > 0]
        gap = w.starts - before
        spaced = (gap > 0) & (data[np.maximum(w.starts - 1, 0)] == 0x20)
        bare, more = (gap > 0) & ~spaced, gap > 1
        last = bounds[:-1].copy()
        some = np.diff(w.first) > 0
        last[some] = w.ends[w.first[1:][some] - 1]
        tail = bounds[1:] > last
        starts = np.concatenate([w.starts - spaced, before[more], w.starts[bare] - 1, last[tail]])
        ends = np.concatenate([w.ends, w.starts[more] - 1, w.starts[bare], bounds[1:][tail]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        hashes = hash_spans(data, starts, ends)
        own, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        if sum(x.nbytes for x in (self.known, self.at, self.size, self.ids)) > REMEMBER:
            self.forget()
        place = np.searchsorted(self.known, own)
        new = np.ones(len(own), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != own
        if new.any():
            raw = data.tobytes()
            self.learn(own[new], [raw[a:z].decode() for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.known, own)
        size = self.size[place][unit]
        total = np.cumsum(size)
        at = np.repeat(self.at[place][unit] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
        ids = self.ids[at]
        edge = np.concatenate([[0], total])[np.searchsorted(starts, bounds)]
        out = [ids[a:z] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        odd = np.unique(np.searchsorted(bounds, [m.start() for m in _ODD.finditer(data[: bounds[-1]].tobytes())], side="right") - 1)
        for i, ids in zip(odd, self.encode([texts[int(i)].as_py() for i in odd]), strict=True):
            out[i] = np.array(ids, np.uint32)
        return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: tuple[str, str | None] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id. Only those
    of more than `length` are cut: all pieces but the first have that length. A null or
    empty text is the end id alone; rows with equal ids stay apart."""
    path, ranks = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, ranks)
        for b in slices(batches, "text"):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, ids in enumerate(encoder.batch(b.column("text"))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                first = (len(ids) - 1) % length + 1
                for piece, start in enumerate([0, *range(first, len(ids), length)]):
                    part = ids[start : start + (length if piece else first)]
                    for to, x in zip(rows, (i, piece, start, len(part), zlib.crc32(part)), strict=True):
                        to.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([b.column("doc_id").take(pa.array(rows[0], pa.int64())), *[pa.array(x, k) for x, k in zip(rows[1:], kinds, strict=True)]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: items in decreasing size, each into the fullest bin with room."""
    free: list[list[int]] = [[] for _ in range(length + 1)]
    some, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            free[left].append(b)
            some |= 1 << left
    return bins


_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_ITEM = "fill int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>, closed boolean"


def _round(items: DataFrame, length: int, slack: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills: list[int] = []
        held: list[list[dict]] = []
        for b in batches:
            fills += b.column("fill").to_pylist()
            held += b.column("members").to_pylist()
        bins = best_fit(fills, length)
        for k in range(0, len(bins), 4096):
            out: tuple[list, list, list] = ([], [], [])
            for own in bins[k : k + 4096]:
                fill, members = 0, []
                for i in own:
                    members += [m | {"offset": m["offset"] + fill} for m in held[i]]
                    fill += fills[i]
                for to, x in zip(out, (fill, members, length - fill <= slack), strict=True):
                    to.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(_MEMBER)), pa.array(out[2])], ["fill", "members", "closed"])

    return items.select("fill", "members").mapInArrow(run, _ITEM)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: tuple[str, str | None] | None = None, slack: int = SLACK, items: int = ITEMS) -> DataFrame:
    """The pieces of `docs` with sequence_id and offset: pieces of a sequence lie without
    gaps from offset 0 and fill `length` places at most. Every row of `docs` has at least
    one piece; an empty table gives no rows; other columns are not read. A partition
    holds `items` items of a round or so, the first included, each of `length` members at
    most."""
    cut = materialize(pieces(docs, id_col, text_col, length, tokenizer), "pieces")
    whole = cut.where(F.col("length") == length).withColumns({"sequence_id": 2 * F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < length).select(F.col("length").cast("int").alias("fill"), F.array(member).alias("members"))
    done, before = [], None
    parts = max(1, -(-left.count() // items))
    while True:
        bins = materialize(_round(left.repartition(parts), length, slack), "bins")
        under = bins.where(~F.col("closed"))
        n = under.count()
        if parts == 1 or n == 0 or (before is not None and n > 0.98 * before):
            done.append(bins)
            break
        done.append(bins.where("closed"))
        left, before, parts = under, n, max(1, -(-n // items))
    numbered = [b.select((2 * F.monotonically_increasing_id() + 1 + F.lit(r << 58)).alias("sequence_id"), "members") for r, b in enumerate(done)]
    for more in numbered[1:]:
        numbered[0] = numbered[0].unionByName(more)
    return numbered[0].select("sequence_id", F.inline("members")).select(*whole.columns).unionByName(whole)
