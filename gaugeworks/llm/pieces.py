"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text's spaces become marks, and it falls into marked words (a run of marks and what
follows it) that no piece crosses. Of a slice of texts the distinct words not met before
are sorted, which walks their trie depth first: the best scores of all prefixes of the
last word are on a stack, those of the prefix that the next word shares are kept, and
only its further characters are scored. Characters without a piece become byte pieces.

The segmentation is the one of highest total score, of equals the one whose last piece
is longest. The public model was trained by
merges and its scores are merge ranks, so applying the merges in order, as its own
library does, gives other ids for many words; decoding is the same.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import slices

MARK = "▁"
#: Bytes of words and their ids that a worker remembers, by estimate; then it starts anew.
REMEMBER = 256 << 20
#: How much worse than the worst piece a character without one is.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    """Where the public model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def pieces_of(path: str) -> Pieces:
    """This worker's model and what it remembers, which its tasks share."""
    return Pieces(path)


class Pieces:
    """A model's pieces, and the segmentations found so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): (model.get_score(i), i) for i in normal}
        lengths: dict[str, set[int]] = {}
        for p in self.score:
            lengths.setdefault(p[-2:], set()).add(len(p))
        #: The last two characters of a piece (one, of a piece of one) -> its lengths.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        self.raw = {i: p.replace(MARK, " ").encode() for p, (_, i) in self.score.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        alone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in self.score))
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, list[int]] = {}
        self.held = 0

    def learn(self, words: Iterable[str]) -> None:
        """Segments the words in sorted order, each from where it leaves the one before."""
        score, lengths, unknown = self.score, self.lengths, self.unknown
        lowest = float("-inf")
        best, back, last = [0.0], [(0, -1)], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, place = lowest, (end - 1, -1)
                for n in lengths.get(word[end - 2 : end], ()) if end > 1 else ():
                    if n <= end:
                        found = score.get(word[end - n : end])
                        if found is not None and best[end - n] + found[0] > top:
                            top, place = best[end - n] + found[0], (end - n, found[1])
                alone, piece = score.get(word[end - 1], (unknown, -1))
                if best[end - 1] + alone > top:
                    top, place = best[end - 1] + alone, (end - 1, piece)
                best.append(top)
                back.append(place)
            ids, end = [], len(word)
            while end:
                start, piece = back[end]
                ids += [piece] if piece >= 0 else [self.byte[b] for b in reversed(word[start:end].encode())]
                end = start
            self.known[word] = ids[::-1]
            self.held += 200 + 4 * len(word) + 36 * len(ids)
            last = word

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if self.held > REMEMBER:
            self.known.clear()
            self.held = 0
        self.learn({w for words in split for w in words if w not in self.known})
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32 of the little-endian unsigned 32-bit ids, round_trip,
    ids): round_trip tells whether the ids decode to the text (a literal mark counts as a
    space). Null and empty texts have no ids; rows that repeat stay apart; other columns
    are not read, and nothing is shuffled."""
    path = model or default_model()
    kinds = {"n_tokens": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in slices(batches, "text"):
            texts = [(t or "").replace(MARK, " ") for t in b.column("text").to_pylist()]
            ids = pieces.encode(texts)
            cols = [list(map(len, ids)), [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids], [pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)], ids]
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c, kind) for c, kind in zip(cols, kinds.values(), strict=False)]], ["doc_id", *kinds])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else ""))


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text) from arrays of ids; null arrays give null texts. Rows that repeat stay
    apart, an empty table gives no rows, other columns are not read."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
