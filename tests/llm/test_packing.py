import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()[0])


@pytest.fixture(scope="module", params=["ranks", "tokenizer alone"])
def encoder(request):
    path, ranks = packing.default_tokenizer()
    return packing.UnitEncoder(path, ranks if request.param == "ranks" else None)


CHARS = "aB é\n\t\r\x0b   　\x1c'’.,!0 9日😀"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(CHARS) | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=6))
def test_units_give_the_ids_of_whole_texts(tokenizer, encoder, texts):
    got = encoder.batch(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_blanks_that_merge_with_line_breaks(tokenizer, encoder):
    texts = ["a\xa0", "\xa0", "b", "\xa0\xa0c d\u3000 e", "f\x85 g\x85\n\n\x85", "\x1f h\x1f", " \xa0", "i", "\u2003\n\u2003", " ", "\x0b \x0b j"]
    got = encoder.batch(pa.array(texts * 2))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts * 2]


def test_pieces_and_sequences(docs, rows, tokenizer):
    got = packing.packed(docs, items=5).collect()
    want = []
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, packing.END], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        starts = [0, *range(first, len(ids), 1024)]
        want += [(r[0], k, a, len(p := ids[a : a + (1024 if k else first)]), zlib.crc32(p.tobytes())) for k, a in enumerate(starts)]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= -(-sum(w[3] for w in want) // 1024) * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_leaves_no_two_bins_that_would_merge(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fills = sorted(sum(sizes[i] for i in b) for b in bins)
    assert all(f <= 50 for f in fills)
    assert len(fills) < 2 or fills[0] + fills[1] > 50


def test_empty_table(empty):
    assert packing.packed(empty).count() == 0
