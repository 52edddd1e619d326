import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import pieces as sp


@pytest.fixture(scope="module")
def model():
    return sp.Pieces(sp.default_model())


def slow(model, word):
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        ways = [(best[end - n][0] + model.score[word[end - n : end]][0], best[end - n][1] + [model.score[word[end - n : end]][1]]) for n in range(min(end, 40), 0, -1) if word[end - n : end] in model.score]
        if word[end - 1] not in model.score:
            ways.append((best[end - 1][0] + model.unknown, best[end - 1][1] + [model.byte[b] for b in word[end - 1].encode()]))
        best.append(max(ways, key=lambda w: w[0]))
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("theinoa▁日é😀\n") | st.characters(exclude_categories=["Cs"]), min_size=1, max_size=14), min_size=1, max_size=12))
def test_shared_prefixes_change_nothing(model, words):
    model.known.clear()
    model.learn(set(words))
    assert model.known == {w: slow(model, w) for w in words}


def test_documents(docs, rows, model, empty):
    got = sp.encoded(docs).collect()
    ids = model.encode([r[1] or "" for r in rows])
    want = [(r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True, x) for r, x in zip(rows, ids, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    back = sp.decoded(sp.encoded(docs)).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in back) == sorted(repr((r[0], r[1] or "")) for r in rows)
    assert sp.encoded(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("a b  \n\tü▁") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_round_trip(model, text):
    (ids,) = model.encode([text.replace(sp.MARK, " ")])
    assert model.decode(ids) == text.replace(sp.MARK, " ")
