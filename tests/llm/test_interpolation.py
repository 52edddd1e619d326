import math
import re
import zlib
from collections import Counter

import pytest

from gaugeworks.llm import interpolation as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(rows):
    low = {i: i + 32 for i in range(65, 91)}
    return [(r[0], [*WORD.findall((r[1] or "").translate(low)), "</s>"]) for r in rows]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10


def slow(rows):
    """The model with dictionaries; EM on the same grid."""
    docs = texts(rows)
    one, two, one_less, two_less = Counter(), Counter(), Counter(), Counter()
    for i, words in docs:
        if fold(i):
            pairs = list(zip(["</s>", *words], words, strict=False))
            one.update(words)
            two.update(pairs)
            if fold(i) != 1:
                one_less.update(words)
                two_less.update(pairs)
    n, v, n_less, v_less = sum(one.values()), len(one), sum(one_less.values()), len(one_less)
    bucket = lambda c: c.bit_length()
    grid = lambda p: round(8 * math.log2(p)) if p else lm._NEVER
    cells = Counter()
    for i, words in docs:
        if fold(i) == 1:
            for a, b in zip(["</s>", *words], words, strict=False):
                cells[bucket(one_less[a]), grid(two_less[a, b] / max(one_less[a], 1)), grid(one_less[b] / max(n_less, 1))] += 1
    table = lm._weights_table(lm.learn(dict(cells), 1 / (v_less + 1)))
    out = []
    for i, words in docs:
        score = base = 0.0
        for a, b in zip(["</s>", *words], words, strict=False):
            w = table[bucket(one[a])]
            score += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] / (v + 1))
            base += math.log10((one[b] + 0.1) / (n + 0.1 * (v + 1)))
        out.append((i, fold(i) == 0, len(words), sum(one[w] > 0 for w in words), n, base, score))
    return out


def test_scores_equal_brute_force(docs, rows):
    got, want = lm.scores(docs).collect(), slow(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-6)


def test_probabilities_sum_to_one_in_every_context(rows):
    """Over all known words, the end and one unknown word."""
    docs = texts(rows)
    one, two = Counter(), Counter()
    for i, words in docs:
        if fold(i):
            one.update(words)
            two.update(zip(["</s>", *words], words, strict=False))
    n, v = sum(one.values()), len(one)
    for w in lm._weights_table({0: (0.0, 0.7, 0.3), 3: (0.5, 0.3, 0.2)}):
        assert sum(w) == pytest.approx(1)
    context = max(one, key=one.get)
    w = lm._weights_table({})[3]
    total = sum(w[0] * two[context, b] / one[context] + w[1] * one[b] / n + w[2] / (v + 1) for b in one) + w[2] / (v + 1)
    assert total == pytest.approx(1 if w[0] else 1, abs=1e-9)


def test_em_raises_the_held_out_likelihood():
    cells = {(3, -8, -80): 50, (3, lm._NEVER, -40): 30, (3, lm._NEVER, lm._NEVER): 5}
    def likelihood(w):
        value = lambda q: 0 if q == lm._NEVER else 2 ** (q / 8)
        return sum(t * math.log(w[0] * value(a) + w[1] * value(b) + w[2] * 1e-3) for (_, a, b), t in cells.items())
    values = [likelihood(lm.learn(cells, 1e-3, rounds)[3]) for rounds in (1, 2, 5, 20, 60)]
    assert values == sorted(values)


def test_empty_table(empty):
    assert lm.scores(empty).count() == 0
