import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(values, budget):
    """Index of the first value that links reach, for each value."""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(values):
            for j, y in enumerate(values):
                if bin(x ^ y).count("1") <= budget and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sets(st.integers(0, 63), max_size=6)), min_size=1, max_size=40), st.integers(1, 5))
def test_trie_links_what_brute_force_links(flips, budget):
    bases = [0, 2**64 - 1, 0x0123456789ABCDEF, 0xF0F0F0F0F0F0F0F0, 0x5555555555555555, 1 << 63]
    values = np.unique(np.array([bases[b] ^ sum(1 << i for i in bits) for b, bits in flips], np.uint64))
    label = list(range(len(values)))
    for mask in simhash.block_masks(budget):
        moved = simhash._mask_first(values, mask)
        order = np.argsort(moved)
        first = simhash.trie_classes(moved[order], bin(mask).count("1"), budget)
        pairs = list(zip(order.tolist(), order[first].tolist(), strict=True))
        while any(label[a] != label[b] for a, b in pairs):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
    for i in range(len(label)):
        while label[i] != label[label[i]]:
            label[i] = label[label[i]]
    groups = lambda x: {frozenset(i for i in range(len(x)) if x[i] == v) for v in set(x)}
    assert groups(label) == groups(slow_classes([int(v) for v in values], budget))


def test_classes_equal_brute_force(docs, rows):
    got = simhash.near_classes(docs).collect()
    prints = [slow_fingerprint(r[1]) for r in rows]
    label = slow_classes(prints, simhash.BUDGET)
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted(repr((r[0], p, least.get(c))) for r, p, c in zip(rows, prints, label, strict=True))
    assert sorted(repr((r["doc_id"], r["fp"] % 2**64, r["component_id"])) for r in got) == want


def test_large_buckets_are_split_without_loss(docs):
    whole = {tuple(r) for r in simhash.near_classes(docs).select("doc_id", "fp", "component_id").collect()}
    fps = simhash.fingerprints(docs).select("fp").distinct()
    split = simhash.components(simhash.links(fps, bucket_rows=2))
    plain = simhash.components(simhash.links(fps))
    assert whole
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, plain.collect()))


def test_empty_table(empty):
    assert simhash.near_classes(empty).count() == 0
