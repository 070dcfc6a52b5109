"""Fingerprints, generalised pigeonhole search and components against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cartlake.llm import simhash
from cartlake.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_fingerprints():
    texts = ["a b c d e f A", "A b", "one", "", None, "é  x\ty\nz", "w " * 500, "a b c d e f a"]
    got = simhash.text_fingerprints(pa.array(texts), 3)
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in texts]


def families(seed=0):
    """Fingerprints with correlated bits, and neighbours at 1 to 5 bits of some of them."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 300, np.uint64)
    base[:150] &= np.uint64(0xFFFFFFFF00000000)
    near = []
    for x in base[::3]:
        for k in rng.integers(1, 6, 4):
            flips = rng.choice(64, int(k), replace=False)
            near.append(int(x) ^ sum(1 << int(b) for b in flips))
    return np.unique(np.concatenate([base, np.array(near, np.uint64)]))


@pytest.mark.parametrize("limit", [1, 3, 4])
def test_all_pairs_within_the_limit_are_found(spark, limit):
    prints = families(limit)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    found = {frozenset(r) for r in simhash.near_pairs(df, len(prints), limit).collect()}
    want = set()
    for i, x in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ x) <= limit):
            want.add(frozenset(prints[[i, i + 1 + j]].view(np.int64).tolist()))
    assert found == want and want


def test_thresholds_add_up_for_every_fingerprint(spark):
    prints = families(7)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    for total in (len(prints), 10**7, 10**10):
        plan = simhash.layout(df, total, 3)
        assert sorted(b for g in plan.groups for b in g) == list(range(64))
        chosen = plan.thresholds(prints.view(np.int64))
        assert (chosen >= -1).all() and ((chosen + 1).sum(axis=1) == 4).all()
    assert len(simhash.layout(df, 10**10, 3).groups) < len(simhash.layout(df, 1000, 3).groups)


def test_estimates_are_exact_for_narrow_partitions():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 10, 500)
    near = simhash.near_counts(np.bincount(values, minlength=1 << 10), 10, 3)
    for v in (0, 5, 1023):
        for t in range(4):
            assert near[t][v] == (np.bitwise_count(values ^ v) <= t).sum()


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    links = spark.createDataFrame(pairs + [(None, 3)], "a long, b long")
    want = slow_components([p for p in pairs if p[0] != p[1]])
    assert {r.node: r.component for r in components(links).collect()} == want
    assert components(links.limit(0)).count() == 0


def rows_with_copies():
    rng = np.random.default_rng(4)
    words = ["w%d" % i for i in range(300)]
    long = [" ".join(rng.choice(words, 400)) for _ in range(6)]
    texts = long + [t + " end" for t in long[:4]] + [long[0]] * 30 + ["", None, " \n", "short", "SHORT", "x y"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, long[3]), (None, long[1])]


def test_near_duplicates_equal_brute_force(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component string")
    prints = [slow_fingerprint(t) for _, t in rows]
    groups = slow_components([(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 3])
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    want = sorted((str(i), f"{p:016x}", least[groups[p]]) for (i, _), p in zip(rows, prints))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert kept.where("doc_id IS NULL").count() == len({groups[p] for (i, _), p in zip(rows, prints)} - {
        groups[p] for (i, _), p in zip(rows, prints) if i is not None})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.representatives(docs).count() == 0


def test_every_group_keeps_a_row_where_ids_repeat(spark):
    texts = {name: " ".join(f"{name}{j}" for j in range(200)) for name in "abc"}
    rows = [(1, texts["a"]), (1, texts["b"]), (2, texts["b"]), (None, texts["c"]), (None, texts["c"]), (3, texts["a"]), (1, texts["a"])]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, number int")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text[0]) for r in kept.collect()))) == ["(1, 'a')", "(1, 'b')", "(None, 'c')"]
