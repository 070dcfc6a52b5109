"""Ranked search, line dedup and centroid clustering against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cartlake.llm import line_filters, simplex_clusters, treap_search

TERM = re.compile(treap_search.TERM)


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def ranked_by_hand(docs, items, k):
    terms = [Counter(TERM.findall(small(text or ""))) for _, text in docs]
    lengths = [sum(t.values()) for t in terms]
    n_docs, held = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for counts in terms for t in counts)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(small(text or "")))
        scored = []
        for (doc_id, _), counts, n in zip(docs, terms, lengths):
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * counts[t] // (1000 * counts[t] + 12 * (75 + 25 * n * n_docs // held)))
                        for t, q in asked.items() if counts[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id, score))
        out += [(item, i + 1, r[3], r[4]) for i, r in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(out, key=str)


def words(rng, n):
    return " ".join(f"w{i}" for i in rng.zipf(1.4, n) % 300)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    rows = [(i, words(rng, int(rng.integers(0, 60)))) for i in range(400)]
    rows += [(1000 + i, "w7 w9 same text w7") for i in range(60)]  # ties
    rows += [(5, rows[5][1]), (None, "w7 w9 same"), (None, None), (2000, None), (2001, ""), (2002, "..."),
             (2003, words(rng, 30_000)), (2004, "Ünï w7-w9_W11 ÑW7 w7")]
    return rows


def test_search_equals_scoring_all(spark, texts):
    items = [(0, "w7 w9 w9 W250"), (1, "same text"), (2, None), (3, ""), (4, "unheard"), (5, words(np.random.default_rng(4), 80)),
             (1, "same text"), (None, "ünï Ünï w11"), (6, "w1")]
    docs = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, item_id string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for sizes in ({}, {"block_documents": 50}, {"block_postings": 200, "sampled_blocks": 2}, {"item_terms_at_once": 40}):
        got = treap_search.ranked(docs, asked, k=7, **sizes).collect()
        assert sorted([tuple(r) for r in got], key=str) == ranked_by_hand(texts, items, 7)


def test_search_of_nothing(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "w7")], "item_id long, text string")
    assert treap_search.ranked(docs.limit(0), items).count() == 0
    assert treap_search.ranked(docs, items.limit(0)).count() == 0
    assert treap_search.ranked(docs.where("text IS NULL"), items).count() == 0


def test_treap_finds_the_best_columns_and_opens_few_ranges():
    rng = np.random.default_rng(1)
    rows, columns = np.divmod(np.unique(rng.integers(0, 300 * 5000, 60_000)), 5000)
    values = rng.integers(1, 1000, len(rows))
    treap = treap_search.Treap(rows, columns, values)
    grid = np.zeros((300, 5000), np.int64)
    grid[rows, columns] = values
    for asked in ([3], [3, 40, 41, 299], list(range(0, 300, 9))):
        weights = rng.integers(1, 50, len(asked))
        sums = weights @ grid[asked]
        want = np.lexsort((np.arange(5000), -sums))[:20]
        want = want[sums[want] > 0]
        found, scores = treap.best(np.array(asked), weights, 20)
        assert found.tolist() == want.tolist() and scores.tolist() == sums[want].tolist()
        least = int(sums[want][9])
        assert treap.best(np.array(asked), weights, 20, least)[0].tolist() == want[sums[want] >= least].tolist()


def test_impacts_beyond_64_bits():
    got = treap_search.impacts(np.array([3]), np.array([10 ** 9]), 10 ** 12, 10 ** 15)
    assert got.tolist() == [10 ** 9 * 3 // (3000 + 12 * (75 + 25 * 10 ** 9 * 10 ** 12 // 10 ** 15))]


def lines_by_hand(rows, chars, documents):
    def key(line):
        return small(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))

    held = {}
    for i, (doc_id, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            held.setdefault(k, []).append((doc_id is not None, doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(key(line)) < chars or len(held[key(line)]) < documents
                or (doc_id is not None, doc_id) == max(held[key(line)], key=lambda h: (h[0], h[1] or 0))]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "a line of enough characters to be of interest "


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(f"{'  ' * int(j % 2)}{LONG}{int(rng.integers(0, 400))}\t" for j in range(int(rng.integers(0, 6)))))
            for i in range(700)]
    rows += [(3000 + i, f"{LONG.upper()}hot\nshort\n\n{LONG}hot\r\n") for i in range(300)]
    rows += [(None, f"{LONG}hot"), (None, f"{LONG}nobody"), (9, f"{LONG}{9}"), (9, rows[9][1]), (4000, None), (4001, ""),
             (4002, "\n\n"), (4003, "é" * 39), (4004, "\n".join([f"{LONG}{i % 7}" for i in range(20_000)]))]
    rows += [(5000 + i, "ñ" * 40 + "\n" + "x" * 39) for i in range(5)]
    rows += [(None, f"{LONG}only without id") for _ in range(6)]
    return rows


@pytest.mark.parametrize("parameters", [{}, {"segment_lines": 100}, {"segment_lines": 100, "most_bytes": 8}])
def test_line_dedup_equals_counting_all_lines(spark, pages, parameters):
    docs = spark.createDataFrame(pages, "doc_id long, text string").repartition(6)
    got = sorted([tuple(r) for r in line_filters.digests(docs, **parameters).collect()], key=str)
    assert got == lines_by_hand(pages, 40, 5)


def test_line_dedup_keeps_other_columns(spark):
    rows = [(i, f"{LONG}same\nown {i}", i * 2, "k") for i in range(6)] + [(7, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, key string")
    got = {r["doc"]["doc_id"]: r for r in line_filters.deduplicated(docs).collect()}
    assert got[0]["doc"].asDict() == {"doc_id": 0, "text": "own 0", "n_lines": 0, "key": "k"}
    assert got[5]["doc"]["text"] == f"{LONG}same\nown 5" and got[5]["n_dropped"] == 0 and got[0]["n_dropped"] == 1
    assert got[7]["doc"]["text"] is None and got[7]["n_lines"] == 1
    assert line_filters.digests(docs.limit(0)).count() == 0
    assert line_filters.digests(docs.where("text IS NULL")).count() == 1


def test_filters_know_every_repeated_hash_and_few_others(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    repeated = hashes[:3000]
    parts = [p.tobytes() for p in np.array_split(np.concatenate((hashes, repeated)), 40)]
    rows = spark.createDataFrame([(len(p) // 8, bytearray(p)) for p in parts], "n long, hashes binary")
    for size, most, false in ((1 << 20, 1 << 20, 0.03), (5000, 1 << 20, 0.03), (5000, 1500, 1.0)):
        known = line_filters.repeated_hashes(rows, size, most)
        assert known.has(repeated).all()
        assert known.has(hashes[3000:]).mean() <= false
        assert len(known.packed) <= max(most, 8 * len(known.masks))


def test_line_spans():
    texts = pa.array(["", "a\n b \n", None, "\n", " é\t\n\x0bX"])
    lines = line_filters.text_lines(texts)
    keys = [bytes(lines.data[a:b]).decode() for a, b in zip(lines.starts, lines.ends)]
    assert keys == ["", "a", "b", "", "", "", "", "é", "x"]
    assert lines.counts.tolist() == [1, 3, 1, 2, 2] and lines.chars.tolist() == [0, 1, 1, 0, 0, 0, 0, 1, 1]
    assert lines.number.tolist() == [0, 0, 1, 2, 0, 0, 1, 0, 1] and lines.owner.tolist() == [0, 1, 1, 1, 2, 3, 3, 4, 4]


def clusters_by_hand(rows, k, rounds):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None,
                                                    hashlib.sha256(f"2:{kept[r][0]}".encode()).hexdigest(), kept[r][1].tolist()))
    centroids = [kept[r][1] for r in order[:k]]

    def assigned():
        return [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assigned()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if members:
                centroids[j] = np.array([int(s) // len(members) for s in sum(members)])
    own = assigned()
    total = Counter()
    for d, j in own:
        total[j] += d
    return sorted([(i, j, d, total[j], sum(total.values()),
                    hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, own)], key=str)


def test_clusters_equal_comparing_all(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + rng.normal(scale=0.4, size=8)).tolist()) for i in range(300)]
    rows += [(400 + i, [0.25] * 8) for i in range(200)]  # one vector many times
    rows += [(None, [0.5] * 8), (7, rows[7][1]), (7, [0.1] * 8), (900, [-3000.5] * 8)]
    bad = [(901, None), (902, [1.0] * 7), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] * 8),
           (906, []), (907, [1e30] * 8)]
    table = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, cluster int")
    for k in (12, 1000, 1):
        got = simplex_clusters.clustered(table.repartition(4), clusters=k, rounds=3, dimensions=8).collect()
        assert sorted([tuple(r) for r in got], key=str) == clusters_by_hand(rows, k, 3)
    assert simplex_clusters.clustered(table.where("vec_id > 900"), dimensions=8).count() == 0
    assert simplex_clusters.clustered(table.limit(0)).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-256, 256, (2000, 64)) + np.repeat(rng.integers(-400, 400, (20, 64)), 100, axis=0)
    centroids = vectors[::50].copy()
    centroids[3] = centroids[2]  # equal centroids, and pivots in one plane
    simplex = simplex_clusters.Simplex(centroids)
    assert 10 < len(simplex.pivots) <= simplex_clusters.PIVOTS
    may = simplex_clusters.possible(simplex.apexes(vectors), simplex.apexes(centroids))
    exact = simplex_clusters.squared_distances(vectors, centroids)
    assert may[exact == exact.min(axis=1, keepdims=True)].all()
    assert may.mean() < 0.5
    found, away = simplex_clusters.nearest(vectors, simplex.apexes(vectors), centroids, simplex.apexes(centroids))
    assert found.tolist() == exact.argmin(axis=1).tolist() and away.tolist() == exact.min(axis=1).tolist()


@pytest.mark.parametrize("module", [treap_search, line_filters, simplex_clusters])
def test_sql_is_valid(module):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for view in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{folder}/{view}.parquet'")
    assert connection.execute(module.ORACLE).fetchall()
