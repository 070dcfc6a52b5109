"""The mix against a step-by-step version: targets, whole passes, and who is cut."""

import re

import pytest
from pyspark.sql import functions as F

from cartlake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights=(5, 2, 1), repeats=3):
    """sizes: per source; None sorts last. Shares are dealt again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > repeats * sizes[s]]
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = repeats * sizes[s]
        left = sum(sizes.values()) - sum(target.values())
        open_ -= set(above)
    return target


def corpus(spark):
    rows = []
    for i in range(400):
        source = [None, "a", "b", "ä", "zz", "hot", "hot", "hot", "Z"][i % 9]
        size = [0, 1, 7, 130, 2500][i % 5] if i != 77 else 30_000
        rows.append((i, " ".join(f"w{j}" for j in range(size)) + "\t", source))
    rows += [(500, None, "a"), (501, "", "only-empty"), (None, "x y z", "b"), rows[3], rows[3]]
    return rows, spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, source string, size int, place int")


@pytest.fixture(scope="module")
def mix(spark):
    rows, docs = corpus(spark)
    return rows, mixing.mixed(docs, block_words=64)


def test_targets_and_amounts(mix):
    rows, found = mix
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = slow_targets(sizes)
    taken = found.taken.collect()
    assert len(taken) == len(rows)
    for source in sizes:
        own = [r for r in taken if r.source == source]
        assert {r.source_size for r in own} == {sizes[source]}
        assert own[0].target == pytest.approx(want[source], abs=1e-6)
        assert abs(sum(r.taken for r in own) - want[source]) <= 0.5001
    assert all(0 <= r.taken <= 3 * r.size for r in taken)
    # Passes are whole: within a source documents differ by at most one pass.
    for source in sizes:
        passes = [r.taken / r.size for r in taken if r.source == source and r.size]
        assert not passes or max(passes) - min(passes) <= 1


def test_the_schedule_takes_the_same_and_spreads_sources(mix):
    _, found = mix
    slots = found.schedule.groupBy("doc_id", "source").agg(F.sum("words").alias("w")).collect()
    per_doc = {}
    for r in found.taken.collect():
        key = (r.doc_id, r.source)
        per_doc[key] = per_doc.get(key, 0) + r.taken
    assert {(r.doc_id, r.source): r.w for r in slots} == {k: v for k, v in per_doc.items() if v}
    rows = sorted(found.schedule.collect(), key=lambda r: r.slot)
    total, seen, shares = sum(r.words for r in rows), 0, {}
    for r in rows:
        shares[r.source] = shares.get(r.source, 0) + r.words
    running = {s: 0 for s in shares}
    for r in rows:
        seen += r.words
        running[r.source] += r.words
        for s in shares:
            assert abs(running[s] - shares[s] * seen / total) < 64 * 12
    assert all(r.words <= 64 for r in rows)


def test_reruns_agree(spark, mix):
    _, docs = corpus(spark)
    again = mixing.mixed(docs.repartition(7), block_words=64).taken
    assert sorted(map(str, again.collect())) == sorted(map(str, mix[1].taken.collect()))


def test_repeated_rows_carry_the_words(spark, mix):
    rows, docs = corpus(spark)
    out = mixing.repeated(docs, block_words=64)
    assert out.columns == docs.columns
    words = out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    want = {}
    for r in mix[1].taken.collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    for r in words:
        assert r.n == want[r.source]
    originals = {t for _, t, _ in rows if t}
    assert all(any(o.startswith(r.text) for o in originals) for r in out.select("text").distinct().collect())


def test_tables_without_words(spark):
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mixed(docs).taken.collect()) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.repeated(docs).count() == 0
    empty = mixing.mixed(docs.limit(0))
    assert empty.taken.count() == 0 and empty.schedule.count() == 0


def test_rows_without_or_with_equal_ids_are_taken_each(spark):
    rows = [(None if i % 2 else 7, " ".join(f"{i}w{j}" for j in range(100)), "a") for i in range(10)]
    rows += [(i, " ".join(f"{i}z{j}" for j in range(700)), "b") for i in range(3)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, number int")
    taken = mixing.mixed(docs, block_words=64).taken
    want = sorted((r.doc_id or -1, r.taken) for r in taken.collect() if r.taken)
    out = mixing.repeated(docs, block_words=64)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        key = r.text.split()[0]
        got[key, r.doc_id or -1] = got.get((key, r.doc_id or -1), 0) + len(r.text.split())
    assert sorted((doc_id, n) for (_, doc_id), n in got.items()) == want


@pytest.mark.parametrize("words, size", [(10 ** 13 + 12345, 1024), (1000, 64), (64, 64), (65, 64), (3, 1), (10 ** 17, 1024)])
def test_blocks_of_sources_of_any_size(spark, words, size):
    """Edges and block numbers agree, without overflow in a source of 10^13 words and more."""
    blocks = -(-words // size)
    q, r = divmod(words, blocks)
    edge = lambda b: b * q + min(b, r)
    some = sorted({b for b in (0, 1, r - 1, r, r + 1, blocks // 2, blocks - 1) if 0 <= b < blocks})
    table = spark.createDataFrame([(b, words, blocks, edge(b), edge(b + 1) - 1) for b in some],
                                  "b long, words long, blocks long, first long, last long")
    for row in table.select("*", mixing.block_edge("b").alias("e"), mixing.block_of("first").alias("f"),
                            mixing.block_of("last").alias("l")).collect():
        assert row.e == row["first"] and row.f == row.b and row.l == row.b
    assert edge(blocks) == words
