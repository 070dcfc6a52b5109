"""SimHash near-duplicates: fingerprints, and all pairs within a few bits by generalised pigeonhole.

The bits are grouped so that correlated bits share a partition. For a distance limit r and a
fingerprint with thresholds t_1 .. t_m (each at least -1) whose t_i + 1 add up to r + 1, every
fingerprint within r bits differs in at most t_i bits in some partition i: if it differed by
t_i + 1 or more in each, it would differ in r + 1 bits or more. So each fingerprint may choose
its own thresholds; a dynamic program takes those with the fewest estimated candidates. It then
probes the index with every value within t_i bits of its own, and verifies the distance.

Equal texts give equal fingerprints and are one entry of the search, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.llm.components import components
from cartlake.llm.shipping import shipped
from cartlake.llm.words import split_words, text_chunks
from cartlake.operators.staging import staged

BITS = 64
#: Bits of a partition's value that the candidate estimate tells apart; it treats further bits as even.
ESTIMATE_BITS = 16
#: Most bits of one partition; with 64 bits and 16 per partition the fewest partitions are four.
PARTITION_BITS = 32
#: Weight of one probe against one candidate in the cost that chooses thresholds.
PROBE_COST = 1.0
PROBES_AT_ONCE = 1 << 18


# --- fingerprints -----------------------------------------------------------------------------

def text_fingerprints(texts: pa.Array, shingle: int, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text: each bit is the majority over the shingles' XXH64."""
    words = split_words(texts)
    out = np.zeros(len(texts), np.uint64)
    lengths = words.ends - words.starts
    # All words of a chunk, each followed by one space: a shingle is one slice of this.
    joined_ends = np.cumsum(lengths + 1)
    joined = np.full(int(joined_ends[-1]) if len(lengths) else 0, 0x20, np.uint8)
    inside = np.arange(int(lengths.sum()))
    first = np.cumsum(lengths) - lengths
    joined[inside + np.repeat(np.arange(len(lengths)), lengths)] = words.data[
        inside + np.repeat(words.starts - first, lengths)]
    raw, bounds = joined.tobytes(), words.bounds
    begin = (joined_ends - lengths - 1).tolist()
    end = (joined_ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for d in np.flatnonzero(words.counts):
        a, b = int(bounds[d]), int(bounds[d + 1])
        k = min(shingle, b - a)
        hashes = np.array([digest(raw[x:y], seed) for x, y in zip(begin[a:b - k + 1], end[a + k - 1:b])], np.uint64)
        out[d] = _majority(hashes)
    return out


def _majority(hashes: np.ndarray) -> np.uint64:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprinted(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The columns of ``docs`` other than the text, and the fingerprint as a long (the unsigned value's bits).

    Words are lower-cased (A-Z). A text with fewer words than a shingle has one shingle, its whole
    sequence; a text without words, or NULL, has fingerprint zero.
    """
    kept = [f for f in docs.schema if f.name not in (text, name)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text):
                prints = text_fingerprints(part[text], shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(prints)], [*names, name])

    return docs.select(*names, text).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


# --- partitions and thresholds ----------------------------------------------------------------

def _bit_matrix(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def pair_counts(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have both bit i and bit j; 64 x 64, summed over all rows by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch["print"].to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 16):
                bits = _bit_matrix(values[at:at + (1 << 16)]).astype(np.float32)
                both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(both.ravel())], ["cell", "n"])

    rows = prints.select("print").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS)
    for cell, n in rows.collect():  # 4,096 numbers at any size
        out[cell] = n
    return out.reshape(BITS, BITS)


def correlated_groups(both: np.ndarray, total: int, groups: int) -> list[list[int]]:
    """Bits in ``groups`` groups of nearly equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = (BITS - sum(map(len, out))) // (groups - g)
        group = [max(sorted(free), key=lambda b: sum(link[b, x] for x in free))]
        free.remove(group[0])
        while len(group) < size:
            nearest = max(sorted(free), key=lambda b: sum(link[b, x] for x in group))
            group.append(nearest)
            free.remove(nearest)
        out.append(sorted(group))
    return out


def partition_value(prints: np.ndarray, group: list[int]) -> np.ndarray:
    values = np.zeros(len(prints), np.int64)
    unsigned = prints.view(np.uint64)
    for k, bit in enumerate(group):
        values |= ((unsigned >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return values


def near_counts(histogram: np.ndarray, width: int, radius: int) -> np.ndarray:
    """[t, v]: estimated entries within t bits of a value whose low bits are v, for t up to ``radius``."""
    known = int(np.log2(len(histogram)))
    exact = [histogram.astype(np.float64)] + [np.zeros(len(histogram)) for _ in range(radius)]
    index = np.arange(len(histogram))
    for bit in range(known):
        flipped = [x[index ^ (1 << bit)] for x in exact]
        exact = [exact[0]] + [exact[d] + flipped[d - 1] for d in range(1, radius + 1)]
    rest = width - known
    at = [sum(exact[d - e] * comb(rest, e) / 2.0 ** rest for e in range(min(d, rest) + 1)) for d in range(radius + 1)]
    return np.cumsum(at, axis=0)


@dataclass
class Layout:
    """The partitions and, for each, the estimated cost of every threshold from -1 to the limit."""

    groups: list[list[int]]
    costs: list[np.ndarray]  # one per partition: [t + 1, low bits of the value]
    limit: int

    def thresholds(self, prints: np.ndarray) -> np.ndarray:
        """[row, partition]: the thresholds with the least estimated cost, by dynamic programming.

        best[s] is the least cost with which the partitions so far use s of the limit + 1 units.
        """
        units = self.limit + 1
        best = np.full((units + 1, len(prints)), np.inf)
        best[0] = 0
        choice = []
        for group, cost in zip(self.groups, self.costs):
            own = cost[:, partition_value(prints, group) & (cost.shape[1] - 1)]
            ahead = np.full_like(best, np.inf)
            taken = np.zeros(best.shape, np.int8)
            for s in range(units + 1):
                for u in range(s + 1):
                    total = best[s - u] + own[u]
                    better = total < ahead[s]
                    ahead[s][better] = total[better]
                    taken[s][better] = u
            best = ahead
            choice.append(taken)
        left = np.full(len(prints), units)
        out = np.zeros((len(prints), len(self.groups)), np.int8)
        for i in range(len(self.groups) - 1, -1, -1):
            used = choice[i][left, np.arange(len(prints))]
            out[:, i] = used - 1
            left = left - used
        return out


def _probes(width: int, radius: int) -> int:
    return sum(comb(width, d) for d in range(radius + 1))


def even_cost(total: int, partitions: int, limit: int) -> float:
    """Rows that probing makes per fingerprint, were all bits even and independent."""
    width, units = BITS // partitions, limit + 1
    best = [0.0] + [float("inf")] * units
    for _ in range(partitions):
        best = [min(best[s - u] + (_probes(width, u - 1) * (PROBE_COST + total / 2.0 ** width) if u else 0.0)
                    for u in range(s + 1)) for s in range(units + 1)]
    return best[units]


def layout(prints: DataFrame, total: int, limit: int) -> Layout:
    """Partitions and costs for all fingerprints; the histograms are counted over all rows and have a fixed size."""
    fewest = -(-BITS // PARTITION_BITS)
    partitions = min(range(fewest, max(fewest, limit + 1) + 1), key=lambda m: even_cost(total, m, limit))
    groups = correlated_groups(pair_counts(prints), total, partitions)
    kept_bits = [min(len(g), ESTIMATE_BITS) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << k, np.int64) for k in kept_bits]
        for batch in batches:
            values = batch["print"].to_numpy(zero_copy_only=False)
            for i, (group, k) in enumerate(zip(groups, kept_bits)):
                sums[i] += np.bincount(partition_value(values, group[:k]), minlength=1 << k)
        for i, s in enumerate(sums):
            seen = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), i, np.int32)), pa.array(seen), pa.array(s[seen])], ["part", "value", "n"])

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(1 << ESTIMATE_BITS)
        sums[rows["value"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "sums": [sums.tobytes()]})

    # At most 2^16 values per partition at any size: half a megabyte for each comes back.
    counted = prints.select("print").mapInArrow(run, "part int, value long, n long").groupBy("part", "value").agg(
        F.sum("n").alias("n")).groupBy("part").applyInPandas(gathered, "part int, sums binary").collect()
    found = {r["part"]: np.frombuffer(r["sums"]) for r in counted}
    costs = []
    for i, (group, k) in enumerate(zip(groups, kept_bits)):
        histogram = found[i][:1 << k] if i in found else np.zeros(1 << k)
        near = near_counts(histogram, len(group), limit)
        probes = np.array([[PROBE_COST * _probes(len(group), t)] for t in range(limit + 1)])
        costs.append(np.vstack([np.zeros((1, 1 << k)), near + probes]).astype(np.float32))
    return Layout(groups, costs, limit)


# --- search -----------------------------------------------------------------------------------

def _index_rows(prints: DataFrame, groups: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["print"].to_numpy(zero_copy_only=False)
            for i, group in enumerate(groups):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), i, np.int32)), pa.array(partition_value(values, group)),
                     batch["print"]], ["part", "value", "print"])

    return prints.select("print").mapInArrow(run, "part int, value long, print long")


def _probe_rows(prints: DataFrame, plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: Layout = plan()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                values = batch["print"].slice(at, 4096).to_numpy(zero_copy_only=False)
                limits = chosen.thresholds(values)
                for i, group in enumerate(chosen.groups):
                    own = partition_value(values, group)
                    for radius in range(chosen.limit + 1):
                        rows = limits[:, i] >= radius
                        if not rows.any():
                            continue
                        masks = np.array([sum(1 << b for b in flip) for flip in combinations(range(len(group)), radius)],
                                         np.int64)
                        step = max(1, PROBES_AT_ONCE // len(masks))
                        for k in range(0, int(rows.sum()), step):
                            some, owner = own[rows][k:k + step], values[rows][k:k + step]
                            probes = (some[:, None] ^ masks[None, :]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(probes), i, np.int32)), pa.array(probes),
                                 pa.array(np.repeat(owner, len(masks)))], ["part", "value", "probe"])

    return prints.select("print").mapInArrow(run, "part int, value long, probe long")


def near_pairs(prints: DataFrame, total: int, limit: int) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints in ``prints`` that differ in 1 to ``limit`` bits.

    The distance is part of the join condition, so candidates that fail it are never rows.
    A pair can come once from either side.
    """
    chosen = layout(prints, total, limit)
    plan = shipped(prints.sparkSession, chosen)
    probes = _probe_rows(prints, plan).alias("q")
    index = _index_rows(prints, chosen.groups).alias("x")
    close = F.bit_count(F.col("q.probe").bitwiseXOR(F.col("x.print"))) <= limit
    return probes.join(index, (F.col("q.part") == F.col("x.part")) & (F.col("q.value") == F.col("x.value"))
                       & (F.col("q.probe") != F.col("x.print")) & close).select(
        F.col("q.probe").alias("a"), F.col("x.print").alias("b"))


def linked_prints(distinct: DataFrame, limit: int) -> DataFrame:
    """(node, component) of the fingerprints in ``distinct`` with a near one; the smallest of a component is its name."""
    return staged(components(near_pairs(distinct, distinct.count(), limit)), "fingerprint-components")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 3, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    ``component_id`` is the smallest doc_id that can be reached over fingerprints which differ in at
    most ``limit`` bits, itself included. Rows without a doc_id take part in links but name no
    component; a component of such rows only has component_id NULL. Repeated rows are returned as
    often as they occur; other columns are not used. An empty table gives an empty result.
    """
    prints = staged(fingerprinted(docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                                              F.col(text).alias("text")), shingle), "fingerprints")
    distinct = staged(prints.groupBy(F.col("fingerprint").alias("print")).agg(F.min("doc_id").alias("least")),
                      "distinct-fingerprints")
    groups = linked_prints(distinct, limit)
    linked = distinct.join(groups, F.col("print") == F.col("node"))
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    merged = staged(linked.select("print", "component").join(names, "component").select("print", "component_id"),
                    "component-names")
    of_print = distinct.join(merged, "print", "left").select(
        "print", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(of_print, F.col("fingerprint") == F.col("print"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that of the smallest doc_id.

    Every row is numbered first and groups are made of rows, so each group keeps a row even where ids repeat or
    are missing: rows without an id come last, and of rows with equal ids the first one stays.
    """
    # The row travels as one value, so its columns may have any names.
    numbered = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
                      .withColumn("number", F.monotonically_increasing_id()), "numbered-documents")
    prints = fingerprinted(numbered.select("number", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text"), shingle)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "number")
    distinct = staged(prints.groupBy(F.col("fingerprint").alias("print")).agg(F.min(order).alias("best")),
                      "distinct-fingerprints")
    groups = linked_prints(distinct, limit)
    kept = distinct.join(groups, F.col("print") == F.col("node"), "left").groupBy(
        F.coalesce("component", "print").alias("group")).agg(F.min("best").alias("best")).select("best.number")
    return numbered.join(kept, "number", "left_semi").select([F.col("doc")[c].alias(c) for c in docs.columns])
