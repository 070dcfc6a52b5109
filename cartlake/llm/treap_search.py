"""Ranked lexical search over a K2-treap: a compressed quadtree on the grid of terms and documents.

Documents are taken in blocks of those that a task reads, so no posting is shuffled. A block's grid has
one row per term and one column per document, in the order of doc_id; a cell's value is the impact of the
term in the document. The quadtree keeps only quarters that hold something, each with its largest impact.

An item follows the paths of its terms' rows together: a range of documents has one node per term, and
the weighted sum of their maxima bounds every score in the range. Ranges are opened best first, until
none can reach the k-th score found; a range of one document has its exact score. What a sample of the
blocks finds first gives every item a k-th score that the other blocks have to reach.

Statistics (N, L, df) are summed over all blocks before any impact is computed. Terms are compared by
64-bit hashes. The index holds the terms of the items; a bitmap of fixed size, made of all item terms, says
in tasks which terms may be asked for. Items are shipped in blocks of bounded size.

A NULL text has no terms. Documents without an id count and are ranked, after equal scores with an id;
rows that repeat are documents of their own. Items are rows, too: a repeated item is answered as often as
it occurs. An item without terms, or without a document that scores, has no rows. Empty tables give an
empty result, and extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlake.llm.shipping import shipped
from cartlake.llm.words import span_hashes, split_words, text_chunks
from cartlake.operators.staging import staged

K = 20
#: A block is closed at so many documents or postings (of a document's terms at most more).
BLOCK_DOCUMENTS = 1 << 14
BLOCK_POSTINGS = 1 << 20
#: Bits of the bitmap of item terms.
BITMAP_BITS = 1 << 22
#: Terms of the items that are shipped at once, on average.
ITEM_TERMS = 1 << 18
#: Ranges opened together.
OPENED = 256
#: One of so many blocks is searched first.
SAMPLED_BLOCKS = 32

#: All ASCII characters but letters and digits end a term.
BETWEEN_TERMS = np.zeros(256, bool)
BETWEEN_TERMS[:128] = [not chr(c).isalnum() for c in range(128)]

#: For each set of quarters present and each quarter: its place among them, or -1.
PLACES = np.array([[bin(held & ((1 << q) - 1)).count("1") if held >> q & 1 else -1 for q in range(4)]
                   for held in range(16)], np.int32)


def spread_bits(values: np.ndarray) -> np.ndarray:
    """Each bit moved to twice its place."""
    out = np.zeros(len(values), np.int64)
    for bit in range(int(values.max(initial=0)).bit_length()):
        out |= ((values >> bit) & 1) << (2 * bit)
    return out


class Treap:
    """The quadtree of one block, level by level in one row of nodes; the last node stands for empty quarters."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.height = max(int(rows.max(initial=0)).bit_length(), int(columns.max(initial=0)).bit_length(), 1)
        codes = spread_bits(rows.astype(np.int64)) << 1 | spread_bits(columns.astype(np.int64))
        order = np.argsort(codes, kind="stable")
        codes, largest = codes[order], impacts[order].astype(np.int64)
        held, levels = np.zeros(len(codes), np.uint8), []
        starts = np.zeros(len(codes), np.int64)
        for level in range(self.height, -1, -1):
            levels.append((largest, held, starts))
            if level and len(codes):
                parents = codes >> 2
                starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
                held = np.bitwise_or.reduceat((1 << (codes & 3)).astype(np.uint8), starts)
                largest = np.maximum.reduceat(largest, starts)
                codes = parents[starts]
        levels.reverse()
        begins = np.cumsum([0, *(len(largest) for largest, _, _ in levels)])
        self.largest = np.concatenate([largest for largest, _, _ in levels] + [np.zeros(1, np.int64)])
        self.held = np.concatenate([held for _, held, _ in levels] + [np.zeros(1, np.uint8)])
        self.first = np.concatenate(
            [starts + begins[i + 1] for i, (_, _, starts) in enumerate(levels)] + [np.zeros(1, np.int64)]).astype(np.int32)
        self.empty = len(self.largest) - 1

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the k best sums of weighted impacts that reach ``least``; ties to smaller columns."""
        turns = self.height - 1 - np.arange(self.height)
        row_bits = (rows[None, :] >> turns[:, None]) & 1
        best_columns, best_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        nodes = np.zeros((1, len(rows)), np.int32)
        bounds, level, prefix = np.array([least + 1]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        last = -1  # the column of the k-th score, once there are k
        while len(bounds):
            if len(bounds) > OPENED:
                chosen = np.zeros(len(bounds), bool)
                chosen[np.argpartition(bounds, len(bounds) - OPENED)[-OPENED:]] = True
            else:
                chosen = np.ones(len(bounds), bool)
            now, at, begin = nodes[chosen], level[chosen], prefix[chosen]
            held, first, bits = self.held[now], self.first[now], row_bits[at]
            opened = []
            for side in (0, 1):
                place = PLACES[held, 2 * bits + side]
                child = np.where(place >= 0, first + place, self.empty).astype(np.int32)
                opened.append((child, self.largest[child] @ weights, at + 1, 2 * begin + side))
            child, bound, deeper, begin = (np.concatenate(parts) for parts in zip(*opened))
            leaf = deeper == self.height
            done = leaf & (bound >= least)
            if done.any():
                best_columns, best_scores = np.append(best_columns, begin[done]), np.append(best_scores, bound[done])
                order = np.lexsort((best_columns, -best_scores))[:k]
                best_columns, best_scores = best_columns[order], best_scores[order]
                if len(order) == k:
                    least, last = int(best_scores[-1]), int(best_columns[-1])
            nodes = np.concatenate((nodes[~chosen], child[~leaf]))
            bounds = np.concatenate((bounds[~chosen], bound[~leaf]))
            level = np.concatenate((level[~chosen], deeper[~leaf]))
            prefix = np.concatenate((prefix[~chosen], begin[~leaf]))
            # A range that only equals the k-th score must hold a column before it.
            worth = (bounds > least) | (bounds == least) & (
                (last < 0) | (prefix << (self.height - level) < last))
            if not worth.all():
                nodes, bounds, level, prefix = nodes[worth], bounds[worth], level[worth], prefix[worth]
        return best_columns, best_scores


def terms_by_text(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; and owner, hash and count of the distinct terms that ``wanted`` may hold."""
    words = split_words(texts, separators=BETWEEN_TERMS)
    hashes, owner = span_hashes(words.data, words.starts, words.ends), words.text_of_word()
    if wanted is not None:
        some = wanted[hashes & np.uint64(len(wanted) - 1)]
        hashes, owner = hashes[some], owner[some]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return words.counts, owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_key (one per row), item_id, term (hash) and repeats of every distinct term of every item."""
    keyed = staged(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).withColumn(
        "item_key", F.monotonically_increasing_id()), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                _, owner, hashes, counts = terms_by_text(part["text"])
                yield pa.RecordBatch.from_arrays(
                    [part["item_key"].take(pa.array(owner)), part["item_id"].take(pa.array(owner)),
                     pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))],
                    ["item_key", "item_id", "term", "repeats"])

    return staged(keyed.mapInArrow(run, "item_key long, item_id long, term long, repeats long"), "item-terms")


def term_bitmap(terms: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Which low bits of hashes occur among the terms; at most ``bits`` numbers reach the driver."""
    wanted = np.zeros(bits, bool)
    places = terms.select(F.col("term").bitwiseAND(F.lit(bits - 1)).alias("place")).distinct().toArrow()["place"]
    wanted[places.to_numpy()] = True
    return wanted


POSTINGS = ("documents long, terms_held long, ids binary, named binary, lengths binary, terms binary, starts binary, "
            "columns binary, counts binary")
KINDS = {"ids": np.int64, "named": np.uint8, "lengths": np.int64, "terms": np.uint64, "starts": np.int64,
         "columns": np.int32, "counts": np.int64}


def _block(ids: np.ndarray, named: np.ndarray, lengths: np.ndarray, columns: np.ndarray, hashes: np.ndarray,
           counts: np.ndarray) -> pa.RecordBatch:
    """One row: the documents of a block in the order of their ids, and the postings of each term."""
    order = np.lexsort((ids, ~named))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    columns = place[columns]
    by_term = np.lexsort((columns, hashes))
    terms, starts = np.unique(hashes[by_term], return_index=True)
    values = {"ids": ids[order], "named": named[order], "lengths": lengths[order], "terms": terms, "starts": starts,
              "columns": columns[by_term], "counts": counts[by_term]}
    return pa.RecordBatch.from_arrays(
        [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
         *(pa.array([v.astype(KINDS[n]).tobytes()], pa.binary()) for n, v in values.items())],
        ["documents", "terms_held", *values])


def _values(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(batch[n][row].as_buffer(), KINDS[n]) for n in names]


def posting_blocks(docs: DataFrame, wanted: np.ndarray, doc_id: str = "doc_id", text: str = "text",
                   block_documents: int = BLOCK_DOCUMENTS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The documents in blocks, each with the postings of the wanted terms; only these are kept."""
    asked = shipped(docs.sparkSession, np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(asked()).astype(bool)
        held, size, postings = [], 0, 0
        for batch in batches:
            for chunk in text_chunks(batch):
                for at in range(0, chunk.num_rows, block_documents):
                    part = chunk.slice(at, block_documents)
                    lengths, owner, hashes, counts = terms_by_text(part["text"], bitmap)
                    named = part["doc_id"].is_valid().to_numpy(zero_copy_only=False)
                    if held and (size + len(lengths) > block_documents or postings + len(hashes) > block_postings):
                        yield _block(*map(np.concatenate, zip(*held)))
                        held, size, postings = [], 0, 0
                    held.append((part["doc_id"].fill_null(0).to_numpy(), named, lengths, owner + size, hashes, counts))
                    size, postings = size + len(lengths), postings + len(hashes)
        if held:
            yield _block(*map(np.concatenate, zip(*held)))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, POSTINGS).withColumn("block", F.monotonically_increasing_id())


def document_frequencies(blocks: DataFrame) -> DataFrame:
    """term and df, summed over all blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                terms, starts, columns = _values(batch, row, "terms", "starts", "columns")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms.view(np.int64)), pa.array(np.diff(np.append(starts, len(columns))))], ["term", "df"])

    return blocks.select("terms", "starts", "columns").mapInArrow(run, "term long, df long").groupBy("term").agg(
        F.sum("df").alias("df"))


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, terms_held: int) -> np.ndarray:
    """The part of a score that a term's count in a document of this length gives, before the term's weight."""
    if 25 * int(lengths.max(initial=0)) * documents < 1 << 62:
        m = 75 + 25 * lengths * documents // max(terms_held, 1)
    else:  # products beyond 64 bits
        m = 75 + (25 * lengths.astype(object) * documents // max(terms_held, 1)).astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def _found(blocks: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], least: dict[int, int], documents: int,
           terms_held: int, k: int) -> DataFrame:
    """item_key, doc_id and score of the k best of every block that reach the item's least score."""
    asked = shipped(blocks.sparkSession, (queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floors = asked()
        for batch in batches:
            for row in range(batch.num_rows):
                ids, named, lengths, terms, starts, columns, counts = _values(batch, row, *KINDS)
                if not len(columns):
                    continue
                term_rows = np.repeat(np.arange(len(terms)), np.diff(np.append(starts, len(columns))))
                treap = Treap(term_rows, columns, impacts(counts, lengths[columns], documents, terms_held))
                out = []
                for key, (hashes, weights) in items.items():
                    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                    here = terms[place] == hashes
                    if here.any():
                        found, scores = treap.best(place[here], weights[here], k, floors.get(key, 1))
                        out.append((np.full(len(found), key), found, scores))
                if out:
                    keys, found, scores = map(np.concatenate, zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(ids[found], mask=named[found] == 0), pa.array(scores)],
                        ["item_key", "doc_id", "score"])

    return blocks.mapInArrow(run, "item_key long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text",
           doc_id: str = "doc_id", text: str = "text", item_terms_at_once: int = ITEM_TERMS,
           sampled_blocks: int = SAMPLED_BLOCKS, **block_sizes: int) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents with the highest scores above 0 for every item."""
    spark = docs.sparkSession
    terms = item_terms(items, item_id, item_text)
    blocks = staged(posting_blocks(docs, term_bitmap(terms), doc_id, text, **block_sizes), "posting-blocks")
    documents, terms_held = blocks.agg(F.coalesce(F.sum("documents"), F.lit(0)),
                                       F.coalesce(F.sum("terms_held"), F.lit(0))).first()
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1)))
    turns = max(1, -(-terms.count() // item_terms_at_once))
    weighted = staged(terms.join(document_frequencies(blocks), "term").select(
        "item_key", "term", (weight * F.col("repeats")).cast("long").alias("weight"),
        F.expr(f"pmod(xxhash64(item_key), {turns})").alias("turn")).where("weight > 0"), "term-weights")
    best = Window.partitionBy("item_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    results = []
    for turn in range(turns):
        rows = weighted.where(F.col("turn") == turn).toArrow()
        keys, hashes, weights = (rows[c].to_numpy() for c in ("item_key", "term", "weight"))
        order = np.argsort(keys, kind="stable")
        names, start = np.unique(keys[order], return_index=True)
        parts = np.split(order, start[1:]) if len(names) else []
        queries = {int(n): (hashes[p].view(np.uint64), weights[p]) for n, p in zip(names, parts)}
        # The k-th score in a sample is a bound from below for the k-th of all.
        sample = blocks.where(F.expr(f"pmod(xxhash64(block), {sampled_blocks}) = 0"))
        top = _found(sample, queries, {}, documents, terms_held, k).withColumn("rank", F.row_number().over(best))
        least = {r["item_key"]: r["score"] for r in top.where(F.col("rank") == k).collect()}
        results.append(_found(blocks, queries, least, documents, terms_held, k))
    found = reduce(DataFrame.unionByName, results).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = terms.select("item_key", "item_id").distinct()
    return found.join(names, "item_key").select("item_id", "rank", "doc_id", "score")


#: The same in SQL, every document scored for every item.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH ids AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
words AS (SELECT row_id, doc_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
          FROM (SELECT row_id, doc_id, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM ids)),
lengths AS (SELECT row_id, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY row_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS held FROM lengths),
tf AS (SELECT row_id, term, count(*) AS tf FROM words GROUP BY row_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_key, item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS q
          FROM (SELECT row_number() OVER () AS item_key, item_id, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM benchmark)
          GROUP BY ALL),
weights AS (SELECT item_key, item_id, term, q * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM asked JOIN df USING (term), totals),
scores AS (
  SELECT item_key, item_id, row_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // held)))) AS BIGINT) AS score
  FROM weights JOIN tf USING (term) JOIN lengths USING (row_id), totals GROUP BY item_key, item_id, row_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_key ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN lengths USING (row_id) WHERE score > 0) WHERE rank <= {K}"""
