"""Line dedup with two Bloom filters: once-seen and twice-seen hashes of lines.

A line's key is the line without space characters at both ends and with A-Z lower-cased. Keys of at
least ``least_chars`` code points found in at least ``least_documents`` documents lose all their lines
except those in the largest doc_id that holds them.

1. Tasks hash the keys of their documents; equal hashes of a task become one entry, marked when two
   documents held it. Entries, 8 bytes each, go to segments of the hash space; no text is shuffled.
2. A segment's task keeps two Bloom filters of fixed size. A hash that the first one knows already, or
   that is marked, enters the second. Only the second filters are kept, folded to the size that their
   entries need and to at most MOST_FILTER_BYTES in all.
3. Lines whose hash the second filter of their segment knows are suspects; only they shuffle, with their
   whole keys, to count documents exactly and to find the largest doc_id. Every repeated key is a suspect
   at any filter size: fuller filters only let more lines through to the exact count.
4. Documents without suspects are done; the others are joined with the numbers of their dropped lines.

Rows are documents: rows that repeat are counted each, and rows that share the largest doc_id all keep
the line. Rows without a doc_id count too, and keep a line only if no row with a doc_id holds it. A NULL
or empty text is one empty line; a NULL text stays NULL. An empty table gives an empty result. Extra
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.llm.shipping import shipped
from cartlake.llm.words import LOWER, SPACES, flat_bytes, mixed, span_hashes, text_chunks
from cartlake.operators.staging import staged

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
#: Line hashes per segment on average, and the number of segments at most (beyond it segments grow).
SEGMENT_LINES = 1 << 20
MOST_SEGMENTS = 1 << 16
#: Bits per line of a segment's filters, and bits that a hash sets.
BITS_PER_LINE = 16
PROBES = 4
#: A folded filter keeps at least so many bits for every bit that is set.
ROOM = 6
#: All second filters together, as shipped to the tasks.
MOST_FILTER_BYTES = 1 << 26
#: Hashes that a task collects before it sends them on.
HELD_HASHES = 1 << 21


@dataclass
class Lines:
    """The lines of several texts: key i is data[starts[i]:ends[i]], line ``number`` of text ``owner``."""

    data: np.ndarray
    owner: np.ndarray
    number: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    chars: np.ndarray
    counts: np.ndarray  # lines of each text


def text_lines(texts: pa.Array) -> Lines:
    raw, offsets = flat_bytes(texts)
    data = LOWER[raw]
    breaks = np.flatnonzero(data == ord("\n"))
    of_break = np.searchsorted(offsets, breaks, side="right") - 1
    counts = np.bincount(of_break, minlength=len(texts)).astype(np.int64) + 1
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    begin, end = np.zeros(total, np.int64), np.zeros(total, np.int64)
    after = np.arange(len(breaks)) + of_break + 1
    begin[first], begin[after] = offsets[:-1], breaks + 1
    end[first + counts - 1], end[after - 1] = offsets[1:], breaks
    solid = np.append(np.flatnonzero(~SPACES[data]), len(data))
    left, right = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    filled = right > left
    starts = np.where(filled, solid[left], begin)
    ends = np.where(filled, solid[np.maximum(right, 1) - 1] + 1, begin)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    owner = np.repeat(np.arange(len(texts)), counts)
    return Lines(data, owner, np.arange(total) - first[owner], starts, ends, points[ends] - points[starts], counts)


def long_lines(lines: Lines, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines with long keys, the hashes of their keys, and whether a key is the first of its text."""
    rows = np.flatnonzero(lines.chars >= least_chars)
    hashes = span_hashes(lines.data, lines.starts[rows], lines.ends[rows])
    order = np.lexsort((hashes, lines.owner[rows]))
    first = np.ones(len(rows), bool)
    first[order[1:]] = (hashes[order][1:] != hashes[order][:-1]) | (
        lines.owner[rows][order][1:] != lines.owner[rows][order][:-1])
    return rows, hashes, first


def bit_places(hashes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """[probe, hash]: the bits of each hash in a filter of mask + 1 bits, a power of two."""
    step = mixed(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & mask for i in range(PROBES)])


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


class Filter:
    """A Bloom filter; one byte per bit while it is filled."""

    def __init__(self, bits: int):
        self.bits = np.zeros(bits, bool)
        self.mask = np.uint64(bits - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[bit_places(hashes, self.mask)].all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        self.bits[bit_places(hashes, self.mask)] = True

    def folded(self, most: int) -> np.ndarray:
        """The bits, laid over each other as long as there is room for them, and until they are ``most`` or fewer."""
        bits = self.bits
        while len(bits) > 64 and (len(bits) > most or len(bits) // 2 > ROOM * int(bits.sum())):
            bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
        return bits


@dataclass
class SegmentFilters:
    """The folded filters of all segments in a row: segment s begins at bit begins[s] and has masks[s] + 1 bits."""

    packed: np.ndarray
    begins: np.ndarray
    masks: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        segment = segment_of(hashes, len(self.masks)).astype(np.int64)
        places = bit_places(hashes, self.masks[segment]) + self.begins[segment]
        return ((self.packed[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _power_of_two(n: int) -> int:
    return 1 << max(6, (max(n, 1) - 1).bit_length())


def repeated_hashes(rows: DataFrame, segment_lines: int = SEGMENT_LINES,
                    most_bytes: int = MOST_FILTER_BYTES) -> SegmentFilters | None:
    """The second filters over ``rows`` (n, hashes: packed, each of them once per document); None without hashes."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    segments = min(-(-total // segment_lines), MOST_SEGMENTS)
    bits = _power_of_two(BITS_PER_LINE * -(-total // segments))
    most_bits = _power_of_two(max(64, most_bytes * 8 // segments // 2 + 1))

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        segment = segment_of(hashes, segments)  # ascending, as the hashes are
        parts, start = np.unique(segment, return_index=True)
        ends = np.append(start[1:], len(hashes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts.astype(np.int32)),
             pa.array([hashes[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()),
             pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(start, ends)], pa.binary())],
            ["segment", "hashes", "marked"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch["hashes"]:
                held.append(np.frombuffer(value.as_buffer(), np.uint64).copy())
                size += len(held[-1])
                if size >= HELD_HASHES:
                    yield from sent(held)
                    held, size = [], 0
        if size:
            yield from sent(held)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def ended() -> pa.RecordBatch:
            kept = twice.folded(most_bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([len(kept)], pa.int64()),
                 pa.array([np.packbits(kept, bitorder="little").tobytes()], pa.binary())], ["segment", "size", "bits"])

        for batch in batches:
            for segment, packed, marks in zip(batch["segment"].to_pylist(), batch["hashes"], batch["marked"]):
                if segment != now:
                    if now is not None:
                        yield ended()
                    now, once, twice = segment, Filter(bits), Filter(bits)
                hashes = np.frombuffer(packed.as_buffer(), np.uint64)
                marked = np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8), count=len(hashes)).astype(bool)
                twice.add(hashes[marked | once.has(hashes)])
                once.add(hashes)
        if now is not None:
            yield ended()

    # Rows of a segment arrive together, so a task holds the two filters of one segment at a time.
    found = rows.select("hashes").mapInArrow(routed, "segment int, hashes binary, marked binary").repartition(
        int(segments), "segment").sortWithinPartitions("segment").mapInArrow(filtered, "segment int, size long, bits binary")
    sizes, packed = np.full(segments, 64, np.uint64), [bytes(8)] * segments
    for row in found.collect():
        sizes[row["segment"]], packed[row["segment"]] = row["size"], bytes(row["bits"])
    return SegmentFilters(np.frombuffer(b"".join(packed), np.uint8),
                          np.concatenate((np.zeros(1, np.uint64), np.cumsum(sizes)[:-1])), sizes - np.uint64(1))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for batch in batches:
        with_text = pa.RecordBatch.from_arrays([batch["doc"], batch["doc"].field("text")], ["doc", "text"])
        for part in text_chunks(with_text):
            yield part, text_lines(part["text"])


def _strings(lines: Lines, rows: np.ndarray) -> pa.Array:
    """The keys of the chosen lines."""
    lengths = lines.ends[rows] - lines.starts[rows]
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    places = np.arange(bounds[-1]) + np.repeat(lines.starts[rows] - bounds[:-1], lengths)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(bounds.astype(np.int32).tobytes()),
                                       pa.py_buffer(lines.data[places].tobytes()))


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS,
                 segment_lines: int = SEGMENT_LINES, most_bytes: int = MOST_FILTER_BYTES) -> DataFrame:
    """The rows of ``docs`` without dropped lines in ``text``, as ``doc`` (a row of the same columns), with
    ``n_lines`` (before) and ``n_dropped``."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lines in _documents(batches):
            _, hashes, first = long_lines(lines, least_chars)
            if len(hashes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(first.sum())]), pa.array([hashes[first].tobytes()], pa.binary())], ["n", "hashes"])

    only_text = docs.select(F.struct("text").alias("doc"))
    repeated = repeated_hashes(staged(only_text.mapInArrow(hashed, "n long, hashes binary"), "line-hashes"),
                               segment_lines, most_bytes)
    filters = shipped(spark, repeated)
    suspects_type = pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string()), ("first", pa.bool_())]))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters()
        for part, lines in _documents(batches):
            some, hashes, first = long_lines(lines, least_chars)
            hit = known.has(hashes) if known is not None else np.zeros(len(some), bool)
            some, first = some[hit], first[hit]
            sizes = np.bincount(lines.owner[some], minlength=part.num_rows)
            found = pa.StructArray.from_arrays(
                [pa.array(lines.number[some].astype(np.int32)), _strings(lines, some), pa.array(first)],
                fields=list(suspects_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [part["doc"], pa.array(lines.counts),
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), found)],
                ["doc", "n_lines", "suspects"])

    schema = T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType), T.StructField("n_lines", T.LongType()),
        T.StructField("suspects", T.ArrayType(T.StructType([
            T.StructField("line", T.IntegerType()), T.StructField("key", T.StringType()),
            T.StructField("first", T.BooleanType())])))])
    marked = staged(rows.mapInArrow(suspected, schema).withColumn("row_id", F.monotonically_increasing_id()),
                    "suspected-lines")

    held = marked.where(F.size("suspects") > 0).select(
        "row_id", F.col("doc.doc_id").alias("doc_id"), F.explode("suspects").alias("s")).select("row_id", "doc_id", "s.*")
    frequent = staged(held.where("first").groupBy("key").agg(F.count("*").alias("documents"), F.max("doc_id").alias("last"))
                      .where(F.col("documents") >= least_documents).select("key", "last"), "frequent-lines")
    dropped = held.select("row_id", "doc_id", "line", "key").join(frequent, "key").where(
        ~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("row_id").agg(F.collect_list("line").alias("dropped"))

    clean = marked.where(F.size("suspects") == 0).select("doc", "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    joined = marked.where(F.size("suspects") > 0).select("row_id", "doc", "n_lines").join(dropped, "row_id", "left")
    pieces = F.split("doc.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.col("doc.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("pieces", i)), "\n"))
    cut = joined.withColumn("pieces", pieces).select(
        F.col("doc").withField("text", text).alias("doc"), "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
    return clean.unionByName(cut)


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text of every document."""
    return deduplicated(docs.select("doc_id", "text"), **parameters).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.coalesce("doc.text", F.lit("")), 256).alias("kept_sha256"))


#: The same in SQL, counting every line exactly.
ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS pieces FROM documents),
lines AS (SELECT row_id, doc_id, unnest(pieces) AS line, unnest(range(len(pieces))) AS i FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {LEAST_CHARS}
             GROUP BY key HAVING count(DISTINCT row_id) >= {LEAST_DOCUMENTS}),
judged AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS dropped
           FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY row_id"""
