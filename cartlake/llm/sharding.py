"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VIRTUAL_NODES`` points of a ring; a document belongs to the first point clockwise of
its own position. A shard is full when it holds ``slack`` more bytes than its even share; a document
that meets a full shard goes on clockwise to the next point of a shard with room. So shards stay nearly
equal, and a changed number of shards moves little.

The ring is cut into a fixed number of cells. Spark sums the bytes of each cell; the walk around the
ring runs on these sums and says which part of a cell, in bytes from its start, goes to which shard.
Documents find their part by their place in their cell. Documents of more than 1 / GRAINS of a shard's
share are placed first and one by one, the largest first; there are fewer than GRAINS per shard. So the
walk sees at most CELLS + GRAINS * shards rows at any table size, and no shard or other list of documents
is gathered in one task.

A NULL text has no bytes (its size is 1). Documents without an id and repeated rows have positions like
any other. An empty table gives an empty result, and extra columns are not used.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlake.operators.staging import staged

VIRTUAL_NODES = 256
CELLS = 1 << 14
#: How much more than its even share a shard may hold.
SLACK = 0.001
GRAINS = 1024


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; a shard's nodes do not depend on the other shards."""
    points = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.sha256(f"{shard}/{node}".encode()).digest()
            points.append((int.from_bytes(digest[:8]), shard))
    return [(point * CELLS >> 64, shard) for point, shard in sorted(points)]


class Ring:
    """The walk around the ring: shards with the bytes that they still take."""

    def __init__(self, total: int, shards: int, slack: float, virtual_nodes: int = VIRTUAL_NODES):
        self.nodes = ring(shards, virtual_nodes)
        self.cells = [cell for cell, _ in self.nodes]
        self.room = [total * (1 + slack) / shards] * shards

    def shard_for(self, cell: int, size: int) -> int:
        """The first shard clockwise with room for ``size`` bytes, or else the one with most room."""
        at, seen = bisect_right(self.cells, cell), set()
        for k in range(len(self.nodes)):
            shard = self.nodes[(at + k) % len(self.nodes)][1]
            if self.room[shard] >= size:
                return shard
            seen.add(shard)
            if len(seen) == len(self.room):
                break
        return max(range(len(self.room)), key=lambda s: self.room[s])

    def place(self, cell: int, size: int) -> int:
        shard = self.shard_for(cell, size)
        self.room[shard] -= size
        return shard

    def parts(self, cell: int, size: int) -> list[tuple[int, int, int]]:
        """(first byte, end byte, shard) of a cell's small documents: what a shard has no room for goes on."""
        out, done = [], 0
        while done < size:
            shard = self.shard_for(cell, 1)
            part = min(size - done, max(1, int(self.room[shard])))
            out.append((done, done + part, shard))
            self.room[shard] -= part
            done += part
        return out


def sharded(docs: DataFrame, shards: int = 16, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    ``size`` is the UTF-8 length of the text plus 1. The law is ``bytes``: shards hold nearly equal sizes.
    ``slot`` counts the documents of a shard from 0 in ring order. ``grown_shard`` is NULL under this law.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("position"))
        .withColumn("cell", F.expr(f"CAST(shiftrightunsigned(position, {64 - CELLS.bit_length() + 1}) AS INT)")),
        "ring-positions")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    in_cell = Window.partitionBy("cell", "large").orderBy("position", "doc_id", "text_crc32", "size")
    started = rows.withColumn("large", F.col("size") * (shards * GRAINS) > total).withColumn(
        "start", F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    walked = Ring(total, shards, slack)
    # Fewer than shards * GRAINS rows, then at most CELLS rows.
    large = started.where("large").select("cell", "start", "size").collect()
    cuts = [(cell, True, start, start + size, walked.place(cell, size))
            for cell, start, size in sorted(map(tuple, large), key=lambda r: (-r[2], r[0], r[1]))]
    loads = rows.where(F.col("size") * (shards * GRAINS) <= total).groupBy("cell").agg(F.sum("size")).collect()
    cuts += [(cell, False, *part) for cell, size in sorted(map(tuple, loads)) for part in walked.parts(cell, size)]
    parts = docs.sparkSession.createDataFrame(
        cuts, "of_cell int, of_large boolean, first long, end long, shard int").groupBy("of_cell", "of_large").agg(
        F.collect_list(F.struct("first", "end", "shard")).alias("parts"))
    placed = started.join(parts, (F.col("cell") == F.col("of_cell")) & (F.col("large") == F.col("of_large")))
    placed = staged(placed.withColumn("part", F.filter(
        "parts", lambda p: (p["first"] <= F.col("start")) & (F.col("start") < p["end"]))[0]).select(
        "doc_id", "size", "text_crc32", "cell", "large", "start", "part.shard", F.col("part.first").alias("first")),
        "ring-shards")
    before = Window.partitionBy("shard").orderBy("cell", "large", "first")
    offsets = placed.groupBy("shard", "cell", "large", "first").agg(F.count("*").alias("n")).select(
        "shard", "cell", "large", "first", (F.sum("n").over(before) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy("cell", "large", "first", "shard").orderBy("start")
    return placed.withColumn("rank", F.row_number().over(inside) - 1).join(
        offsets, ["cell", "large", "first", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("earlier") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
