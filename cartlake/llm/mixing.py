"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a shuffled order (a hash of id and text) and read as one stream of
words, cut into blocks of equal size. The schedule is a row of slots: slot i belongs to the source in
whose part of the cumulative weights the i-th point of the golden-ratio sequence falls, so every stretch
of slots holds the sources in nearly their shares. The k-th slot of a source takes the k-th block of
its stream, starting over at the end; slots are ranked per source and joined with the blocks.

A source's target is its weight's share of all words, at most ``max_repeats`` times its own words; what
is cut off goes to the other sources by weight. Its last slot is cut to the words that are left, and
slots which the sequence still owes at the end are appended, so each source takes exactly its target
(rounded) and no document is taken more than ``max_repeats`` times.

A NULL text has no words. Documents without words take no part and are returned with nothing taken. A
NULL source is a source of its own, the last one. Rows that repeat are documents of their own. An empty
table gives an empty result, and extra columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlake.operators.staging import staged

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a block; the last slot of a source may take fewer.
BLOCK_WORDS = 1024
#: Documents per bucket of a source's shuffled order, and slots per stretch of the schedule, on average.
BUCKET_ROWS = 4096
STRETCH_SLOTS = 1 << 16
#: Cells into which the cumulative weights are cut to look points up.
CELLS = 1 << 12
#: 2^32 divided by the golden ratio, odd; points are its multiples modulo 2^32.
GOLDEN = 2654435769
POINTS = 1 << 32

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source (source, words): its place in the order, weight and target. One row per source, in one task.

    Sources at their limit are those with the smallest words per weight; the level is the share per
    unit of weight that the remaining words give to the remaining sources, as they are taken in that order.
    """
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("place", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("words") * max_repeats)
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("total", F.sum("words").over(everything))
        .withColumn("capped", F.sum("cap").over(by_need) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        # The first source that stays below its limit fixes the level for all from there on.
        .withColumn("settled", F.max("fits").over(by_need))
        .withColumn("final", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_need)))
    return levels.select(
        "source", "words", "documents", "place", "weight",
        F.when(F.col("settled"), F.col("final") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


@dataclass
class Mix:
    """``taken``: one row per document. ``schedule``: what each slot takes, in order."""

    taken: DataFrame
    schedule: DataFrame


def block_edge(block: str) -> Column:
    """First word of a block. Blocks have words div blocks words each, the first words % blocks ones one more.

    No product exceeds the source's words by more than the blocks, so sources of any size fit a long.
    """
    return F.expr(f"({block}) * (words div blocks) + least({block}, words % blocks)")


def block_of(word: str) -> Column:
    """The block that holds a word of the source."""
    return F.expr(f"""CASE WHEN ({word}) < (words % blocks) * (words div blocks + 1)
        THEN ({word}) div (words div blocks + 1)
        ELSE words % blocks + (({word}) - (words % blocks) * (words div blocks + 1)) div (words div blocks) END""")


def _ordered(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """Documents with words, and the place of their first word in the source's stream.

    The order of a source is cut into buckets by the leading part of the hash; sums per bucket are
    added up over the few buckets, documents only within their bucket. So no source meets in one task.
    """
    buckets = F.greatest(F.lit(1), F.ceil(F.col("documents") / BUCKET_ROWS)).cast("long")
    placed = sizes.where("size > 0").join(
        shares.select(F.col("source").alias("s"), "place", "words", "target", "blocks", buckets.alias("buckets")),
        F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("bucket", F.expr("pmod(shiftright(shuffle, 16), buckets)"))
    before = Window.partitionBy("place").orderBy("bucket")
    starts = placed.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_words")).select(
        "place", "bucket", (F.sum("bucket_words").over(before) - F.col("bucket_words")).alias("bucket_start"))
    inside = Window.partitionBy("place", "bucket").orderBy("shuffle", "doc_id", "size", "row")
    return placed.withColumn("inner_start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
                             - F.col("size")).join(starts, ["place", "bucket"]).withColumn(
        "start", F.col("bucket_start") + F.col("inner_start"))


def _slots(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """(slot, place, turn): the source of every slot and the slot's rank among those of its source."""
    spark = shares.sparkSession
    parts = shares.where("needed > 0").select(
        "place", "needed", F.sum("needed").over(Window.orderBy("place")).alias("upper"))
    parts = parts.withColumn("lower", F.col("upper") - F.col("needed"))
    total = shares.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0]
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn(
        "point", F.expr(f"(((slot + 1) % {POINTS // 2}) * {GOLDEN} % {POINTS}) / {float(POINTS)} * {float(total)}"))
    # The cumulative weights, cut into cells: an equality join finds the few sources around a point.
    cell = float(max(total, 1)) / CELLS
    around = parts.withColumn("cell", F.explode(F.expr(
        f"sequence(CAST(floor(lower / {cell}) AS INT), CAST(floor(upper / {cell}) AS INT))")))
    dealt = slots.withColumn("cell", F.floor(F.col("point") / cell).cast("int")).join(around, "cell").where(
        "lower <= point AND point < upper").select("slot", "place").withColumn(
        "stretch", F.expr(f"slot div {STRETCH_SLOTS}"))
    dealt = staged(dealt, "dealt-slots")
    before = Window.partitionBy("place").orderBy("stretch")
    offsets = dealt.groupBy("place", "stretch").agg(F.count("*").alias("n")).select(
        "place", "stretch", (F.sum("n").over(before) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy("place", "stretch").orderBy("slot")
    ranked = dealt.withColumn("inner", F.row_number().over(inside) - 1).join(offsets, ["place", "stretch"]).select(
        "slot", "place", (F.col("earlier") + F.col("inner")).alias("turn"))
    given = dealt.groupBy("place").agg(F.count("*").alias("given"))
    owed = shares.join(given, "place", "left").select(
        "place", "needed", F.coalesce("given", F.lit(0)).alias("given")).where("needed > given").select(
        "place", F.explode(F.expr("sequence(given, needed - 1)")).alias("turn"))
    return ranked.unionByName(owed.select((F.lit(total) + F.col("turn")).alias("slot"), "place", "turn"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
          block_words: int = BLOCK_WORDS, row_key: str | None = None) -> Mix:
    """The mix of ``docs`` (doc_id, text, source; a column ``row_key`` may number its rows).

    ``taken``: doc_id, size, source, source_size, target, taken, and row if there is such a column. ``schedule``: slot, source, doc_id, first and
    words: slot by slot the words of each document that are taken, counted from the document's first word.
    """
    shuffle = F.xxhash64("doc_id", "text")
    row = F.col(row_key) if row_key else F.monotonically_increasing_id()
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               shuffle.alias("shuffle"), row.alias("row")), "document-sizes")
    shares = targets(sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("documents")),
                     weights, max_repeats)
    blocks = F.ceil(F.col("words") / block_words).cast("long")
    shares = shares.withColumn("blocks", blocks).withColumn("goal", F.round("target").cast("long"))
    # Slots: whole passes of all blocks, then the blocks that begin before the goal is reached.
    rest = F.expr("CASE WHEN words > 0 THEN goal % words ELSE 0 END")
    reached = F.when(F.expr("words > 0 AND rest > 0"), block_of("rest - 1") + 1).otherwise(0)
    shares = staged(shares.withColumn("rest", rest).withColumn("reached", reached).withColumn(
        "needed", F.expr("CASE WHEN words > 0 THEN (goal div words) * blocks + reached + 1 ELSE 0 END")), "shares")

    placed = staged(_ordered(sizes, shares).select(
        "doc_id", "source", "size", "place", "words", "target", "blocks", "start", "row"), "placed-documents")
    pieces = placed.withColumn("block", F.explode(F.sequence(block_of("start"), block_of("start + size - 1")))).withColumn(
        "block_start", block_edge("block")).withColumn("block_end", block_edge("block + 1")).withColumn(
        "from", F.greatest("start", "block_start")).withColumn(
        "to", F.least(F.col("start") + F.col("size"), F.col("block_end"))).where("from < to").select(
        "doc_id", "source", "size", "place", "block", "start", "from", "to")
    slots = _slots(sizes, shares).join(shares.select("place", "words", "blocks", "goal"), "place").withColumn(
        "pass", F.expr("turn div blocks")).withColumn("block", F.expr("turn % blocks")).withColumn(
        "limit", F.col("goal") - F.col("pass") * F.col("words")).where(
        F.col("limit") > block_edge("block")).select("slot", "place", "block", "limit")
    joined = pieces.join(slots, ["place", "block"]).withColumn(
        "words", F.least("to", "limit") - F.col("from")).where("words > 0")
    schedule = joined.select("slot", "source", "doc_id", (F.col("from") - F.col("start")).alias("first"), "words")
    summed = joined.groupBy("place", "start").agg(F.sum("words").alias("taken"))
    with_words = placed.select("doc_id", "size", "source", "words", "target", "place", "start", "row").join(
        summed, ["place", "start"], "left")
    columns = ["doc_id", "size", "source", F.col("words").alias("source_size"), "target",
               F.coalesce("taken", F.lit(0)).alias("taken"), "row"]
    without = sizes.where("size = 0").join(
        shares.select(F.col("source").alias("s"), "words", "target"), F.col("source").eqNullSafe(F.col("s")))
    taken = with_words.select(columns).unionByName(
        without.select("doc_id", "size", "source", F.col("words").alias("source_size"), "target",
                       F.lit(0).cast("long").alias("taken"), "row"))
    return Mix(taken if row_key else taken.drop("row"), schedule)


def repeated(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: one row for each time that a document is taken whole, and one
    with its first words where the mix ends within it. Documents of which nothing is taken are not in the mix.

    Every row is numbered first and gets what the mix takes of this row, whatever ids or texts repeat.
    """
    # The row travels as one value, so its columns may have any names.
    numbered = staged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
                      .withColumn("number", F.monotonically_increasing_id()), "numbered-documents")
    taken = mixed(numbered.select("doc.doc_id", "doc.text", "doc.source", "number"), row_key="number", **parameters).taken
    copies = numbered.join(taken.where("taken > 0").select(F.col("row").alias("number"), "size", "taken"), "number").withColumn(
        "part", F.explode(F.expr("sequence(1, CAST(ceil(taken / size) AS INT))")))
    copies = copies.withColumn("left", F.expr("least(size, taken - (part - 1) * size)"))
    words = F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("left") == F.col("size"), F.col("doc.text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("left").cast("int")), ""))
    out = copies.select("doc", text.alias("cut"))
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return out.select([new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
