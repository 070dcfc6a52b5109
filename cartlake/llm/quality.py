"""Quality rules: figures of each text, and lines that many documents of a host share.

Lines are normalised (words lower-cased, single spaces) and hashed. A line is frequent on a host when
more than ``most_documents`` documents of the host hold it, however large the host is; every row is a
document, copies too. Frequent lines are taken out; a document that loses more than ``most_lost`` of its
words is depleted and rejected.

Everything after the figures works on distinct (host, text) pairs with their number of documents: a group
of copies is one row there, and a line that many documents share is counted before it travels. A NULL text has no words and fails
the base rules; a NULL host is a host of its own; repeated rows are judged each; an empty table gives
an empty result; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.llm.words import LOWER, Words, flat_bytes, mixed, span_hashes, split_words, sums_by_text, text_chunks
from cartlake.operators.staging import staged

WINDOW = 8
MOST_DOCUMENTS = 10
MOST_LOST = 0.5
MIN_WORDS = 20
MOST_REPEATED_PERCENT = 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STEP = np.uint64(0xD6E8FEB86659FD93)


def _sequence_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash per range of neighbouring word hashes; every range has a word."""
    lengths = np.diff(bounds)
    powers = np.full(int(lengths.max()), STEP, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    within = np.arange(len(values)) - np.repeat(bounds[:-1], lengths)
    return mixed(np.add.reduceat(values * powers[within], bounds[:-1]) + lengths.astype(np.uint64))


def _seen_before(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its text has an equal earlier one, and whether it has any equal other."""
    key = mixed(hashes ^ mixed(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, any_other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    return earlier, any_other


def repeated_words(word_hashes: np.ndarray, words: Words) -> np.ndarray:
    """Per text: words inside windows of eight words that occur twice or more in the text."""
    n = len(word_hashes)
    if n < WINDOW:
        return np.zeros(len(words.counts), np.int64)
    owner = words.text_of_word()
    inside = np.flatnonzero(owner[:n - WINDOW + 1] == owner[WINDOW - 1:])
    rolling = np.zeros(len(inside), np.uint64)
    for j in range(WINDOW):
        rolling = rolling * STEP + word_hashes[inside + j]
    _, twice = _seen_before(rolling, owner[inside])
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, inside[twice], 1)
    np.add.at(edges, inside[twice] + WINDOW, -1)
    return sums_by_text((np.cumsum(edges)[:n] > 0).astype(np.int64), words.bounds)


def text_figures(texts: pa.Array) -> dict[str, pa.Array]:
    """Per text: the base figures, and the normalised lines as hashes with their number of words."""
    raw, offsets = flat_bytes(texts)
    words = split_words(texts, lower=False)
    bounds = words.bounds
    in_word = np.zeros(len(raw) + 1, np.int64)
    np.add.at(in_word, words.starts, 1)
    np.add.at(in_word, words.ends, -1)
    first_byte = (raw & 0xC0) != 0x80
    word_chars = sums_by_text((first_byte & (np.cumsum(in_word)[:-1] > 0)).astype(np.int64), offsets)
    symbols = sums_by_text(SYMBOLS[raw].astype(np.int64), offsets)

    owner = words.text_of_word()
    breaks = np.flatnonzero(raw == ord("\n"))
    line_of_word = np.searchsorted(breaks, words.starts)
    n = len(words.starts)
    new_line = np.ones(n, bool)
    new_line[1:] = (owner[1:] != owner[:-1]) | (line_of_word[1:] != line_of_word[:-1])
    first_words = np.flatnonzero(new_line)
    line_bounds = np.append(first_words, n)
    line_owner = owner[first_words]
    lines_of_text = np.bincount(line_owner, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    line_lists = np.concatenate(([0], np.cumsum(lines_of_text))).astype(np.int32)
    if n:
        line_no = line_of_word[first_words]
        begin = np.where(line_no > 0, np.append(breaks, 0)[line_no - 1] + 1, 0)
        begin = np.maximum(begin, offsets[line_owner])
        end = np.minimum(np.append(breaks, len(raw))[line_no], offsets[line_owner + 1])
        earlier, _ = _seen_before(span_hashes(raw, begin, end), line_owner)
        duplicates = sums_by_text(earlier.astype(np.int64), line_lists.astype(np.int64))
        repeats = repeated_words(span_hashes(raw, words.starts, words.ends), words)
        line_hashes = _sequence_hashes(span_hashes(LOWER[raw], words.starts, words.ends), line_bounds).view(np.int64)
        line_words = np.diff(line_bounds).astype(np.int32)
    else:
        duplicates = repeats = np.zeros(len(texts), np.int64)
        line_hashes, line_words = np.zeros(0, np.int64), np.zeros(0, np.int32)
    lines = pa.ListArray.from_arrays(pa.array(line_lists), pa.StructArray.from_arrays(
        [pa.array(line_hashes), pa.array(line_words)], ["line", "words"]))
    figures = {"n_words": np.diff(bounds), "word_chars": word_chars, "n_symbols": symbols,
               "n_dup_lines": duplicates, "n_repeat_words": repeats}
    return {name: pa.array(values.astype(np.int64)) for name, values in figures.items()} | {"lines": lines}


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key and the figures and lines of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                found = text_figures(part["text"])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["host"], part["text_key"], *found.values()],
                    ["doc_id", "host", "text_key", *found])

    schema = ("doc_id long, host string, text_key long, " + ", ".join(f"{n} long" for n in FIGURES)
              + ", lines array<struct<line: bigint, words: int>>")
    return docs.select("doc_id", "host", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def judged(docs: DataFrame, host: str = "source", most_documents: int = MOST_DOCUMENTS,
           most_lost: float = MOST_LOST) -> DataFrame:
    """doc_id, the figures, n_lost_words (in frequent lines), base_failed and kept of every document."""
    # A NULL host gets a key that no other host can have.
    key = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("-"))
    rows = staged(figures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("host"), "text")),
                  "text-figures")
    texts = rows.where("n_words > 0").groupBy("host", "text_key").agg(
        F.first("lines").alias("lines"), F.count("*").alias("documents"))
    lines = staged(texts.select("host", "text_key", "documents", F.explode("lines").alias("l")).groupBy(
        "host", "text_key", F.col("l.line").alias("line")).agg(
        F.sum("l.words").alias("words"), F.first("documents").alias("documents")), "text-lines")
    frequent = lines.groupBy("host", "line").agg(F.sum("documents").alias("held_by")).where(
        F.col("held_by") > most_documents).select("host", "line")
    lost = lines.join(frequent, ["host", "line"]).groupBy("host", "text_key").agg(F.sum("words").alias("n_lost_words"))
    out = rows.drop("lines").join(lost, ["host", "text_key"], "left").withColumn(
        "n_lost_words", F.coalesce("n_lost_words", F.lit(0))).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    return out.select("doc_id", *FIGURES, "n_lost_words", "base_failed", (
        ~F.col("base_failed") & (F.col("n_lost_words") <= F.col("n_words") * most_lost)).alias("kept"))


#: The same in SQL. Windows are joined from words, so this is for small tables.
ORACLE = rf"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '-') AS host, coalesce(text, '') AS body
               FROM documents),
cut AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, string_split(body, chr(10)) AS pieces
        FROM texts),
word_runs AS (SELECT row_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS run
            FROM (SELECT row_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM cut WHERE len(words) >= {WINDOW})),
twice AS (SELECT row_id, run FROM word_runs GROUP BY row_id, run HAVING count(*) > 1),
repeats AS (SELECT row_id, count(DISTINCT i + k) AS n FROM word_runs JOIN twice USING (row_id, run),
            range({WINDOW}) AS offs(k) GROUP BY row_id),
held AS (SELECT row_id, host, body, piece,
           translate(array_to_string(regexp_extract_all(piece, '[^\x20\x09-\x0D]+'), ' '),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line
         FROM (SELECT row_id, host, body, unnest(pieces) AS piece FROM cut)
         WHERE regexp_matches(piece, '[^\x20\x09-\x0D]')),
doubles AS (SELECT row_id, count(*) - count(DISTINCT piece) AS n FROM held GROUP BY row_id),
frequent AS (SELECT host, line FROM held GROUP BY host, line HAVING count(DISTINCT row_id) > {MOST_DOCUMENTS}),
lost AS (SELECT row_id, sum(len(string_split(line, ' '))) AS n FROM held JOIN frequent USING (host, line) GROUP BY row_id),
figures AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(doubles.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
         CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words
  FROM cut LEFT JOIN doubles USING (row_id) LEFT JOIN repeats USING (row_id) LEFT JOIN lost USING (row_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words)
       AND n_lost_words <= {MOST_LOST} * n_words AS kept
FROM figures"""
