"""Toxicity scores by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling.

A word's vector is the sum of the embeddings of the whole word and of its first bytes, so that unseen
compounds share what their beginnings have taught. Filters of each width slide over the word vectors of
the whole text, the largest response of each filter counts, and a logistic layer weighs these.

All labelled rows that may be learned from count: a fifth of them, by a hash of their id, gives the
calibration and the thresholds, all others train the network. Their texts are dealt out to shards of some
SHARD_BYTES; in each of ROUNDS a task goes through all rows of a shard, starting from the common model, and
the models are averaged in a tree. How many partitions Spark makes changes neither the shards nor the
model. Scoring runs in tasks over all documents.

NULL and empty texts get a score like any other (their features are those of no word). Rows without a
doc_id are scored and never learned from. Where no or only one class is labelled, the score is the share
of toxic rows among the labelled ones (0 without any). Repeated rows are scored as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.llm.shipping import shipped
from cartlake.llm.words import Words, span_hashes, split_words, text_chunks
from cartlake.operators.staging import staged

BUCKETS = 1 << 17
PREFIXES = (4, 6)
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Fewest steps on each shard over all rounds; where its rows make fewer batches, it goes through them again.
STEPS = 800
#: Bytes of text in a shard, and rounds after which models are averaged; one shard needs one round.
SHARD_BYTES = 32 << 20
ROUNDS = 3
#: Words of a training batch, which bounds its memory; a longer text is a batch of its own.
BATCH_WORDS = 1 << 14
#: Most texts of a batch, as a step takes time for every text however short.
BATCH_TEXTS = 128
RATE = 0.05
#: Rows of parameters that travel together when models are averaged, and models that one task averages.
PIECE_ROWS = 4096
FAN_IN = 8
#: Logits of the calibration rows are counted in steps of 1 / LOGIT_STEPS, up to LOGIT_REACH on either side.
LOGIT_STEPS = 256
LOGIT_REACH = 60
#: All calibration rows together count as much as so many toxic rows when a language's threshold is chosen.
COMMON_TOXIC = 25
BLOCK_WORDS = 1 << 16

#: All ASCII characters but letters and digits end a word.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_features(words: Words) -> np.ndarray:
    """[word, 1 + prefixes]: buckets of the whole word and of its beginnings; bucket 0 means no word."""
    spans = [(words.ends, 0)] + [(np.minimum(words.ends, words.starts + p), p) for p in PREFIXES]
    hashed = [span_hashes(words.data, words.starts, ends, salt) for ends, salt in spans]
    return np.stack([(h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for h in hashed], axis=1)


def padded(features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of several texts with room for the widest filter behind each; starts and ends of the texts.

    A text without words has one position, a bucket of no word.
    """
    gap = max(WIDTHS)
    counts = np.diff(bounds)
    starts = bounds[:-1] + gap * np.arange(len(counts))
    out = np.zeros((int(bounds[-1]) + gap * len(counts), features.shape[1]), np.int32)
    out[np.arange(int(bounds[-1])) + gap * np.repeat(np.arange(len(counts)), counts)] = features
    return out, starts, starts + np.maximum(counts, 1)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: [width * DIMENSIONS, FILTERS]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: float = 0.0
    scale: float = 1.0         # calibration of the logit
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        embedding[0] = 0
        return cls(embedding,
                   [rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w * DIMENSIONS, FILTERS)).astype(np.float32)
                    for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32))

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.biases, self.weights]

    def rows(self) -> np.ndarray:
        """All that is trained as rows of DIMENSIONS numbers: the embeddings, then everything else one after another."""
        flat = np.concatenate([*(x.ravel() for x in self.dense()), [self.offset]]).astype(np.float32)
        return np.concatenate((self.embedding, np.resize(flat, (-(-len(flat) // DIMENSIONS), DIMENSIONS))))

    def set_rows(self, rows: np.ndarray) -> None:
        self.embedding, flat, at = rows[:BUCKETS].copy(), rows[BUCKETS:].ravel(), 0
        for x in self.dense():
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        self.offset = float(flat[at])

    def vectors(self, features: np.ndarray) -> np.ndarray:
        out = self.embedding[features[:, 0]]
        for k in range(1, features.shape[1]):
            out += self.embedding[features[:, k]]
        return out

    def _windows(self, vectors: np.ndarray, width: int, n: int) -> np.ndarray:
        return np.concatenate([vectors[j:n + j] for j in range(width)], axis=1)

    def pooled(self, features: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[text, filter]: the largest response of each filter, taken in blocks so that long texts fit."""
        best = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        reach = max(WIDTHS) - 1
        for at in range(0, len(features), BLOCK_WORDS):
            stop = min(at + BLOCK_WORDS, len(features))
            texts = np.flatnonzero((starts < stop) & (ends > at))
            if not len(texts):
                continue
            n = stop - at
            vectors = self.vectors(features[at:min(stop + reach, len(features))])
            vectors = np.concatenate((vectors, np.zeros((n + reach - len(vectors), DIMENSIONS), np.float32)))
            edges = np.stack([np.maximum(starts[texts], at) - at, np.minimum(ends[texts], stop) - at], 1).ravel()
            for w, width in enumerate(WIDTHS):
                response = np.vstack([self._windows(vectors, width, n) @ self.filters[w],
                                      np.full((1, FILTERS), -np.inf, np.float32)])
                own = slice(w * FILTERS, (w + 1) * FILTERS)
                best[texts, own] = np.maximum(best[texts, own], np.maximum.reduceat(response, edges)[::2])
        return np.maximum(best + np.concatenate(self.biases), 0)

    def places(self, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per width, [text, filter]: where each filter responds most and how much, in blocks so that long texts fit."""
        found = [(np.zeros((len(starts), FILTERS), np.int64), np.full((len(starts), FILTERS), -np.inf, np.float32))
                 for _ in WIDTHS]
        last, reach = int(ends[-1]), max(WIDTHS) - 1
        for at in range(0, last, BLOCK_WORDS):
            n = min(BLOCK_WORDS, last - at)
            vectors = self.vectors(table[at:at + n + reach])
            texts = np.flatnonzero((starts < at + n) & (ends > at))
            edges = list(zip(np.maximum(starts[texts] - at, 0), np.minimum(ends[texts] - at, n)))
            if not edges:
                continue
            for (where, best), width, filters in zip(found, WIDTHS, self.filters):
                response = self._windows(vectors, width, n) @ filters
                place = np.stack([response[a:b].argmax(axis=0) + a for a, b in edges])
                most = np.take_along_axis(response, place, axis=0)
                more = most > best[texts]
                where[texts] = np.where(more, place + at, where[texts])
                best[texts] = np.maximum(most, best[texts])
        return found

    def logits(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.pooled(*padded(features, bounds)) @ self.weights + self.offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        words = split_words(texts, separators=BREAKS)
        return self.probability(self.logits(word_features(words), words.bounds))

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(np.float64) + self.shift, -30, 30)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("", 0.5))


class _Steps:
    """Adagrad with a step size per parameter; rows that a step does not touch cost nothing."""

    def __init__(self, like: np.ndarray):
        self.squares = np.full(like.shape, 1e-4, np.float32)
        self.moved = np.zeros(len(like), np.float32)  # steps that touched each row

    def move(self, parameter: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        self.squares[rows] += gradient * gradient
        self.moved[rows] += 1
        parameter[rows] -= RATE * gradient / np.sqrt(self.squares[rows])


def _train_batch(model: Model, steps: dict, features, bounds, truth, weight) -> None:
    table, starts, ends = padded(features, bounds)
    found = model.places(table, starts, ends)
    raw = np.concatenate([best + bias for (_, best), bias in zip(found, model.biases)], axis=1)
    hidden = np.maximum(raw, 0)
    logit = hidden @ model.weights + model.offset
    gap = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - truth) * weight).astype(np.float32) / len(truth)
    back = gap[:, None] * model.weights[None, :] * (raw > 0)
    steps["weights"].move(model.weights, hidden.T @ gap)
    model.offset -= RATE * float(gap.sum())
    rows, moves = [], []
    for w, width in enumerate(WIDTHS):
        own = back[:, w * FILTERS:(w + 1) * FILTERS]
        where = found[w][0]
        seen = np.concatenate([model.vectors(table[where.ravel() + j]) for j in range(width)], axis=1).reshape(
            *where.shape, width * DIMENSIONS)
        step = np.einsum("tf,tfx->xf", own, seen)
        pushed = own[:, :, None] * model.filters[w].T[None, :, :]
        for j in range(width):
            part = pushed[:, :, j * DIMENSIONS:(j + 1) * DIMENSIONS].reshape(-1, DIMENSIONS)
            for k in range(table.shape[1]):
                rows.append(table[where.ravel() + j, k])
                moves.append(part)
        steps[f"filters{w}"].move(model.filters[w], step)
        steps[f"biases{w}"].move(model.biases[w], own.sum(axis=0))
    rows, moves = np.concatenate(rows), np.concatenate(moves)
    order = np.argsort(rows, kind="stable")
    unique, first = np.unique(rows[order], return_index=True)
    summed = np.add.reduceat(moves[order], first)
    live = unique > 0
    steps["embedding"].move(model.embedding, summed[live], unique[live])


def _calibrated(logits: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit by weighted logistic regression with a small penalty.

    Newton steps, halved until they improve: few or well separated rows would throw whole steps far out.
    """
    x = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)
    anchor, penalty = np.array([1.0, 0.0]), 0.5
    sign = np.where(truth == 1, -1.0, 1.0)

    def cost(theta: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, sign * (x @ theta)) + penalty / 2 * ((theta - anchor) ** 2).sum())

    theta = anchor
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - truth)) + penalty * (theta - anchor)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(2)
        step, now = np.linalg.solve(curve, slope), cost(theta)
        for _ in range(20):
            if cost(theta - step) <= now:
                theta = theta - step
                break
            step = step / 2
    return float(max(theta[0], 0.05)), float(theta[1])


def _best_threshold(score: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between scores that gives the best F1 on weighted rows."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum((weight * truth)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + hit[-1])
    f1[:-1][np.diff(score[order]) == 0] = -1
    k = int(np.argmax(f1))
    below = score[order][k + 1] if k + 1 < len(order) else 0.0
    return float(np.clip((score[order][k] + below) / 2, 0.05, 0.95))


def language_thresholds(score: np.ndarray, truth: np.ndarray, weight: np.ndarray, langs: list[str],
                        rows: np.ndarray | None = None) -> dict[str, float]:
    """A threshold per language and, under "", one for all others.

    Each is the best for the rows of its language together with all rows, which count as COMMON_TOXIC toxic
    ones. So few rows of a language move the common threshold a little, and many have their own way.
    ``rows`` tells how many rows an entry stands for, where it is more than one; ``weight`` is theirs together.
    """
    common, of = COMMON_TOXIC / (truth if rows is None else truth * rows).sum(), np.array(langs)
    pairs, inverse = np.unique(np.stack([score, truth], 1), axis=0, return_inverse=True)
    everyone = common * np.bincount(inverse.ravel(), weights=weight)
    found = {"": _best_threshold(*pairs.T, everyone)}
    order = np.argsort(of, kind="stable")
    for own in np.split(order, np.flatnonzero(of[order][1:] != of[order][:-1]) + 1):
        if lang := str(of[own[0]]):
            found[lang] = _best_threshold(np.concatenate((pairs[:, 0], score[own])),
                                          np.concatenate((pairs[:, 1], truth[own])),
                                          np.concatenate((everyone, weight[own])))
    return found


def _batches(rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The rows in order, cut where BATCH_WORDS or BATCH_TEXTS are full."""
    ends = np.cumsum(np.maximum(lengths[rows] + 1, BATCH_WORDS // BATCH_TEXTS))
    return np.split(rows, np.flatnonzero(np.diff((ends - 1) // BATCH_WORDS)) + 1)


def fitted(model: Model, parts: list[np.ndarray], truth: np.ndarray, share: float, steps_least: int, seed: int) -> np.ndarray:
    """Trains ``model`` on the word features of texts, all of them equally often; how many steps met each of its rows.

    ``share`` of the rows of all tasks are toxic; either class weighs half.
    """
    steps = {"embedding": _Steps(model.embedding), "weights": _Steps(model.weights)}
    for w in range(len(WIDTHS)):
        steps |= {f"filters{w}": _Steps(model.filters[w]), f"biases{w}": _Steps(model.biases[w])}
    lengths, rng, done = np.array([len(p) for p in parts]), np.random.default_rng(seed), 0
    balance = np.where(truth == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    while done < steps_least:
        for rows in _batches(rng.permutation(len(parts)), lengths):
            some = [parts[r] for r in rows]
            bounds = np.concatenate(([0], np.cumsum(lengths[rows])))
            _train_batch(model, steps, np.concatenate(some), bounds, truth[rows].astype(np.float32), balance[rows])
            done += 1
    return np.concatenate((steps["embedding"].moved, np.full(len(model.rows()) - BUCKETS, done, np.float32)))


def _mean(models: pd.DataFrame) -> pd.DataFrame:
    """One piece of several models: each row's mean, weighted by the steps that met it."""
    models = models.sort_values("part")
    weight, total = np.zeros(PIECE_ROWS), np.zeros((PIECE_ROWS, DIMENSIONS))
    for places, weights, rows in zip(models["places"], models["weights"], models["vectors"]):
        at, by = np.frombuffer(places, np.int32), np.frombuffer(weights, np.float32)
        weight[at] += by
        total[at] += by[:, None] * np.frombuffer(rows, np.float32).reshape(-1, DIMENSIONS)
    at = np.flatnonzero(weight)
    return pd.DataFrame({"part": [int(models["part"].iloc[0]) // FAN_IN], "piece": [int(models["piece"].iloc[0])],
                         "places": [at.astype(np.int32).tobytes()], "weights": [weight[at].astype(np.float32).tobytes()],
                         "vectors": [(total[at] / weight[at, None]).astype(np.float32).tobytes()]})


def _round(learn: DataFrame, model: Model, share: float, steps: int, shards: int, number: int) -> None:
    """Trains ``model`` on each shard of ``learn`` (shard, text, toxic); the model becomes the mean of theirs.

    A shard's rows follow one another in one partition, however many partitions there are and however many shards they hold.
    """
    give = shipped(learn.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, truth = None, [], []
        for batch in batches:
            for some in text_chunks(batch):
                words = split_words(some["text"], separators=BREAKS)
                features = np.split(word_features(words), words.bounds[1:-1])
                for own, part, toxic in zip(some["shard"].to_pylist(), features, some["toxic"].to_pylist()):
                    if own != shard and parts:
                        yield from learned(shard, parts, truth)
                        parts, truth = [], []
                    shard = own
                    parts.append(part)
                    truth.append(toxic)
        if parts:
            yield from learned(shard, parts, truth)

    def learned(shard: int, parts: list[np.ndarray], truth: list[int]) -> Iterator[pa.RecordBatch]:
        own = give()
        met = fitted(own, parts, np.array(truth), share, steps, seed=11 + number * shards + shard)
        rows, at = own.rows(), np.flatnonzero(met)
        for piece in np.split(at, np.flatnonzero(np.diff(at // PIECE_ROWS)) + 1):
            packed = ((piece % PIECE_ROWS).astype(np.int32), met[piece], rows[piece])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([piece[0] // PIECE_ROWS], pa.int32()),
                 *(pa.array([x.tobytes()], pa.binary()) for x in packed)],
                ["part", "piece", "places", "weights", "vectors"])

    schema = "part long, piece int, places binary, weights binary, vectors binary"
    models = learn.mapInArrow(run, schema)
    while shards > 1:
        models = models.groupBy(F.expr(f"part div {FAN_IN}").alias("set"), "piece").applyInPandas(_mean, schema)
        shards = -(-shards // FAN_IN)
    rows = model.rows()
    for p in models.collect():  # one model of some 8 MB, however many rows it has learned from
        at = p["piece"] * PIECE_ROWS + np.frombuffer(p["places"], np.int32)
        rows[at] = np.frombuffer(p["vectors"], np.float32).reshape(-1, DIMENSIONS)
    model.set_rows(rows)


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, text, toxic) as (shard, text, toxic): the id alone decides the shard, whatever the partitions.

    With several ranges asked for per shard, each shard has a partition of its own.
    """
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartitionByRange(
        4 * shards, "shard").sortWithinPartitions("shard", "doc_id").select("shard", "text", "toxic")


def _calibrate(rows: DataFrame, model: Model, share: float) -> None:
    """Scale, shift and thresholds from all ``rows`` (text, lang, toxic), whose logits are counted in small steps."""
    give = shipped(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = give()
        for batch in batches:
            for part in text_chunks(batch):
                words = split_words(part["text"], separators=BREAKS)
                logits = np.clip(own.logits(word_features(words), words.bounds), -LOGIT_REACH, LOGIT_REACH)
                steps = np.rint(logits * LOGIT_STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["lang"], part["toxic"], pa.array(steps)], ["lang", "toxic", "step"])

    counted = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        run, "lang string, toxic int, step int").groupBy("lang", "toxic", "step").agg(F.count("*").alias("n"))
    found = counted.orderBy("lang", "toxic", "step").collect()  # grows with the languages, not with the rows
    langs, truth, steps, n = zip(*found) if found else ((),) * 4
    truth, n = np.array(truth, np.int64), np.array(n, np.float64)
    now = (truth @ n) / max(n.sum(), 1.0)
    if not 0 < now < 1:
        return
    weight = n * np.where(truth == 1, share / now, (1 - share) / (1 - now))
    logits = np.array(steps) / LOGIT_STEPS
    model.scale, model.shift = _calibrated(logits, truth, weight)
    model.thresholds = language_thresholds(model.probability(logits), truth, weight, list(langs), n)


def may_learn(doc_id: Column) -> Column:
    """Rows whose label may be learned from; the others are held out to measure."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) != 0


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows that may be learned from.

    Several labels of one document count as toxic if one of them is 1; labels other than 0 and 1 are ignored.
    A document that occurs several times is learned from once.
    """
    usable = labels.where(may_learn(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    labelled = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = labelled.get(1, 0) / max(sum(labelled.values()), 1)
    rows = staged(docs.select("doc_id", "text", "lang").join(
        usable.withColumnRenamed("doc_id", "labelled_id"), F.col("doc_id") == F.col("labelled_id")).groupBy("doc_id").agg(
        F.min(F.struct("text", "lang", "toxic")).alias("row")).select(
        "doc_id", "row.*", (F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0).alias("calibrates")),
        "labelled-texts")
    sizes = rows.groupBy("calibrates", "toxic").agg(F.count("*").alias("n"), F.sum(
        F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()
    model = Model.fresh()
    if len({r["toxic"] for r in sizes}) < 2:
        model.constant = float(share)
        return model
    taught = [r for r in sizes if not r["calibrates"]]
    if len(taught) == 2:
        learn = rows.where(~F.col("calibrates"))
    else:  # so few rows that the others lack a class
        learn, taught = rows, sizes
    toxic = sum(r["n"] for r in taught if r["toxic"] == 1) / sum(r["n"] for r in taught)
    shards = max(1, -(-sum(r["bytes"] for r in taught) // SHARD_BYTES))
    rounds = ROUNDS if shards > 1 else 1
    learn = dealt(learn, shards)
    if rounds > 1:  # dealt out once for all rounds
        learn = learn.persist(StorageLevel.DISK_ONLY)
    for number in range(rounds):
        _round(learn, model, toxic, -(-STEPS // rounds), shards, number)
    if rounds > 1:
        learn.unpersist()
    if taught is not sizes:
        _calibrate(rows.where("calibrates"), model, share)
    return model


def scored(docs: DataFrame, model: Model, score_name: str = "score", rejected_name: str = "rejected") -> DataFrame:
    """``docs`` with a score (0 to 1, from the text alone) and whether it reaches its language's threshold.

    Columns of the same names are replaced.
    """
    give = shipped(docs.sparkSession, model)
    kept = [f for f in docs.schema if f.name not in (score_name, rejected_name)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = give()
        for batch in batches:
            for part in text_chunks(batch):
                score = own.scores(part["text"])
                limits = np.array([own.threshold(x) for x in part["lang"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(score), pa.array(score >= limits)],
                                                 [*names, score_name, rejected_name])

    return docs.select(*names).mapInArrow(
        run, T.StructType([*kept, T.StructField(score_name, T.DoubleType()),
                           T.StructField(rejected_name, T.BooleanType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least 0.5) and rejected of every document."""
    model = trained(docs, labels)
    return scored(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns whatever their names."""
    taken = {c.lower() for c in docs.columns}
    score, rejected = (next(n for n in (f"{stem}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken)
                       for stem in ("score", "rejected"))
    return scored(docs, trained(docs, labels), score, rejected).where(~F.col(rejected)).select(*docs.columns)
