"""A log-bilinear language model trained with noise-contrastive estimation, and its scores of whole texts.

Words are runs of non-blank bytes, lower-cased (A-Z); every text ends with one end token. The model
predicts an output from the two tokens before: every word met ``LEAST_COUNT`` times or more in training has an
output and a context vector of its own (as far as COLLECTED_WORDS go), all other words share one per form (a
hash of their last bytes), and the end token has its own. So the vocabulary grows with the corpus.
The predicted vector is c1 * r[previous] + c2 * r[the one before], its product with an output's vector
plus a bias is the output's score. After training the context vectors are replaced by the nearest of ``CODES``
centroids, so that batched matrix products give the normalising constant of every pair of contexts over all
outputs; a word's probability is its output's times its share of the output's training tokens. A word never met
in training has the Good-Turing mass of such words; that is one event, as in the base score, so both distribute
probability over the same events.

Word counts come from all training texts and are joined by word; training runs over all training texts in
tasks whose models are averaged, in a tree. Only the counts of the most frequent words are collected
(at most COLLECTED_WORDS).

NULL and empty texts consist of the end token. Rows without a doc_id belong to the training rows. Repeated
rows are learned and scored as often as they occur; extra columns are not used. Without training rows every
token is unknown and the score is the base score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.llm.shipping import shipped
from cartlake.llm.words import span_hashes, split_words, text_chunks
from cartlake.operators.staging import staged

FORMS = 256
FORM_BYTES = 3
#: Fewest training tokens of a word with vectors of its own.
LEAST_COUNT = 5
DIMENSIONS = 32
#: Different context vectors at scoring, and rounds of moving them.
CODES = 512
CODE_ROUNDS = 6
NOISE_WORDS = 32
#: Tokens that share noise words; were they many, one draw of a rare word would outweigh all its uses.
SHARING = 32
BATCH_TOKENS = 4096
RATE = 0.1
#: Bits that hold a place among the rows that one step moves.
PLACE_BITS = 24
#: Sum of squared gradients that every parameter starts with.
FIRST_SQUARE = 0.1
#: Most words whose counts and vectors travel to all tasks; all rarer words are joined.
COLLECTED_WORDS = 1 << 16
#: Outputs whose scores in all contexts are held at once, and tokens scored at once.
OUTPUT_BLOCK = 4096
#: Distinct words that a task holds before it passes its counts on.
HELD_WORDS = 1 << 20
#: Rows of vectors that travel together when models are averaged, and models that one task averages.
PIECE_ROWS = 4096
FAN_IN = 8


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(texts: pa.Array):
    """The words of the texts, and the hash and form of each."""
    words = split_words(texts)
    hashes = span_hashes(words.data, words.starts, words.ends)
    tails = span_hashes(words.data, np.maximum(words.starts, words.ends - FORM_BYTES), words.ends, salt=1)
    return words, hashes.view(np.int64), (tails % np.uint64(FORMS)).astype(np.int64)


# --- counts -----------------------------------------------------------------------------------

def word_counts(train: DataFrame) -> DataFrame:
    """(word, form, n) for the words of all texts; ``word`` is a 64-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, form, n = (np.concatenate(x) for x in zip(*held))
            unique, first, inverse = np.unique(word, return_index=True, return_inverse=True)
            return unique, form[first], np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)

        def packed(word, form, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(form.astype(np.int32)), pa.array(n)],
                                              ["word", "form", "n"])

        for batch in batches:
            for part in text_chunks(batch):
                _, hashes, forms = _words(part["text"])
                unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((unique, forms[first], n))
                if sum(len(x[0]) for x in held) > HELD_WORDS:
                    held = [summed()]
                    if len(held[0][0]) > HELD_WORDS // 2:
                        yield packed(*held[0])
                        held = []
        if held:
            yield packed(*summed())

    return train.select("text").mapInArrow(run, "word long, form int, n long").groupBy("word").agg(
        F.min("form").alias("form"), F.sum("n").alias("n"))


@dataclass
class Counts:
    """Totals over all training tokens, and the most frequent words (ascending by hash)."""

    tokens: int            # N, with end tokens
    types: int             # V, with the end token
    ends: int
    singles: int
    form_tokens: np.ndarray  # tokens of each form that have no output of their own
    word: np.ndarray
    n: np.ndarray
    form: np.ndarray
    output: np.ndarray     # the word's own output, or -1

    @property
    def own(self) -> int:
        """Outputs of single words; after them come those of the forms, then the end."""
        return int(self.output.max(initial=-1)) + 1

    @property
    def end(self) -> int:
        return self.own + FORMS

    @property
    def outputs(self) -> int:
        """How many there are; as a context this number is the start of a text."""
        return self.own + FORMS + 1

    @property
    def unknown(self) -> float:
        """Probability of a word never met, by the share of words met once."""
        return min(max(self.singles / max(self.tokens, 1), 1 / (self.tokens + self.types + 1)), 0.5)


def counted(table: DataFrame, ends: int) -> Counts:
    size = F.floor(F.log2(F.col("n")) * 16).cast("int")
    rows = table.groupBy("form", size.alias("size")).agg(
        F.count("*").alias("types"), F.sum("n").alias("n"),
        F.sum((F.col("n") == 1).cast("long")).alias("singles")).toPandas()  # one row per form and size class
    by_size = rows.groupby("size")["types"].sum().sort_index(ascending=False).cumsum()
    taken = by_size[by_size <= COLLECTED_WORDS]
    least = int(taken.index[-1]) if len(taken) else np.iinfo(np.int32).max
    top = table.where(size >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    top["output"] = np.where(top["n"] >= LEAST_COUNT, np.arange(len(top)), -1)
    form_tokens = np.zeros(FORMS, np.int64)
    np.add.at(form_tokens, rows["form"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    own = top[top["output"] >= 0]
    np.subtract.at(form_tokens, own["form"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
    top = top.sort_values("word")
    return Counts(int(rows["n"].sum()) + ends, int(rows["types"].sum()) + (ends > 0), ends, int(rows["singles"].sum()),
                  form_tokens, *(top[c].to_numpy(np.int64) for c in ("word", "n", "form", "output")))


def looked_up(counts: Counts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each word among the most frequent ones, and whether it is one of them."""
    if not len(counts.word):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(counts.word, hashes), len(counts.word) - 1)
    return at, counts.word[at] == hashes


def sequences(counts: Counts, texts: pa.Array):
    """Outputs of all tokens in order with the end tokens, both contexts, and the words that they come from."""
    words, hashes, forms = _words(texts)
    at, known = looked_up(counts, hashes)
    own = np.full(len(hashes), -1, np.int64)
    own[known] = counts.output[at[known]]
    outputs = np.where(own >= 0, own, counts.own + forms)
    bounds = words.bounds
    texts_n, end, start = len(words.counts), counts.end, counts.outputs
    place = np.arange(len(hashes)) + words.text_of_word()
    tokens = np.full(len(hashes) + texts_n, end, np.int64)
    tokens[place] = outputs
    begin = bounds[:-1] + np.arange(texts_n)
    one = np.concatenate(([start], tokens[:-1]))[:len(tokens)]
    one[begin] = start
    two = np.concatenate(([start], one[:-1]))[:len(tokens)]
    two[begin] = start
    return words, hashes, forms, at, known, own, place, tokens, one, two


# --- the model --------------------------------------------------------------------------------

@dataclass
class Model:
    context: np.ndarray  # [outputs + 1, DIMENSIONS]
    output: np.ndarray   # [outputs, DIMENSIONS]
    near: np.ndarray     # weights of the previous token's vector
    far: np.ndarray      # weights of the vector of the one before
    bias: np.ndarray

    @classmethod
    def fresh(cls, noise: np.ndarray) -> Model:
        rng = np.random.default_rng(3)
        tenth = np.float32(0.1)
        return cls(rng.standard_normal((len(noise) + 1, DIMENSIONS), np.float32) * tenth,
                   rng.standard_normal((len(noise), DIMENSIONS), np.float32) * tenth, np.ones(DIMENSIONS, np.float32), np.full(DIMENSIONS, 0.5, np.float32),
                   np.log(noise).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.output, self.near, self.far, self.bias]

    def pieces(self, met: np.ndarray, seen: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(piece, places in it, weights, rows) of all rows that were met.

        The rows are the vectors of contexts, of outputs with their biases, and the two of all tokens.
        """
        wide = DIMENSIONS + 1
        for at in range(0, len(met) + 2, PIECE_ROWS):
            rows = np.zeros((min(PIECE_ROWS, len(met) + 2 - at), wide), np.float32)
            weights = np.full(len(rows), seen, np.float32)
            first = 0
            for vectors, last in ((self.context, None), (self.output, self.bias), (np.stack((self.near, self.far)), None)):
                low, high = max(at, first), min(at + len(rows), first + len(vectors))
                if low < high:
                    rows[low - at:high - at, :DIMENSIONS] = vectors[low - first:high - first]
                    if last is not None:
                        rows[low - at:high - at, DIMENSIONS] = last[low - first:high - first]
                first += len(vectors)
            own = met[at:at + PIECE_ROWS]
            weights[:len(own)] = own
            met_here = np.flatnonzero(weights)
            yield at // PIECE_ROWS, met_here.astype(np.int32), weights[met_here], rows[met_here]

    def set_rows(self, at: np.ndarray, rows: np.ndarray) -> None:
        """The rows ``at``, counted over all pieces, become these."""
        contexts, outputs = len(self.context), len(self.output)
        vectors, common = rows[:, :DIMENSIONS], contexts + outputs
        is_context, is_output = at < contexts, (at >= contexts) & (at < common)
        self.context[at[is_context]] = vectors[is_context]
        self.output[at[is_output] - contexts] = vectors[is_output]
        self.bias[at[is_output] - contexts] = rows[is_output, DIMENSIONS]
        for k, part in enumerate((self.near, self.far)):
            for row in vectors[at == common + k]:
                part[...] = row


def noise_distribution(counts: Counts) -> np.ndarray:
    """Share of each output among the training tokens, with a little for those that have none."""
    totals = np.zeros(counts.outputs)
    own = counts.output >= 0
    totals[counts.output[own]] = counts.n[own]
    totals[counts.own:counts.end] = counts.form_tokens
    totals[counts.end] = counts.ends
    return (totals + 1e-3) / (totals + 1e-3).sum()


class Trainer:
    """Noise-contrastive steps with Adagrad; SHARING tokens in a row share their noise words.

    The loss of a step is a sum over its tokens, so a word met once moves as far as Adagrad's first step allows.
    ``met`` counts a context's or output's uses; models are averaged by them.
    """

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.rng = model, np.random.default_rng(seed)
        self.noise, self.steps = noise, [np.full(p.shape, FIRST_SQUARE, np.float32) for p in model.parts()]
        self.expected = np.log(NOISE_WORDS * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.met = [np.zeros(len(model.context), np.float32), np.zeros(len(model.output), np.float32)]

    def _move(self, k: int, gradient: np.ndarray, rows=slice(None)) -> None:
        self.steps[k][rows] += gradient * gradient
        self.model.parts()[k][rows] -= RATE * gradient / np.sqrt(self.steps[k][rows])

    def _move_rows(self, rows: np.ndarray, gradients: dict[int, np.ndarray]) -> None:
        """Moves some rows of several parts by the sums of their gradients; the rows are sorted once for all parts."""
        keys = np.sort((rows << PLACE_BITS) | np.arange(len(rows)))
        order, ordered = keys & ((1 << PLACE_BITS) - 1), keys >> PLACE_BITS
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        for k, gradient in gradients.items():
            self._move(k, np.add.reduceat(gradient[order], first), ordered[first])

    def drawn(self, groups: int) -> np.ndarray:
        """The noise words of each group of tokens."""
        return np.minimum(np.searchsorted(self.cumulative, self.rng.random((groups, NOISE_WORDS))), len(self.noise) - 1)

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.model, len(target)
        groups = -(-n // SHARING)
        filled = np.arange(groups * SHARING)
        real = (filled < n).astype(np.float32)
        target, one, two = (np.resize(x, len(filled)) for x in (target, one, two))  # the last group is filled up, without weight
        drawn = self.drawn(groups)
        r1, r2 = m.context[one], m.context[two]
        wanted = r1 * m.near + r2 * m.far
        vectors, others = m.output[target], m.output[drawn]
        gap = np.einsum("td,td->t", wanted, vectors) + m.bias[target] - self.expected[target]
        grouped = wanted.reshape(groups, SHARING, DIMENSIONS)
        other = grouped @ others.transpose(0, 2, 1) + (m.bias[drawn] - self.expected[drawn])[:, None, :]
        push = -real / (1 + np.exp(np.clip(gap, -30, 30)))                                  # of the true words
        pull = real.reshape(groups, SHARING, 1) / (1 + np.exp(-np.clip(other, -30, 30)))  # of the noise words
        self.met[0] += np.bincount(one[:n], minlength=len(self.met[0])).astype(np.float32)
        self.met[1] += np.bincount(target[:n], minlength=len(self.met[1])).astype(np.float32)
        back = push[:, None] * vectors + (pull @ others).reshape(-1, DIMENSIONS)
        self._move_rows(np.concatenate((one, two)), {0: np.concatenate((back * m.near, back * m.far))})
        noise_moves = (pull.transpose(0, 2, 1) @ grouped).reshape(-1, DIMENSIONS)
        self._move_rows(np.concatenate((target, drawn.ravel())), {
            1: np.concatenate((push[:, None] * wanted, noise_moves)), 4: np.concatenate((push, pull.sum(axis=1).ravel()))})
        self._move(2, np.einsum("td,td->d", back, r1))
        self._move(3, np.einsum("td,td->d", back, r2))


def trained(train: DataFrame, counts: Counts) -> Model:
    """One pass of every task over its part of all texts from the same start, then the mean of the models.

    A word's vectors are averaged by how often each task met the word; those that no task met stay as they began.
    """
    noise = noise_distribution(counts)
    give = shipped(train.sparkSession, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part_no, seen = give(), TaskContext.get().partitionId(), 0
        trainer = Trainer(Model.fresh(noise), noise, seed=part_no)
        for batch in batches:
            for part in text_chunks(batch):
                *_, tokens, one, two = sequences(own, part["text"])
                for at in range(0, len(tokens), BATCH_TOKENS):
                    span = slice(at, at + BATCH_TOKENS)
                    trainer.step(tokens[span], one[span], two[span])
                seen += len(tokens)
        if seen:
            for piece, places, weights, rows in trainer.model.pieces(np.concatenate(trainer.met), seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part_no], pa.int64()), pa.array([piece], pa.int32()),
                     *(pa.array([x.tobytes()], pa.binary()) for x in (places, weights, rows))],
                    ["part", "piece", "places", "weights", "vectors"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        weight, total = np.zeros(PIECE_ROWS, np.float32), np.zeros((PIECE_ROWS, DIMENSIONS + 1), np.float32)
        for places, weights, vectors in zip(rows["places"], rows["weights"], rows["vectors"]):
            at, by = np.frombuffer(places, np.int32), np.frombuffer(weights, np.float32)
            weight[at] += by
            total[at] += by[:, None] * np.frombuffer(vectors, np.float32).reshape(-1, DIMENSIONS + 1)
        at = np.flatnonzero(weight)
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // FAN_IN], "piece": [int(rows["piece"].iloc[0])],
                             "places": [at.astype(np.int32).tobytes()], "weights": [weight[at].tobytes()],
                             "vectors": [(total[at] / weight[at, None]).tobytes()]})

    schema = "part long, piece int, places binary, weights binary, vectors binary"
    texts = train.select("text")
    models, groups = texts.mapInArrow(run, schema), texts.rdd.getNumPartitions()
    while True:
        models = models.groupBy(F.expr(f"part div {FAN_IN}").alias("set"), "piece").applyInPandas(mean, schema)
        groups = -(-groups // FAN_IN)
        if groups <= 1:
            break
    model = Model.fresh(noise)
    for p in models.select("piece", "places", "vectors").collect():  # at most 2 * (COLLECTED_WORDS + FORMS + 1) + 3 rows
        model.set_rows(p["piece"] * PIECE_ROWS + np.frombuffer(p["places"], np.int32),
                       np.frombuffer(p["vectors"], np.float32).reshape(-1, DIMENSIONS + 1))
    return model


def coded(vectors: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most CODES vectors in place of all, by weighted means from the heaviest ones, and the code of each."""
    order = np.argsort(-weight, kind="stable")
    codes = vectors[order[:CODES]].copy()
    if len(vectors) <= CODES:
        code = np.empty(len(vectors), np.int64)
        code[order] = np.arange(len(vectors))
        return codes, code
    for round_no in range(CODE_ROUNDS + 1):
        half = (codes * codes).sum(axis=1) / 2
        code = np.concatenate([(vectors[at:at + OUTPUT_BLOCK] @ codes.T - half).argmax(axis=1)
                               for at in range(0, len(vectors), OUTPUT_BLOCK)])
        if round_no < CODE_ROUNDS:
            total = np.bincount(code, weights=weight, minlength=CODES)
            for d in range(vectors.shape[1]):
                sums = np.bincount(code, weights=weight * vectors[:, d], minlength=CODES)
                codes[:, d] = np.where(total > 0, sums / np.maximum(total, 1e-30), codes[:, d])
    return codes, code


@dataclass
class Tables:
    """What scores tokens: vectors of context codes (as previous and as the one before) and of outputs, and the norms."""

    code: np.ndarray
    near: np.ndarray
    far: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, model: Model, noise: np.ndarray) -> Tables:
        # The start stands before as many tokens as the end.
        codes, code = coded(model.context, np.append(noise, noise[-1]))
        near, far = codes * model.near, codes * model.far
        spans = [slice(at, at + OUTPUT_BLOCK) for at in range(0, len(noise), OUTPUT_BLOCK)]
        peak_near = np.max([(near @ model.output[s].T + model.bias[s]).max(axis=1) for s in spans], axis=0)
        peak_far = np.max([(far @ model.output[s].T).max(axis=1) for s in spans], axis=0)
        sums = np.zeros((len(codes), len(codes)))
        for s in spans:  # exp(a + b) is exp(a) * exp(b): the sums over outputs are matrix products
            sums += np.exp(near @ model.output[s].T + model.bias[s] - peak_near[:, None]) @ np.exp(
                far @ model.output[s].T - peak_far[:, None]).T
        norm = np.log(np.maximum(sums, 1e-30)) + peak_near[:, None] + peak_far[None, :]
        return cls(code, near, far, model.output, model.bias, norm.astype(np.float32))

    def log_probabilities(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.empty(len(tokens))
        for at in range(0, len(tokens), OUTPUT_BLOCK):
            span = slice(at, at + OUTPUT_BLOCK)
            a, b, t = self.code[one[span]], self.code[two[span]], tokens[span]
            out[span] = np.einsum("td,td->t", self.near[a] + self.far[b], self.output[t]) + self.bias[t] - self.norm[a, b]
        return out


# --- scores -----------------------------------------------------------------------------------

def _local_scores(docs: DataFrame, counts: Counts, tables: Tables) -> DataFrame:
    """Per row: what follows from the frequent words and the end token, and its other words with their sums."""
    give = shipped(docs.sparkSession, (counts, tables))
    floor = np.log10(counts.tokens + counts.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_scores = give()
        log_form = np.log(np.maximum(own.form_tokens, 1))
        log_known = np.log1p(-own.unknown)
        for batch in batches:
            for part in text_chunks(batch):
                words, hashes, forms, at, known, output, place, tokens, one, two = sequences(own, part["text"])
                texts, bounds, owner = len(words.counts), words.bounds, words.text_of_word()
                logs = all_scores.log_probabilities(tokens, one, two) + log_known
                end_logs = logs[bounds[1:] + np.arange(texts)]
                word_logs = logs[place] - np.where(output >= 0, 0, log_form[forms])
                n = np.where(known, own.n[at], 0) if len(own.n) else np.zeros(len(hashes), np.int64)
                base = np.where(known, np.log10(n + 1.0) - floor, 0)
                score = np.where(known, word_logs + np.where(output >= 0, 0, np.log(np.maximum(n, 1))), 0)

                def sums(values: np.ndarray) -> np.ndarray:
                    return np.bincount(owner, weights=values, minlength=texts)

                rare = np.flatnonzero(~known)
                rare = rare[np.lexsort((hashes[rare], owner[rare]))]
                fresh = np.ones(len(rare), bool)
                fresh[1:] = (hashes[rare][1:] != hashes[rare][:-1]) | (owner[rare][1:] != owner[rare][:-1])
                first = np.flatnonzero(fresh)
                lists = np.concatenate(([0], np.cumsum(np.bincount(owner[rare][first], minlength=texts)))).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(hashes[rare][first]), pa.array(np.diff(np.append(first, len(rare)))),
                     pa.array(np.add.reduceat(word_logs[rare], first) if len(first) else np.zeros(0))],
                    ["word", "times", "logs"])
                yield pa.RecordBatch.from_arrays(
                    [part["row"], part["doc_id"], part["held_out"], pa.array(words.counts + 1),
                     pa.array(sums(known).astype(np.int64) + (own.ends > 0)),
                     pa.array(sums(base) + np.log10(own.ends + 1) - floor),
                     pa.array((sums(score) + end_logs) / np.log(10)),
                     pa.ListArray.from_arrays(pa.array(lists), pairs)],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
             "rare array<struct<word: bigint, times: bigint, logs: double>>")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every text."""
    train = docs.where(~is_held_out(F.col("doc_id"))).select("text")
    table = staged(word_counts(train), "word-counts")
    ends = train.count()
    counts = counted(table, ends)
    noise = noise_distribution(counts)
    tables = Tables.of(trained(train, counts) if ends else Model.fresh(noise), noise)
    rows = staged(_local_scores(docs, counts, tables), "local-scores")
    floor, unknown = float(np.log10(counts.tokens + counts.types + 1)), float(np.log10(counts.unknown))
    pairs = rows.select("row", F.explode("rare").alias("w")).select("row", "w.*")
    met = F.col("n").isNotNull()
    sums = pairs.join(table.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.when(met, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - floor)).alias("more_base"),
        F.sum(F.when(met, (F.col("logs") + F.col("times") * F.ln("n")) / float(np.log(10)))
              .otherwise(F.col("times") * unknown)).alias("more_score"))
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("more_base", zero)
    out = rows.drop("rare").join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero) if ends else base).alias("score"))
