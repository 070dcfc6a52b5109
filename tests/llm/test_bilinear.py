"""Language-model scores: counts and base score by hand, normalisation, gradients, and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cartlake.llm import bilinear

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [END]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def corpus(n=300):
    """Two languages whose words follow each other in a fixed way, with some rare words."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        base = "de" if i % 2 else "en"
        words, at = [], int(rng.integers(0, 40))
        for _ in range(int(rng.integers(10, 120))):
            at = (at * 3 + int(rng.integers(0, 3))) % 40
            words.append(f"{base.upper()}{at}" if rng.random() < 0.9 else f"{base}-rare{rng.integers(0, 100000)}ing")
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "EN1 nobody"), (5, rows[5][1]), (903, "en1 " * 30_000)]


@pytest.fixture(scope="module")
def scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, row int, rare string")
    return rows, bilinear.scored(docs).collect()


def test_counts_and_base_score(scores):
    rows, found = scores
    counts = Counter(t for i, text in rows if not held_out(i) for t in tokens_of(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held_out(i), len(tokens_of(t)), sum(counts[x] > 0 for x in tokens_of(t)), n,
                   round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens_of(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want


def test_the_model_beats_the_base_score_on_held_out_texts(scores):
    _, found = scores
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_joined_words_score_as_defined(spark, monkeypatch):
    """With few collected words most are joined; the score must be the product of its factors for every token."""
    rows = corpus()[:60]
    kept = {}

    def untrained(train, counts):
        kept["counts"] = counts
        kept["model"] = bilinear.Model.fresh(bilinear.noise_distribution(counts))
        return kept["model"]

    monkeypatch.setattr(bilinear, "trained", untrained)
    monkeypatch.setattr(bilinear, "COLLECTED_WORDS", 30)
    monkeypatch.setattr(bilinear, "HELD_WORDS", 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in bilinear.scored(docs).collect()}
    counts = kept["counts"]
    tables = bilinear.Tables.of(kept["model"], bilinear.noise_distribution(counts))
    assert 0 < len(counts.word) <= 30
    seen = Counter(t for i, text in rows if not held_out(i) for t in tokens_of(text))
    for i, text in rows:
        words, _, forms, at, known, own, place, tokens, one, two = bilinear.sequences(counts, pa.array([text]))
        logs = tables.log_probabilities(tokens, one, two)
        total = logs[-1] + math.log1p(-counts.unknown)
        for k, word in enumerate(tokens_of(text)[:-1]):
            if not seen[word]:
                total += math.log(counts.unknown)
                continue
            total += logs[k] + math.log1p(-counts.unknown)
            if own[k] < 0:
                total += math.log(seen[word] / counts.form_tokens[forms[k]])
        assert found[i].score == pytest.approx(total / math.log(10), rel=1e-6)
    share = Counter()
    for word, n in seen.items():
        if word is not END:
            _, _, forms, _, _, own, *_ = bilinear.sequences(counts, pa.array([word]))
            if own[0] < 0:
                share[int(forms[0])] += n
    assert share == Counter({f: int(n) for f, n in enumerate(counts.form_tokens) if n})


def some_counts():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(-2**62, 2**62, 40))
    n = rng.integers(1, 50, 40)
    forms = rng.integers(0, bilinear.FORMS, 40)
    output = np.where(np.arange(40) < 25, np.arange(40), -1)
    form_tokens = np.bincount(forms[25:], weights=n[25:], minlength=bilinear.FORMS).astype(np.int64)
    return bilinear.Counts(int(n.sum()) + 9, 41, 9, int((n == 1).sum()), form_tokens, words, n, forms, output)


@pytest.mark.parametrize("codes, block", [(512, 4096), (20, 7)])
def test_probabilities_add_up_to_one(monkeypatch, codes, block):
    monkeypatch.setattr(bilinear, "CODES", codes)
    monkeypatch.setattr(bilinear, "OUTPUT_BLOCK", block)
    counts = some_counts()
    noise = bilinear.noise_distribution(counts)
    model = bilinear.Model.fresh(noise)
    model.output *= 10
    tables = bilinear.Tables.of(model, noise)
    assert len(tables.near) == min(codes, counts.outputs + 1)
    outputs, start = np.arange(counts.outputs), counts.outputs
    for one, two in ((start, start), (3, start), (5, 200)):
        logs = tables.log_probabilities(outputs, np.full(len(outputs), one), np.full(len(outputs), two))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
        scores = (model.context[one] * model.near + model.context[two] * model.far) @ model.output.T + model.bias
        if codes > counts.outputs:  # every context keeps its vector: a softmax written plainly
            assert logs == pytest.approx(scores - np.log(np.exp(scores).sum()), abs=1e-3)


def test_codes_are_the_nearest_centroids(monkeypatch):
    monkeypatch.setattr(bilinear, "CODES", 8)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, bilinear.DIMENSIONS)).astype(np.float32)
    codes, code = bilinear.coded(vectors, rng.random(300))
    far = ((vectors[:, None] - codes[None]) ** 2).sum(axis=2)
    assert codes.shape == (8, bilinear.DIMENSIONS) and (far.argmin(axis=1) == code).mean() > 0.99


def test_the_vocabulary_grows_with_the_corpus(spark):
    """Every word met often enough has an output of its own, however many there are."""
    found = []
    for words in (100, 3000):
        texts = [(" ".join(f"w{j}" for j in range(i, words, 7)),) for i in range(7)] * bilinear.LEAST_COUNT
        train = spark.createDataFrame([*texts, ("once",)], "text string")
        counts = bilinear.counted(bilinear.word_counts(train), train.count())
        found.append(counts.own)
        assert counts.outputs == words + bilinear.FORMS + 1 and counts.form_tokens.sum() == 1
    assert found == [100, 3000]


@pytest.mark.parametrize("size", [1, 7, 100, 4096])
def test_pieces_of_a_model_make_it_again(monkeypatch, size):
    monkeypatch.setattr(bilinear, "PIECE_ROWS", size)
    counts = some_counts()
    model = bilinear.Model.fresh(bilinear.noise_distribution(counts))
    met = np.arange(2 * counts.outputs + 1, dtype=np.float32)
    met[3] = 0
    pieces = list(model.pieces(met, 9))
    assert max(len(rows) for *_, rows in pieces) <= size
    assert np.concatenate([p[2] for p in pieces]).tolist() == [*(x for x in met if x), 9, 9]
    again = bilinear.Model.fresh(bilinear.noise_distribution(counts))
    for part in again.parts():
        part[...] = 7
    for piece, places, _, rows in pieces:
        again.set_rows(piece * size + places, rows)
    assert (again.context[[0, 3]] == 7).all()  # rows that were not met do not travel
    again.context[[0, 3]] = model.context[[0, 3]]
    assert all((a == b).all() for a, b in zip(model.parts(), again.parts()))


def test_models_are_averaged_by_the_uses_of_each_word(spark):
    texts = [("a b a b",)] * 40 + [("c d c d",)] * 40
    train = spark.createDataFrame(spark.sparkContext.parallelize(texts, 6), "text string")
    counts = bilinear.counted(bilinear.word_counts(train), len(texts))
    fresh = bilinear.Model.fresh(bilinear.noise_distribution(counts))
    model = bilinear.trained(train, counts)
    assert (model.context[:4] != fresh.context[:4]).any(axis=1).all()      # all four words were met by some tasks only
    assert (model.context[4:-2] == fresh.context[4:-2]).all()              # no rare word: no form was met
    logs = bilinear.Tables.of(model, bilinear.noise_distribution(counts))
    *_, tokens, one, two = bilinear.sequences(counts, pa.array(["a b a b", "a c a c"]))
    scores = logs.log_probabilities(tokens, one, two)
    assert scores[:5].sum() > scores[5:].sum() + 1


def test_steps_follow_the_contrastive_gradient(monkeypatch):
    counts = some_counts()
    noise = bilinear.noise_distribution(counts)
    trainer = bilinear.Trainer(bilinear.Model.fresh(noise), noise, 0)
    m = trainer.model
    rng = np.random.default_rng(1)
    target, one, two = (rng.integers(0, 30, 20) for _ in range(3))
    monkeypatch.setattr(bilinear, "SHARING", 8)  # three groups, the last not full
    drawn = np.repeat(trainer.drawn(3), 8, axis=0)[:20]
    trainer.drawn = lambda groups: drawn[::8]

    def loss():
        wanted = (m.context[one] * m.near + m.context[two] * m.far).astype(np.float64)
        gap = (wanted * m.output[target]).sum(1) + m.bias[target] - trainer.expected[target]
        other = np.einsum("td,tkd->tk", wanted, m.output[drawn]) + m.bias[drawn] - trainer.expected[drawn]
        return float(np.log1p(np.exp(-gap)).sum() + np.log1p(np.exp(other)).sum())

    found = []
    trainer._move = lambda k, gradient, rows=slice(None): found.append((k, gradient, rows))
    trainer.step(target, one, two)
    for k, gradient, rows in found:
        parameter, direction = m.parts()[k], np.random.default_rng(k).normal(size=gradient.shape).astype(np.float32)
        keep, sides = parameter[rows].copy(), []
        for sign in (1, -1):
            parameter[rows] = keep + sign * 1e-3 * direction
            sides.append(loss())
        parameter[rows] = keep
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float((gradient * direction).sum()), rel=0.02, abs=2e-3)


def test_without_training_rows(spark):
    ids = [i for i in range(200) if held_out(i)][:3]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.score == r.base_score) for r in bilinear.scored(docs).collect()} == {(0, 0, True)}
    assert bilinear.scored(docs.limit(0)).count() == 0


def test_sequences_restart_with_every_text():
    counts = some_counts()
    *_, tokens, one, two = bilinear.sequences(counts, pa.array(["a b", None, "c"]))
    assert (tokens == counts.end).tolist() == [False, False, True, True, False, True]
    assert (one == counts.outputs).tolist() == [True, False, False, True, True, False]
    assert (two == counts.outputs).tolist() == [True, True, False, True, True, True]
