"""The classifier: gradients, held-out accuracy, long texts in blocks, and odd tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartlake.llm import toxicity
from cartlake.llm.words import split_words

BAD_WORDS = {"en": ["idiot", "scum"], "de": ["blodling", "blodkopf"]}


def corpus(n=900, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = ["en", "de"][i % 3 == 0]
        words = [f"{lang}{w}" for w in rng.integers(0, 5000, rng.integers(5, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.integers(1, 4)):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(BAD_WORDS[lang])) + ",")
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def features_of(texts):
    words = split_words(pa.array(texts), separators=toxicity.BREAKS)
    return toxicity.word_features(words), words.bounds


def test_training_follows_the_gradient():
    features, bounds = features_of(["a b c idiot", "d e", "", "idiot idiot x y z w"])
    truth, weight = np.array([1, 0, 0, 1], np.float32), np.ones(4)
    model = toxicity.Model.fresh(4)  # a start with no bend of the maximum nearby
    model.biases = [np.full(toxicity.FILTERS, 0.05, np.float32) for _ in model.biases]

    def loss():
        logits = model.logits(features, bounds).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(np.where(truth == 1, -logits, logits)))))

    class Recorder:
        def move(self, parameter, gradient, rows=slice(None)):
            found.append((parameter, gradient, rows))

    found = []
    steps = {k: Recorder() for k in ["embedding", "weights", *(f"{p}{w}" for p in ("filters", "biases") for w in range(3))]}
    model.offset = 0.0
    toxicity._train_batch(model, steps, features, bounds, truth, weight)
    model.offset = 0.0
    rng = np.random.default_rng(0)
    for parameter, gradient, rows in found:
        direction = rng.normal(size=gradient.shape).astype(np.float32)
        keep = parameter[rows].copy()
        sides = []
        for sign in (1, -1):
            parameter[rows] = keep + sign * 1e-3 * direction
            sides.append(loss())
        parameter[rows] = keep
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float((gradient * direction).sum()), abs=2e-3)


def test_blocks_do_not_change_scores(monkeypatch):
    texts = ["", "word", "one two three " * 300, "scum", "x " * 1000]
    features, bounds = features_of(texts)
    model = toxicity.Model.fresh()
    whole = model.logits(features, bounds)
    alone = np.concatenate([model.logits(*features_of([t])) for t in texts])
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 64)
    assert np.allclose(whole, model.logits(features, bounds), atol=1e-5) and np.allclose(whole, alone, atol=1e-5)


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, g, "s", 1, "own") for i, t, g, _ in rows],
                                 "doc_id long, text string, lang string, source string, rejected int, score string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, _, x in rows] + [(None, 1, 1), (5000, 0, None), (3, 1, rows[3][3])],
                                   "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(spark, tables):
    rows, docs, labels = tables
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    held = [(found[i].predicted, x) for i, _, _, x in rows if found[i].held_out]
    assert sum(p == x for p, x in held) / len(held) > 0.93
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    gone = set(range(len(rows))) - {r.doc_id for r in kept.collect()}
    truth = {i for i, _, _, x in rows if x}
    assert len(gone & truth) > 0.85 * len(truth) and len(gone - truth) < 0.05 * len(rows)
    assert {r.score for r in kept.select("score").collect()} == {"own"}


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, tables):
    rows, docs, labels = tables
    before = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    flipped = labels.withColumn("toxic", labels.toxic * 0 + 1).where(~toxicity.may_learn(labels.doc_id))
    changed = labels.where(toxicity.may_learn(labels.doc_id)).unionByName(flipped)
    other = docs.withColumn("source", docs.lang)
    assert before == {r.doc_id: r.score for r in toxicity.toxicity(other, changed).collect()}


def test_odd_tables(spark, tables):
    _, docs, labels = tables
    odd = spark.createDataFrame([(1, None, None), (None, "", "en"), (2, "scum " * 30_000, "xx"), (2, "scum " * 30_000, "xx")],
                                "doc_id long, text string, lang string")
    assert toxicity.toxicity(odd, labels).count() == 4
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}


@pytest.mark.parametrize("logits", [[-9.0] * 40 + [9.0] * 3, [-0.2] * 40 + [0.3] * 3, [5.0] * 40 + [60.0] * 2, [0.0] * 10 + [0.0]])
def test_calibration_stays_calm_on_few_or_separated_rows(logits):
    logits = np.array(logits)
    truth = (logits == logits.max()).astype(int) if logits.any() else np.array([0] * 10 + [1])
    scale, shift = toxicity._calibrated(logits, truth, np.ones(len(truth)))
    score = 1 / (1 + np.exp(-(scale * logits + shift)))
    assert abs(score.sum() - truth.sum()) < 3 and score[truth == 0].max() < 0.6


def f1_at(limit, score, truth, weight):
    hit = sum(w for s, t, w in zip(score, truth, weight) if s >= limit and t)
    taken = sum(w for s, w in zip(score, weight) if s >= limit)
    return 2 * hit / (taken + sum(w for t, w in zip(truth, weight) if t))


def test_thresholds_are_the_best_of_all_cuts():
    rng = np.random.default_rng(3)
    langs = [str(x) for x in rng.choice(["de", "en", "", "xx"], 300, p=[0.2, 0.6, 0.15, 0.05])]
    truth = (rng.random(300) < 0.3).astype(int)
    score = np.round(np.clip(0.3 * truth + 0.7 * rng.random(300), 0, 1), 2)
    weight = np.where(truth == 1, 0.5, 1.2)
    found = toxicity.language_thresholds(score, truth, weight, langs)
    assert set(found) == set(langs)
    for lang, limit in found.items():
        shares = [w * ((g == lang and lang != "") + toxicity.COMMON_TOXIC / truth.sum()) for g, w in zip(langs, weight)]
        best = max(f1_at(cut, score, truth, shares) for cut in set(score))
        assert f1_at(limit, score, truth, shares) == pytest.approx(best)


def test_few_rows_of_a_language_move_its_threshold_little_and_many_have_their_way():
    def limits(rows):
        """Toxic rows of xx score 0.25 and clean ones 0.2, while elsewhere clean rows score up to 0.5 and toxic ones from 0.7."""
        score = np.array([0.7, 0.9, 0.5, 0.45, 0.1] * 100 + [0.25, 0.2] * rows)
        truth = np.array([1, 1, 0, 0, 0] * 100 + [1, 0] * rows)
        return toxicity.language_thresholds(score, truth, np.ones(len(score)), ["en"] * 500 + ["xx"] * 2 * rows)

    few, many = limits(1), limits(300)
    assert few["xx"] == few[""] == few["en"] == pytest.approx(0.6)
    assert many["xx"] == pytest.approx(0.225)
    alone = limits(0)
    model = toxicity.Model.fresh()
    assert model.threshold("xx") == model.threshold(None) == 0.5
    model.thresholds = alone
    assert model.threshold("xx") == model.threshold(None) == alone[""] == pytest.approx(0.6)


def test_scores_are_what_a_plain_network_gives():
    """The whole network word by word and position by position, in Python numbers."""
    model = toxicity.Model.fresh(7)
    rng = np.random.default_rng(7)
    model.weights[:] = rng.normal(size=model.weights.shape)
    model.biases = [rng.normal(size=b.shape).astype(np.float32) for b in model.biases]
    model.offset, model.scale, model.shift = 0.3, 0.7, -0.2
    texts = ["one two three four", "", "word", "a b " * 40]
    features, bounds = features_of(texts)
    want = []
    for at in range(len(texts)):
        words = [model.embedding[f].sum(axis=0) for f in features[bounds[at]:bounds[at + 1]]]
        logit, unit = float(model.offset), 0
        places = max(len(words), 1)
        blank = model.embedding[np.zeros(features.shape[1], int)].sum(axis=0)
        padded = words + [blank] * (places - len(words) + max(toxicity.WIDTHS))
        for w, width in enumerate(toxicity.WIDTHS):
            for k in range(toxicity.FILTERS):
                best = max(sum(float(np.dot(padded[p + j], model.filters[w][j * toxicity.DIMENSIONS:(j + 1) * toxicity.DIMENSIONS, k]))
                               for j in range(width)) for p in range(places))
                logit += max(best + float(model.biases[w][k]), 0.0) * float(model.weights.ravel()[unit])
                unit += 1
        want.append(1 / (1 + np.exp(-(model.scale * logit + model.shift))))
    assert np.allclose(model.scores(pa.array(texts)), want, atol=1e-4)


@pytest.mark.parametrize("shard_bytes", [32 << 20, 500_000])
def test_every_labelled_row_is_learned_from(spark, monkeypatch, shard_bytes):
    """Of 3,600 toxic rows to learn from, those with the highest hashes of their ids alone hold one bad word."""
    monkeypatch.setattr(toxicity, "STEPS", 60)
    monkeypatch.setattr(toxicity, "SHARD_BYTES", shard_bytes)
    rng = np.random.default_rng(2)
    ranked = [r.id for r in spark.range(9000).where("id % 2 = 1").where(toxicity.may_learn(F.col("id"))).orderBy(
        F.xxhash64("id"), "id").collect()]
    late = set(ranked[3000:])
    assert len(late) > 400

    def text(i):
        words = [f"w{w}" for w in rng.integers(0, 3000, 30)]
        held_out = zlib.crc32(str(i).encode()) % 5 == 0
        return " ".join([*words, "lout" if held_out or i in late else "scum"] if i % 2 else words)

    docs = spark.createDataFrame([(i, text(i), "en") for i in range(9000)], "doc_id long, text string, lang string")
    found = toxicity.toxicity(docs, docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")).where("held_out").collect()
    assert len(found) > 1500
    assert sum(r.predicted == r.doc_id % 2 for r in found) / len(found) > 0.95


@pytest.mark.parametrize("shard_bytes", [32 << 20, 100_000])
def test_the_number_of_partitions_changes_no_model(spark, monkeypatch, tables, shard_bytes):
    """A cluster may deal keyed rows out to more partitions than were asked for."""
    monkeypatch.setattr(toxicity, "STEPS", 30)
    monkeypatch.setattr(toxicity, "SHARD_BYTES", shard_bytes)
    _, docs, labels = tables
    plain = toxicity.trained(docs, labels)
    for name in ("repartition", "repartitionByRange"):
        deal = getattr(type(docs), name)
        monkeypatch.setattr(type(docs), name, lambda df, n, *by, deal=deal: deal(df, max(n, 40), *by))
    more = toxicity.trained(docs, labels)
    assert np.allclose(plain.rows(), more.rows(), atol=1e-6)
    assert plain.thresholds == pytest.approx(more.thresholds)


def test_a_partition_may_hold_several_shards(spark, monkeypatch, tables):
    rows, docs, _ = tables
    learn = toxicity.dealt(docs.withColumn("toxic", (F.col("doc_id") % 2).cast("int")), 10)
    found = learn.withColumn("task", F.spark_partition_id()).select("shard", "task").distinct().collect()
    assert len(found) == len({r.shard for r in found}) == len({r.task for r in found}) == 10
    models = []
    for dealt in (learn, learn.coalesce(1).sortWithinPartitions("shard"), learn.coalesce(3).sortWithinPartitions("shard")):
        models.append(toxicity.Model.fresh())
        toxicity._round(dealt, models[-1], 0.5, 3, 10, 0)
    assert np.abs(models[0].rows() - toxicity.Model.fresh().rows()).max() > 0.01
    assert all(np.allclose(models[0].rows(), m.rows(), atol=1e-3) for m in models[1:])


def test_training_in_blocks_finds_the_same_places(monkeypatch):
    features, bounds = features_of(["", "one two three " * 300, "scum", "x " * 1000, "a b c"])
    model, padded = toxicity.Model.fresh(), toxicity.padded(features, bounds)
    whole = model.places(*padded)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 64)
    for (where, best), (block_where, block_best), width in zip(whole, model.places(*padded), toxicity.WIDTHS):
        assert np.allclose(best, block_best, atol=1e-6)
        same = [model.vectors(padded[0][np.add.outer(x, np.arange(width))]) for x in (where, block_where)]
        assert np.allclose(*same)  # of equal windows either may be found


def test_thresholds_of_counted_rows_are_those_of_single_rows():
    rng = np.random.default_rng(5)
    langs, n = [str(x) for x in rng.choice(["de", "en", ""], 60)], rng.integers(1, 5, 60)
    truth, score = (rng.random(60) < 0.4).astype(int), np.round(rng.random(60), 2)
    single = toxicity.language_thresholds(*(np.repeat(x, n) for x in (score, truth, np.ones(60))), list(np.repeat(langs, n)))
    assert toxicity.language_thresholds(score, truth, n * 1.0, langs, n) == pytest.approx(single)
