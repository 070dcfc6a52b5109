"""The pipeline step by step, and the registered queries on the shared data."""

import datetime
import os
import re
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from cartlake.llm import mixing, pii
from cartlake.llm.queries import ORACLES, PSEUDONYM_KEY, QUERIES, vocabulary_path

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def corpus():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words, int(rng.integers(30, 120))))
        toxic = i % 4 == 0
        if toxic:
            text = f"idiot {text} scum idiot"
        elif i % 10 == 1:
            text += f" mail ann{i}@x.org or 4111111111111111"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    copies = [(1000 + k, clean[5][1], "en", "s1", 0) for k in range(20)] + [(1100, clean[7][1].upper(), "en", "s2", 0)]
    odd = [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (2002, "", "en", "s0", 0)]
    return rows + copies + odd, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, size int, row string"
    spark.createDataFrame([(*r, 1, 2, "own") for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        found[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return folder, rows, found


def test_each_stage_does_its_work(stages):
    _, rows, found = stages
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score", "size", "row"]
    assert [f.columns for n, f in found.items() if n != "tokens"] == [columns] * 4
    kept = {r.doc_id for r in found["toxicity"].collect()}
    toxic = {r[0] for r in rows if r[1] and "idiot" in r[1]}
    clean = {r[0] for r in rows} - toxic
    assert len(kept & toxic) <= 0.02 * len(toxic) and len(clean - kept) <= 0.02 * len(clean)

    first = found["near_copies"].collect()
    texts = {}
    for r in found["toxicity"].collect():
        texts.setdefault((r.text or "").lower(), []).append(r.doc_id)
    assert sorted(r.doc_id for r in first) == sorted(min(ids) for ids in texts.values())

    by = pii.Permutation(PSEUDONYM_KEY)
    masked = {r.doc_id: r for r in found["pseudonyms"].collect()}
    assert masked.keys() == {r.doc_id for r in first}
    for r in first:
        want = None if r.text is None else pii.pseudonymised(r.text, by)[0]
        assert masked[r.doc_id].text == want and masked[r.doc_id].n_chars == (None if want is None else len(want))
    assert not any("4111111111111111" in (r.text or "") for r in masked.values())

    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mixed(found["pseudonyms"]).taken.collect()}
    rows_of = {}
    for r in found["source_mix"].collect():
        rows_of.setdefault(r.doc_id, []).append(r.text)
        assert (r.row, r.score) == ("own", 1)
    assert rows_of.keys() == {d for d, (_, n) in taken.items() if n}
    for doc_id, parts in rows_of.items():
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in parts) == taken[doc_id][1]
        assert all(masked[doc_id].text.startswith(p) for p in parts)

    library = Tokenizer.from_file(vocabulary_path())
    for r in found["tokens"].collect():
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_is_the_stages_in_order(spark, stages):
    folder, _, found = stages
    got = contract.queries()["pipeline"](spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, found["tokens"].collect()))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in contract.oracle_sql()


def test_an_empty_corpus(spark, stages, tmp_path):
    folder, *_ = stages
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


COLUMNS = {
    "op1_graph_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_feistel_pseudonyms": {"doc_id": "bigint", "text": "string"},
    "op3_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_bilinear_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                            "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_line_frequency": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint",
                           "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_bounded_ring": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                         "slot": "bigint", "grown_shard": "int"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_bpe_tokens": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_simhash_near_duplicates": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_licence_digests": {"doc_id": "bigint", "digest": "string", "licence": "string"},
    "op11_treap_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_bloom_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op13_simplex_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint",
                              "inertia": "bigint", "centroid_sha256": "string"},
}


def test_all_queries_are_registered():
    assert set(COLUMNS) == set(QUERIES) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_cover_their_table(spark, name):
    found = contract.queries()[name](spark, FOLDER)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if name not in ("op1_graph_neighbours", "op11_treap_search", "op13_simplex_clusters"):
        assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def _cell(value):
    return value.isoformat() if isinstance(value, datetime.datetime) else repr(value)


@pytest.mark.parametrize("name", ORACLES)
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = contract.queries()[name](spark, FOLDER), db.execute(ORACLES[name])
    names = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(n) for n in names]
    assert sorted(got.columns) == names
    assert sorted(tuple(_cell(r[n]) for n in names) for r in got.collect()) == sorted(
        tuple(_cell(r[i]) for i in at) for r in want.fetchall())


def test_the_native_scan_has_no_python(spark):
    from cartlake.llm import licences

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = licences.licence_scan(docs, licences.known_licences(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_rest_does_not_import_this_subpackage():
    code = ("import sys; sys.modules['cartlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), len(e.oracle_sql()))")
    root = os.path.dirname(os.path.abspath(contract.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(contract.QUERIES)), str(len(contract.ORACLES))]


WITHOUT_PACKAGE = """
import os, sys
root, work, folder, name = sys.argv[1:]
sys.path.insert(0, root)
import __spark_entry__ as e
sys.path.remove(root)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", work).config(
    "spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def importable(_):
    try:
        import cartlake
        return "yes"
    except ImportError:
        return "no"

assert spark.sparkContext.parallelize([0], 1).map(importable).collect() == ["no"], "the workers find the package"
print("ROWS", e.queries()[name](spark, folder).count())
"""


@pytest.mark.parametrize("name", [*COLUMNS, "pipeline"])
def test_workers_need_no_copy_of_the_package(tmp_path, name):
    root = os.path.dirname(os.path.abspath(contract.__file__))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", WITHOUT_PACKAGE, root, str(tmp_path / "shared"), FOLDER, name], cwd=tmp_path,
                          env=environment, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert int(done.stdout.split("ROWS")[1]) > 0
