"""Each pipeline stage on odd rows, and the whole against a second computation of its decisions."""

import hashlib
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_operators import brute_components, brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], SCHEMA)


ODD = [(1, "some words in a text that is fine", "a"), (2, None, None), (3, "", "a"), (3, "", "a"), (None, "no id", "b"), (4, "x " * 5000, "b")]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stage_on_odd_rows(spark, folder, name, stage):
    found = stage(spark, table(spark, ODD), folder)
    if name != pipeline.STAGES[-1][0]:
        assert found.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert found.count() >= 1
    assert stage(spark, table(spark, ODD).limit(0), folder).count() == 0


def test_stages_decide_as_brute_force_does(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in pipeline.near_duplicate_stage(spark, docs, data).collect()}
    assert kept == {i for i, (_, c) in brute_components(made).items() if c == i}
    some = docs.filter("doc_id < 60")
    removed = brute_spans([(i, t.encode()) for i, t in made if i < 60])
    for r in pipeline.repeated_passage_stage(spark, some, data).collect():
        gone = removed[r["doc_id"]]
        assert len(gone) - len(r["text"].encode()) <= gone.sum() and r["n_chars"] == len(r["text"])
        assert (len(gone) - len(r["text"].encode()) > 0) == (gone.sum() > 6) or gone.sum() < 100


def test_run_is_its_stages(spark, data):
    found = pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, data)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found) == key(docs)
    assert found.filter(F.col("decoded_sha256") == hashlib.sha256(b"").hexdigest()).count() < found.count() / 4


def test_near_duplicates_go_by_text_not_by_id(spark, folder):
    words = [" ".join(f"{w}{i}" for i in range(30)) for w in ("a", "b", "c", "d")]
    near = words[1].replace("b29", "other")
    rows = [(1, words[0], "s"), (5, words[1], "s"), (5, words[2], "s"), (5, near, "s"), (5, words[2], "t"), (7, near.upper(), "s"),
            (None, words[3], "s"), (None, words[0], "s"), (8, "", "s"), (8, "", "s"), (9, None, "s")]
    for _ in range(2):
        found = pipeline.near_duplicate_stage(spark, table(spark, rows).repartition(5), folder).collect()
        kept = sorted(((r["doc_id"], r["text"]) for r in found), key=repr)
        one = [t for i, t in kept if i == 5 and t in (words[1], near)]
        assert len(one) == 1  # of two near copies with one id, the smaller hash
        want = [(1, words[0]), (5, one[0]), (5, words[2]), (None, words[3]), (8, ""), (8, ""), (9, None)]
        assert kept == sorted(want, key=repr)
        assert [r["source"] for r in found if r["text"] == words[2]] == ["s"]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_pass_clashing_names_on(spark, folder, name, stage):
    clashing = ["key", "tag", "found", "cls", "id", "component_id", "place", "_tag", "_id_key", "_pass", "_spans", "pass", "order_key", "many", "part", "score", "_leader_id"]
    plain = table(spark, [(1, "some words in a text that is fine", "a"), (2, "other words", "b"), (3, None, None)])
    wide = plain.select("*", *[F.lit(f"{c} kept").alias(c) for c in clashing])
    want, got = stage(spark, plain, folder), stage(spark, wide, folder)
    if name == pipeline.STAGES[-1][0]:
        assert sorted(got.collect()) == sorted(want.collect())
        return
    assert got.columns == wide.columns
    assert sorted(map(tuple, got.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert all(r[c] == f"{c} kept" for r in got.collect() for c in clashing)


def test_mix_keeps_its_order(spark, data, folder):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    uses = pipeline.mixing.mix_sources(docs).collect()
    path = f"{folder}/mixed"
    pipeline.mixing_stage(spark, docs, data).write.parquet(path)
    order = [r["doc_id"] for r in sorted(uses, key=lambda r: (r["pass"], r["order_key"]))]
    assert sorted(order) == sorted(r["doc_id"] for r in spark.read.parquet(path).collect())
    files = [f for f in sorted(os.listdir(path)) if f.endswith(".parquet")]
    assert [i for f in files for i in pq.read_table(f"{path}/{f}")["doc_id"].to_pylist()] == order


def test_quality_stage_judges_each_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    stats = pipeline.quality.document_statistics(docs)
    model = pipeline.quality.learn_quality(stats, labels, ~pipeline.held_out())
    made = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = model.scores(np.array([pipeline.quality.statistics(t) for t in made.values()]))
    want = {i for i, s in zip(made, scores) if s >= pipeline.quality.ACCEPT}
    assert {r["doc_id"] for r in pipeline.quality_stage(spark, docs, data).collect()} == want and 0 < len(want) < len(made)
