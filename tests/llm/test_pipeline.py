"""The pipeline: planted cases through every stage."""

import corpus_pipeline
import pytest
from cellwise.llm.queries import QUERIES

from .conftest import SCHEMA, words
from .test_text_operators import brute_fingerprint


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    passage = words(70, 11)
    rows = [(i, words(120, 2000 + i)) for i in range(60)]
    rows += [(100, words(120, 2000)), (101, words(120, 2001).replace(words(120, 2001).split()[60], "other"))]  # copies of 0 and 1
    rows += [(105, words(800, 71)), (106, words(800, 71).replace(words(800, 71).split()[400], "other", 1))]
    rows += [(110, words(60, 31) + " " + passage), (111, words(60, 32) + " " + passage + " " + words(30, 33))]
    rows += [(120 + i, words(60, 40 + i) + " idiot " + words(30, 60 + i)) for i in range(20)]
    rows += [(150, "too short"), (151, "BUY NOW!! " * 80), (152, None)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, int(120 <= i < 140)) for i, _ in rows]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, passage


def test_stages(spark, planted, tmp_path):
    folder, passage = planted
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    clean = set(range(60))
    assert clean <= ids[0] and not ids[0] & set(range(120, 140))
    assert clean <= ids[1] and not ids[1] & {150, 151, 152}
    # the stage goes by its contract, four of 64 bits: 106 is within these of 105, 101 is not within these of 1
    bits = {i: brute_fingerprint(t, 4) for i, t in seen[1].select("doc_id", "text").collect()}
    assert (bits[105] ^ bits[106]).bit_count() <= 4 < (bits[1] ^ bits[101]).bit_count()
    linked = {i: {j for j in bits if (bits[i] ^ bits[j]).bit_count() <= 4} for i in bits}
    assert all(linked[j] == linked[i] for i in bits for j in linked[i])
    assert ids[2] == {min(group) for group in linked.values()} and not ids[2] & {100, 106} and clean <= ids[2]
    assert ids[3] == ids[2]
    for r in seen[3].where("doc_id in (110, 111)").collect():
        assert passage not in r.text and r.n_chars == len(r.text)
    assert ids[4] == ids[3]


def test_run_equals_the_stages(spark, planted):
    folder, _ = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(range(60)) | {101, 105, 110, 111}
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
