import importlib.util
import os
import sys

import pytest
from conftest_llm import frame, prose
from test_dedup import brute_components
from test_text_ops import toxic_rows

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(llm, tmp_path_factory):
    """A folder of tables with toxic documents, copies, repeated passages, leaked items, nulls and repeated rows."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rows, labels = toxic_rows(200)
    item = prose(900, 30)
    passage = prose(901, 60)
    base = prose(902, 80)
    rows += [(1000, base, "en"), (1001, base, "en"), (1002, base + " tail", "en"), (1003, base, "en"),
             (1004, f"{prose(903, 50)} {passage}", "de"), (1005, f"{passage} {prose(904, 50)}", "de"),
             (1006, f"{prose(905, 40)} {item} {prose(906, 40)}", "fr"), (1007, None, "en"), (1008, "", None), (None, prose(907, 30), "en"),
             (1009, prose(908, 70), "en"), (1009, prose(908, 70), "en")]
    frame(llm, rows).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    llm.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, dict(labels), passage


def test_stages(llm, pipeline, folder):
    path, rows, labels, passage = folder
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "decontamination", "byte_bpe"]
    docs = llm.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    from runwise.llm.common import written
    steps = []
    for name, stage in pipeline.STAGES:
        docs = written(stage(llm, docs, path), name)
        steps.append((docs.columns, docs.collect()))
    assert all(c == columns for c, _ in steps[:4])
    ids = [sorted((r["doc_id"] for r in got), key=repr) for _, got in steps]
    clean = [i for i, _, _ in rows if not labels.get(i)]
    assert ids[0] == sorted(clean, key=repr)
    # One document of each group, by brute force over what stage 1 kept; repeated rows leave once.
    left = [(r["doc_id"], r["text"], None) for r in steps[0][1]]
    comp = {i: c for i, _, c in brute_components(left)}
    assert ids[1] == sorted({i for i in comp if i is None or comp[i] == i}, key=repr)
    text = {r["doc_id"]: r for r in steps[2][1]}
    assert passage in text[1004]["text"] and passage not in text[1005]["text"] and text[1005]["n_chars"] == len(text[1005]["text"])
    assert ids[2] == ids[1] and ids[3] == [i for i in ids[2] if i != 1006]
    final = {r["doc_id"]: r for r in steps[4][1]}
    assert sorted(final, key=repr) == ids[3] and final[1007]["n_tokens"] == final[1008]["n_tokens"] == 0
    import hashlib
    for i, r in final.items():
        assert len(r["ids"]) == 4 * r["n_tokens"] and r["decoded_sha256"] == hashlib.sha256((text[i]["text"] or "").encode()).hexdigest()


def test_run_and_empty_tables(llm, pipeline, folder, tmp_path):
    path, *_ = folder
    assert pipeline.run(llm, path).count() > 100
    for t in ("documents", "labels", "benchmark"):
        llm.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert pipeline.run(llm, f"file://{tmp_path}").collect() == []
