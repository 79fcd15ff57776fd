"""The pipeline's stages on the smallest tables, and the guard of the driver's entry."""

import importlib
import sys

import corpus_pipeline
import pytest

from sievemark.llm.frames import table, written
from sievemark.llm.queries import QUERIES, toxicity_model
from tests.llm.helpers import ODD, documents
from tests.llm.test_copies import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [written(table(spark, SF, "documents"), "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), name))
    return docs


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "bpe"]
    assert all(frame.schema == stages[0].schema for frame in stages[1:-1])


def test_toxicity_stage(spark, stages):
    model = toxicity_model(spark, stages[0], SF)
    assert ids(stages[1]) == sorted(r.doc_id for r in stages[0].collect() if model.scores([r.text or ""])[0][0] < 0.3)
    assert 0 < stages[1].count() <= stages[0].count()


def test_copy_stages(stages):
    best = {}
    for r in stages[1].collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert ids(stages[2]) == sorted(best.values())
    components = plain_components([(r.doc_id, r.text) for r in stages[2].collect()])
    assert ids(stages[3]) == sorted(i for i, c in components.items() if i == c)


def test_mix_and_encoding_stages(stages):
    assert set(ids(stages[4])) <= set(ids(stages[3]))
    assert ids(stages[5]) == ids(stages[4])
    assert stages[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_documents_pass_through(spark):
    docs = spark.createDataFrame([], table(spark, SF, "documents").schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns_pass_through(spark):
    docs = documents(spark, [*ODD, (20, "a clean text of its own", None), (21, "another one", "t")], clashes=True)
    schema, before = docs.schema, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.schema.names == schema.names, name
        assert {r.doc_id for r in docs.collect()} <= before
    texts = [r.text for r in docs.collect()]
    assert all((t or "").split() for t in texts)  # the mix takes nothing without words
    # A source whose target is above its size is taken more than once.
    assert texts.count("a clean text of its own") > 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(texts)


def test_entry_registers_and_survives_without_the_operators(monkeypatch):
    import __spark_entry__

    every = __spark_entry__.queries()
    assert set(QUERIES) <= set(every) and "pipeline" in every
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    monkeypatch.setitem(sys.modules, "sievemark.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    for name in [n for n in sys.modules if n.startswith("sievemark.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    without = importlib.reload(__spark_entry__)
    assert "pipeline" not in without.queries() and len(without.queries()) > 100
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
