"""Stages against what they state, on the smallest tables, and the registration of the queries."""

import pytest
from pyspark.sql import functions as F
from corpus_fixtures import docs  # noqa: F401

import __spark_entry__
import corpus_pipeline
from llm.common import store, table

SF = "/root/testdata/sf0.01"


def test_eleven_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert [s[1].__name__ for s in corpus_pipeline.STAGES] == ["quality", "toxic", "near_copies", "passages", "packed"]


@pytest.fixture(scope="module")
def stages(spark):
    out, at = [], table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        out.append(at := store(stage(spark, at, SF), "stage"))
    return out


def test_stages_pass_on_the_columns_of_documents(spark, stages):
    want = table(spark, SF, "documents").dtypes
    assert all(s.dtypes == want for s in stages[:-1])
    sizes = [s.select("doc_id").distinct().count() for s in stages]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0


def test_clean_documents_stay_and_labelled_ones_go(spark, stages):
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    before = {r["doc_id"] for r in table(spark, SF, "documents").collect()}
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    clean = [i for i in before if i in labels and labels[i]["quality"] == 1 and labels[i]["toxic"] == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    poor = [i for i in before if i in labels and labels[i]["quality"] == 0]
    assert sum(i in kept for i in poor) <= 0.2 * len(poor)


def test_near_copies_and_passages(spark, docs):
    base = " ".join(f"word{i}" for i in range(150))
    shared = " ".join(f"shared{i}" for i in range(60))
    own = [" ".join(f"own{k}x{i}" for i in range(120)) for k in range(2)]
    rows = [(1, base), (2, base.replace("word70", "other")), (3, base), (4, "é" + shared + own[0]), (5, own[1] + shared + "é"),
            (6, None), (7, ""), (None, "kept"), (None, None), (5, own[1] + shared + "é")]
    given = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.near_copies(spark, given, SF)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 5, 6)] + [(True, 0)] * 2
    cut = {r["doc_id"]: r for r in corpus_pipeline.passages(spark, kept, SF).collect() if r["doc_id"] is not None}
    assert cut[1]["text"] == base and cut[4]["text"] == "é" + shared + own[0]
    assert cut[5]["text"] == own[1] + "é" and cut[5]["n_chars"] == len(own[1]) + 1
    assert cut[6]["text"] is None


def test_each_text_of_an_id_keeps_its_group(spark, docs):
    """A doc_id with two texts stands for both groups, and clashing names or marks of the author's change nothing."""
    a, b = (" ".join(f"{k}w{i}" for i in range(60)) for k in "ab")
    given = docs([(1, a), (1, b + " more"), (2, a), (3, b + " more"), (4, "end \ufffd own"), (5, None)]).withColumn("cut_text", F.lit("mine"))
    given = given.select("doc_id", "text", "lang", "source", "n_chars", "cut_text")
    kept = corpus_pipeline.near_copies(spark, given, SF)
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, a), (1, b + " more"), (4, "end \ufffd own"), (5, "")]
    cut = corpus_pipeline.passages(spark, kept.unionByName(kept.where("doc_id = 4").withColumns({"doc_id": F.lit(9), "text": F.concat(F.lit("x\ufffd" + a[:70] + "\ufffdé"), "text")})), SF)
    assert cut.columns == given.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in cut.collect()) == [(1, a), (1, b + " more"), (4, "end \ufffd own"), (5, ""), (9, "x\ufffd\ufffdéend \ufffd own")]


def test_whole_run_is_packed(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
