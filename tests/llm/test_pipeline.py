import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from urlsieve.llm.queries import ORACLES, QUERIES
from urlsieve.llm.simhash import simhash_components


@pytest.fixture(scope="module")
def steps(spark, small_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], small_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_return_documents(steps):
    for before, after in zip(steps, steps[1:-1], strict=False):
        assert after.dtypes == before.dtypes
    assert steps[-1].columns[0] == "doc_id" and steps[-1].count() == steps[-2].count()


def test_what_each_stage_keeps(steps):
    docs, clean, single, cut, mixed, encoded = [s.collect() for s in steps]
    ids = lambda rows: {r.doc_id for r in rows}
    assert ids(clean) < ids(docs) or ids(clean) == ids(docs)
    assert ids(single) < ids(clean) and len(single) == len(ids(single))
    assert [set(map(tuple, x)) <= set(map(tuple, docs)) for x in (clean, single)] == [True, True]
    assert ids(cut) == ids(single)
    whole = {r.doc_id: r.text for r in single}
    assert all(r.text == whole[r.doc_id] or len(r.text.split()) < len(whole[r.doc_id].split()) for r in cut)
    assert all(r.n_chars == len(r.text) for r in cut)
    assert ids(mixed) <= ids(cut) and max(sum(x.doc_id == r.doc_id for x in mixed) for r in mixed[:20]) <= 2
    assert sorted(r.decoded for r in encoded) == sorted(r.text for r in mixed)
    assert all(r.n_tokens == len(r.ids) for r in encoded)


def test_odd_rows_pass_through(spark, odd_docs, no_docs, small_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, small_dir)
            assert after.columns == docs.columns
            assert after.agg(F.count("*")).first()[0] <= 2 * docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).collect()


def test_run_equals_its_stages(spark, steps, small_dir):
    got = corpus_pipeline.run(spark, small_dir).select("doc_id", "decoded").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[-1].select("doc_id", "decoded").collect()))


def test_near_copies_are_the_components_of_operator_3(spark, odd_docs, small_dir):
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    for docs in (spark.read.parquet(f"{small_dir}/documents.parquet"), odd_docs.filter("doc_id <> 12")):
        kept = [r.doc_id for r in stage(spark, docs, small_dir).collect()]
        assert sorted(kept) == sorted({r.component_id for r in simhash_components(docs).collect()})
