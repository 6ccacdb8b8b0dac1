import json
import os

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from urlsieve.catalog import relations as R
from urlsieve.functions.labels import label_a, label_b, label_c
from urlsieve.operators.models import ModelConfig, load_models, score
from urlsieve.plans.build_master import build_master
from urlsieve.plans.train import smoke_relation, train, training_rows
from urlsieve.session import scratch_path, shared_dir
from urlsieve.sources import master as M
from urlsieve.sources.corpora import (
    SourceSpec, has_quoted_line_breaks, public_corpora, read_corpora, read_corpus,
)
from urlsieve.streaming.features import featurise, stream_features, stream_scores, url_stream

CSV_A = 'url,type,extra\nx.com/a,benign,1\n"y.com/""q"",z",phishing,2\nNA,benign,3\nz.com,null,4\n,benign,5\nw.com, Benign,6\n'
CSV_C = "﻿FILENAME,URL,junk,label\nf1,c.com,9,1\nf2,d.com,9,0\nf3,e.com,9,x\n"


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_csv_reading(spark, tmp_path):
    a = put(tmp_path, "a.csv", CSV_A)
    spec = SourceSpec("a", ("/nowhere/a.csv", a), "url", "type", label_a)
    got = {(r.url, r.label, r.source) for r in read_corpus(spark, spec).collect()}
    assert got == {("x.com/a", 0, "a"), ('y.com/"q",z', 1, "a"), ("w.com", 0, "a")}


def test_bom_and_flipped_label(spark, tmp_path):
    c = put(tmp_path, "c.csv", CSV_C)
    for multi_line in (None, True, False):
        spec = SourceSpec("c", (c,), "URL", "label", label_c, multi_line=multi_line)
        assert {(r.url, r.label) for r in read_corpus(spark, spec).collect()} == {("c.com", 0), ("d.com", 1), ("e.com", 0)}


def test_positional_fallback(spark, tmp_path):
    b = put(tmp_path, "b.csv", "address,kind,more\nq.com,good,1\nr.com,bad,2\n")
    spec = SourceSpec("b", (b,), "URL", "Label", label_b)
    assert {(r.url, r.label) for r in read_corpus(spark, spec).collect()} == {("q.com", 0), ("r.com", 1)}


def test_quoted_line_breaks_are_found(spark, tmp_path):
    flat = put(tmp_path, "flat.csv", CSV_A)
    broken = put(tmp_path, "broken.csv", 'url,type\n"a.com/\nx",benign\nb.com,phishing\n')
    assert not has_quoted_line_breaks(spark, flat)
    assert has_quoted_line_breaks(spark, broken)
    rows = read_corpus(spark, SourceSpec("a", (broken,), "url", "type", label_a)).collect()
    assert {r.url for r in rows} == {"a.com/\nx", "b.com"}


def test_a_stray_quote_keeps_the_file_split(spark, tmp_path):
    stray = put(tmp_path, "stray.csv", 'url,type\na.com/"x,benign\n"b.com,y",phishing\nc.com,be"nign\n"d""q",benign\n')
    assert not has_quoted_line_breaks(spark, stray)


def test_training_rows_without_a_master(spark, sf, built):
    _, specs, _ = built
    rows = training_rows(spark, "/nowhere", specs)
    assert rows.columns == ["url", "label", "group"] and rows.count() == rows.select("url").distinct().count() > 0


def test_csv_master_keeps_line_breaks(spark):
    root = scratch_path(spark, "breaks")
    rows = [("a.com/x\ny", 1, "a.com", "s"), ("b.com", 0, "b.com", "s")]
    M.write_table(spark.createDataFrame(rows, "url string, label int, group string, source_dataset string"), root, ("csv",))
    assert {r.url for r in M.read_master(spark, root).collect()} == {"a.com/x\ny", "b.com"}


def test_missing_sources(spark, tmp_path):
    a = put(tmp_path, "malicious_phish.csv", CSV_A)
    assert a and read_corpora(spark, public_corpora(str(tmp_path)))[1] == ["malicious_phish"]
    with pytest.raises(FileNotFoundError):
        read_corpora(spark, public_corpora("/nowhere"))


@pytest.fixture(scope="module")
def built(spark, sf):
    """Corpora as CSV files, and the master built from them."""
    root = scratch_path(spark, "job")
    specs = []
    for name, corpus, cols, fn in (
        ("corpus_a", R.corpus_a, ("url", "type"), label_a), ("corpus_b", R.corpus_b, ("URL", "Label"), label_b),
        ("corpus_c", R.corpus_c, ("URL", "label"), label_c),
    ):
        corpus(spark, sf).write.option("header", True).option("escape", '"').csv(f"{root}/{name}.csv")
        specs.append(SourceSpec(name, (f"{root}/{name}.csv",), *cols, fn))
    manifest = build_master(spark, specs, f"{root}/out", policy_source="corpus_c")
    return root, specs, manifest


def test_build_master(spark, sf, built):
    root, _, manifest = built
    rows = spark.read.parquet(f"{root}/out/{M.PARQUET}")
    want = R.master_table(spark, sf)
    assert rows.columns == ["url", "label", "group", "source_dataset"]
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()
    totals = manifest["totals"]
    assert totals["benign"] + totals["phishing"] == totals["unique_urls"] == rows.count()
    assert sum(manifest["source_dataset_counts"].values()) == totals["unique_urls"]
    assert manifest["surface_form_audit"]["master"]["n_rows"] == totals["unique_urls"]
    assert set(manifest["per_source"]) == set(R.SOURCES)
    assert json.dumps(M.read_json(spark, f"{root}/out/{M.MANIFEST}")) == json.dumps(manifest)
    assert {f: o["bytes"] > 0 for f, o in manifest["outputs"].items()} == {"parquet": True, "csv": True}
    text = spark.read.option("header", True).option("escape", '"').csv(f"{root}/out/{M.CSV}")
    assert text.count() == rows.count()


def test_sampled_master(spark, built):
    root, specs, _ = built
    manifest = build_master(spark, specs, f"{root}/small", sample=50, formats=("parquet",), policy_source="corpus_c")
    assert abs(manifest["totals"]["unique_urls"] - 50) <= 1
    assert M.read_master(spark, f"{root}/small").count() == manifest["totals"]["unique_urls"]


def test_version_gate(spark, built):
    root, _, manifest = built
    info = M.check_version(spark, f"{root}/out", M.NORMALIZATION_VERSION)
    assert info["label_conflicts"] == manifest["totals"]["label_conflicts"]
    with pytest.warns(UserWarning, match="rebuild"):
        M.read_master(spark, f"{root}/out", "v0")


def test_csv_master_fallback(spark, sf):
    root = scratch_path(spark, "csvonly")
    M.write_table(R.master_table(spark, sf), root, ("csv",))
    df = M.read_master(spark, root)
    assert df.count() == R.master_table(spark, sf).count() and dict(df.dtypes)["label"] == "int"


@pytest.fixture(scope="module")
def trained(spark, sf, built):
    root = built[0]
    master = training_rows(spark, f"{root}/out")
    cfg = ModelConfig(
        vocabulary_size=200, linear_epochs=10, nn_hidden=8, nn_epochs=3, nn_batch=64, tree_rounds=3,
        hybrid_rounds=2, leaves=8, hybrid_bins=32,
    )
    return root, train(spark, master, f"{root}/run", cfg)


def test_training_job(spark, trained):
    root, report = trained
    assert set(report["validation"]) == set(report["models"])
    metrics = M.read_json(spark, f"{root}/run/evaluation_metrics")
    assert metrics["validation"] == report["validation"] and metrics["updated_at"] == report["updated_at"]
    manifest = M.read_json(spark, f"{root}/run/run_manifest")
    assert all(M.path_bytes(spark, f"{root}/run/{a}") > 0 for a in manifest["artifacts"])
    assert set(report["models"]) == {"nlp", "nn", "tree", "hybrid", "champion", "serving"}
    for m in report["models"].values():
        assert m["tp"] + m["fp"] + m["tn"] + m["fn"] == report["test_set_size"]
    assert abs(sum(report["feature_importances"].values()) - 100) < 0.5
    smoke = report["out_of_corpus_smoke"]
    assert smoke["tp"] + smoke["fp"] + smoke["tn"] + smoke["fn"] == 34
    assert spark.read.parquet(f"{root}/run/smoke_verdicts").count() == 34
    config = M.read_json(spark, f"{root}/run/threshold_config")
    assert 0.3 <= config["serving_threshold"] <= 0.79
    assert M.read_json(spark, f"{root}/run/run_manifest")["n_features_hybrid"] == 230


def test_saved_models_score_alike(spark, trained):
    root, report = trained
    models = load_models(spark, f"{root}/run/models")
    rows = score(smoke_relation(spark), models).collect()
    assert len(rows) == 34
    for r in rows:
        for p in ("p_nlp", "p_nn", "p_tree", "p_hyb", "p_moe", "p_serving"):
            assert 0 <= r[p] <= 1
        assert r.p_moe == pytest.approx(0.5 * r.p_hyb + 0.3 * r.p_nn + 0.2 * r.p_nlp)
    mean = sum(r.p_serving for r in rows if r.label == 1) / 15
    assert report["smoke_mean_p"]["1"] == pytest.approx(mean, abs=1e-4)


def test_stream_equals_batch(spark, sf):
    pages = R.pages(spark, sf)
    root = scratch_path(spark, "stream")
    stream = url_stream(spark, sf, pages.schema, "pages.parquet").select("page_id", "url")
    stream_features(stream, f"{root}/sink", f"{root}/cp").awaitTermination()
    batch = featurise(pages.select("page_id", "url"))
    got = spark.read.parquet(f"{root}/sink")
    assert got.columns == batch.columns
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_stream_of_a_table_folder_has_all_its_files(spark, sf, tmp_path):
    pages = R.pages(spark, sf)
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    for query in (queries()["stream_features"], queries()["given_stream"]):
        got = query(spark, str(tmp_path)).select("page_id", F.col("raw_url").alias("url"))
        want = pages.select("page_id", "url")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_scores(spark, sf, trained):
    models = load_models(spark, f"{trained[0]}/run/models")
    pages = R.pages(spark, sf)
    root = scratch_path(spark, "stream")
    stream = url_stream(spark, sf, pages.schema, "pages.parquet").select("url")
    stream_scores(stream, models, f"{root}/sink", f"{root}/cp").awaitTermination()
    got = spark.read.parquet(f"{root}/sink")
    assert got.count() == pages.count() and got.filter("p_serving is null").isEmpty()
    assert got.select("raw_url").exceptAll(pages.select("url")).isEmpty()


def test_shared_dir_comes_from_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (before or spark.conf.get("spark.checkpoint.dir")).rstrip("/")
