"""The study's store: commits that survive a lost driver, and tables of another source."""

import json

import pytest

from tidewind.plans import contracts
from tidewind.plans.pipeline import Study
from tidewind.plans.store import Store


def test_texts_replace_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("a/b.json") is None
    for text in ("first", "zweite ü", ""):
        store.write("a/b.json", text)
        assert store.read("a/b.json") == text


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_a_commit_that_was_noted_is_finished(spark, tmp_path, steps, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.commit("s", {n: store.write_fresh(spark.range(1), n) for n in ("x", "y")}, {"t.json": "old"})
    fresh = {n: store.write_fresh(spark.range(5), n) for n in ("x", "y")}
    assert spark.read.parquet(store.path("x")).count() == 1
    store.write("commits/s.json", json.dumps({"moves": fresh, "texts": {"t.json": "new"}}))
    for name in ("x", "y")[:steps]:  # the driver is lost after so many moves
        store._fs.delete(store._at(name), True)
        store._fs.rename(store._at(fresh[name]), store._at(name))
    again = Store(spark, str(tmp_path))
    assert [spark.read.parquet(again.path(n)).count() for n in ("x", "y")] == [5, 5]
    assert again.read("t.json") == "new" and not again.exists("commits/s.json")


def test_tables_written_but_not_noted_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit("s", {"x": store.write_fresh(spark.range(1), "x")}, {})
    store.write_fresh(spark.range(5), "x")
    assert spark.read.parquet(Store(spark, str(tmp_path)).path("x")).count() == 1


def test_a_model_refuses_a_baseline_of_other_rows(spark, sf_dir, tmp_path):
    study = Study(spark, sf_dir, str(tmp_path), model="adaboost")
    for stage in ("data_foundation", "baseline"):
        study.run(stage)
    rows = study.table("canonical").toPandas().iloc[1:]
    spark.createDataFrame(rows, study.table("canonical").schema).write.mode("overwrite").parquet(study.path("canonical"))
    for force in (False, True):
        with pytest.raises(contracts.StaleOutputError, match="baseline was made from another canonical"):
            study.run("model", force)
    with pytest.raises(contracts.StaleOutputError, match="no contract"):
        contracts.check_source(None, "model", {})


def test_the_study_goes_on_to_comparison_errors_and_gate(spark, sf_dir, tmp_path):
    study = Study(spark, sf_dir, str(tmp_path), model="adaboost")
    for stage in study.stages:
        assert study.run(stage) == "made"
    assert {r["model"] for r in study.table("model_ranking").collect()} == {"baseline_zero", "adaboost"}
    summary, n = study.table("error_summary").first(), study.table("oos_predictions").count()
    assert summary["k"] == round(n * 0.01) == study.table("top_errors").count()
    assert study.table("error_clusters").agg({"n_dates": "sum"}).first()[0] == summary["k"]
    assert all(r["n_violations"] == 0 for r in study.table("integrity_gate").collect())
    assert set(json.loads(study.store.read("manifest.json"))) == set(study.stages)
