import json
import os
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import fixtures as fx
from conftest import SF, plan, rows
from holdfast.operators import explain as ex, metrics as m, models as md
from holdfast.plans.review import review
from holdfast.plans.training import train_baseline, train_candidates
from holdfast.sources import artifacts as art
from holdfast.streaming import scoring

NAMES = ["feature_a", "feature_b", "feature_c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 3))
    y = (1 / (1 + np.exp(-(x[:, 0] + x[:, 1]))) > rng.random(200)).astype(int)
    data = [(i, *map(float, row), int(t)) for i, (row, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id int, feature_a double, feature_b double, feature_c double, label int")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).persist()


@pytest.fixture(scope="module")
def logistic(table):
    return md.fit_logistic(table)


@pytest.fixture(scope="module")
def forest(table):
    return md.fit_forest(table, trees=10, depth=3)


def newton(x, y, w, c, steps=25):
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([0.0] + [1 / c] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
    return b


@pytest.mark.parametrize("c,balanced", [(1.0, False), (0.01, False), (1.0, True)])
def test_logistic_solves_the_penalised_objective(table, c, balanced):
    data = table.orderBy("id").select(*NAMES, "label").collect()
    x, y = np.array([r[:3] for r in data]), np.array([r[3] for r in data])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    model = md.fit_logistic(table, balanced=balanced, c=c)
    got = np.array([model.intercept, *model.coefficients])
    assert np.abs(got - newton(x, y, w, c)).max() < 1e-5


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert rows(md.class_weights(df), "label", "n", "class_weight") == [(0, 3, 4 / 6), (1, 1, 2.0)]
    assert rows(md.with_balanced_weights(df).select("class_weight").distinct()) == [(4 / 6,), (2.0,)]
    with pytest.raises(ValueError, match="both classes"):
        md.with_balanced_weights(df.where("label = 0"))
    with pytest.raises(ValueError, match="0 or 1"):
        md.with_balanced_weights(df.withColumn("label", F.lit(2)))


def test_factories():
    forest, boost = md.random_forest(), md.gradient_boosting()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (100, 10, 5)
    assert (boost.getMaxIter(), boost.getMaxDepth(), boost.getStepSize()) == (100, 3, 0.1)
    assert md.logistic_regression(50.0, c=0.1).getRegParam() == pytest.approx(0.2)
    assert list(md.CANDIDATES) == ["logistic_regression", "random_forest", "gradient_boosting"]


def test_patience():
    falling = [1 / (i + 1) for i in range(20)]
    assert md.rounds_to_keep(falling, 10, 1e-4) == 20
    assert md.rounds_to_keep([1.0] * 30, 10, 1e-4) == 11
    assert md.rounds_to_keep([1.0, 0.5, 0.5, 0.5, 0.5, 0.5], 2, 1e-4) == 4
    assert md.rounds_to_keep([1.0, 2.0, 3.0], 1, 0.0) == 2


def test_scores(table, logistic):
    got = md.score(logistic, table, ["id", "label"]).persist()
    assert got.count() == 200 and got.where("y_prob between 0 and 1").count() == 200
    assert got.where("(y_prob > 0.5) <> (y_pred = 1)").count() == 0
    auc = m.roc_auc(got.withColumnRenamed("label", "y_true")).first()["roc_auc"]
    assert auc > 0.7


def test_seeds_repeat(table):
    a, b = (md.fit_forest(table, trees=5, depth=3) for _ in range(2))
    assert rows(md.score(a, table, ["id"])) == rows(md.score(b, table, ["id"]))


def test_boosting_stops_early(table):
    model = md.fit_boosting(table, "id", rounds=12, patience=2, tol=0.05)
    assert 1 < model.getNumTrees < 12
    assert md.fit_boosting(table, "id", rounds=5, tol=0.0, patience=5).getNumTrees == 5


def test_scoring_record(spark):
    df = spark.createDataFrame([(0.69996,), (0.5,), (0.123456,)], "y_prob double")
    assert [tuple(r) for r in md.scoring_record(df).collect()] == [
        (0.7, True, "medium", 0.7), (0.5, True, "medium", 0.5), (0.1235, False, "low", 0.8765)]


def test_coefficient_table(spark, logistic):
    got = ex.coefficients(spark, logistic, NAMES).collect()
    sizes = [r["abs_coefficient"] for r in got]
    assert len(got) == 3 and sizes == sorted(sizes, reverse=True)
    assert all((r["coefficient"] > 0) == (r["direction"] == "Increases Churn") for r in got)
    with pytest.raises(ValueError, match="names"):
        ex.coefficients(spark, logistic, NAMES[:2])


def test_importances(spark, logistic, forest, table):
    trees = ex.tree_importance(spark, forest, NAMES).collect()
    values = [r["importance"] for r in trees]
    assert values == sorted(values, reverse=True) and trees[-1]["cumulative_importance"] == pytest.approx(1.0)
    assert [r["rank"] for r in trees] == [1, 2, 3]
    shares = ex.feature_importance(spark, logistic, NAMES)
    assert shares.columns == ["feature", "importance", "coefficient", "direction"]
    assert shares.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert ex.feature_importance(spark, forest, NAMES).count() == 3
    with pytest.raises(ValueError, match="featureImportances"):
        ex.tree_importance(spark, logistic, NAMES)
    with pytest.raises(ValueError, match="unsupported"):
        ex.feature_importance(spark, VectorAssembler(inputCols=["a"], outputCol="b"), NAMES)


def test_listing(spark):
    long_name = "categorical__" + "n" * 60
    df = spark.createDataFrame([("num__a", 0.2), (long_name, 0.5), ("b", 0.3)], "feature string, importance double")
    got = ex.importance_listing(df, 2).collect()
    assert [r["name"] for r in got] == ["[CAT] " + "n" * 29 + "...", "b"]
    assert len(got[0]["name"]) == 38 and got[0]["share"] == "50.0%" and got[0]["explained"] == 0.8


def test_explanations(table, logistic, forest):
    got = ex.explain_predictions(logistic, table, NAMES, ["id", "features"], top_n=2)
    row = got.orderBy("id").first()
    products = {n: v * c for n, v, c in zip(NAMES, row["features"], logistic.coefficients)}
    want = sorted(products, key=lambda n: -abs(products[n]))[:2]
    assert [c["feature"] for c in row["top_contributors"]] == want
    assert row["prediction"] in ("Will Churn", "Will Stay") and len(row["top_features"]) == 2
    assert row["confidence"] == max(row["churn_probability"], 1 - row["churn_probability"])
    assert "Python" not in plan(got) and "Exchange" not in plan(got).split("InMemoryTableScan")[0]
    trees = ex.explain_predictions(forest, table, NAMES, ["id"])
    assert trees.where("top_contributors is not null").count() == 0
    texts = [r[0] for r in ex.explanation_text(trees).collect()]
    assert all("Main factors" not in t and "%" in t and "Next step" not in t for t in texts)
    levels = {f"{k} Risk": k for k in ("High", "Medium", "Low")}
    texts = [r[0] for r in ex.explanation_text(trees, actions=levels).collect()]
    assert all(t.splitlines()[-1] == f"Next step: {t.split('Risk level: ')[1].split()[0]}" for t in texts)
    text = ex.explanation_text(got, ["id"]).first()["explanation"]
    assert "1. feature_" in text and "churn risk" in text


def test_saved_model_scores_the_same(spark, table, folder):
    from pyspark.ml import PipelineModel
    model = PipelineModel([md.fit_logistic(table)])
    art.save_model(model, folder("model"))
    again = art.load_model(art.save_model(model, folder("model")))
    assert rows(md.score(again, table, ["id"])) == rows(md.score(model, table, ["id"]))


@pytest.fixture(scope="module")
def baseline(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("baseline"))
    return train_baseline(fx.accounts(spark, "/root/testdata/sf0.01"), out), out


def test_baseline_run(spark, baseline):
    run, out = baseline
    got = {r["split"]: r for r in run.evaluation.collect()}
    assert {k: r["n_samples"] for k, r in got.items()} == {"validation": 226, "test": 225}
    assert run.gaps.count() == 5
    assert sorted(os.listdir(out)) == ["metrics", "model", "schema"]
    part = next(f for f in os.listdir(f"{out}/metrics") if f.endswith(".json"))
    saved = json.loads(open(f"{out}/metrics/{part}").read())
    assert saved["test"]["n_samples"] == 225 and set(saved["validation"]["metrics"]) == set(m.METRICS)
    assert spark.read.json(f"{out}/schema").count() == 47


def test_review_finds_the_same_test_rows(spark, baseline, folder):
    run, out = baseline
    tables = review(art.load_model(f"{out}/model"), fx.accounts(spark, "/root/testdata/sf0.01"), folder("reports"))
    assert sum(r["n"] for r in tables["errors"].collect()) == 225
    assert sorted(os.listdir(folder("reports"))) == sorted(tables)


def test_stream_scores_like_a_table(spark, baseline, folder):
    run, _ = baseline
    records = fx.accounts(spark, SF).drop("Churn")
    records.repartition(3).write.json(folder("in"))

    def drain():
        stream = scoring.read_record_stream(spark, folder("in"), records.schema, files_per_batch=1)
        scoring.write_scores(stream, run.pipeline.model, folder("out"), folder("check"), ["customerID"]).awaitTermination()
        return spark.read.parquet(folder("out"))

    cols = ["customerID", "route", "reasons", "churn_probability", "risk_level", "confidence"]
    table = scoring.score_records(records, run.pipeline.model, ["customerID"])
    got = drain()
    assert rows(got, *cols) == rows(table, *cols)
    assert got.where("route = 'rejected' and churn_probability is not null").count() == 0
    assert got.where("route = 'rejected'").count() == records.where("Contract is null or trim(TotalCharges) = ''").count()
    # A restart finds nothing new; late files are scored once.
    assert drain().count() == records.count()
    records.limit(5).coalesce(1).write.mode("append").json(folder("in"))
    assert drain().count() == records.count() + 5


def landed(spark, records, path):
    """Records in three files, and a file of what cannot be read."""
    records.repartition(3).write.json(path)
    bad = ['{"customerID": "cut', "no json", '{"customerID": "T1", "tenure": "many"}', "[1, 2", ""]
    spark.createDataFrame([(x,) for x in bad], "value string").coalesce(1).write.mode("append").text(path)


def test_unreadable_records_are_rejected_with_their_text(spark, baseline, folder):
    run, _ = baseline
    records = fx.accounts(spark, SF).drop("Churn").limit(30)
    landed(spark, records, folder("in"))
    stream = scoring.read_record_stream(spark, folder("in"), records.schema)
    scoring.write_scores(stream, run.pipeline.model, folder("out"), folder("check"), ["customerID"]).awaitTermination()
    out = spark.read.parquet(folder("out"))
    bad = out.where("array_contains(reasons, 'unreadable')")
    assert sorted(r["unreadable_record"] for r in bad.collect()) == sorted(
        ['{"customerID": "cut', "no json", '{"customerID": "T1", "tenure": "many"}', "[1, 2"])
    assert {(r["route"], r["churn_probability"], len(r["reasons"])) for r in bad.collect()} == {("rejected", None, 1)}
    assert out.count() == 34


@pytest.mark.parametrize("lost", ["commit", "commit and sink"])
def test_a_batch_cut_off_is_made_up_for(spark, baseline, folder, lost):
    """Stopped between batches, then started again from a checkpoint whose last batch had not been settled."""
    run, _ = baseline
    records = fx.accounts(spark, SF).drop("Churn")
    landed(spark, records, folder("in"))

    def start(**more):
        stream = scoring.read_record_stream(spark, folder("in"), records.schema, files_per_batch=1)
        return scoring.write_scores(stream, run.pipeline.model, folder("out"), folder("check"), ["customerID"], **more)

    query = start(interval="1 second")
    deadline = time.time() + 120
    while not os.path.exists(f"{folder('check')}/commits/1") and time.time() < deadline:
        time.sleep(0.1)
    query.stop()
    done = max(int(x) for x in os.listdir(f"{folder('check')}/commits") if x.isdigit())
    last = max(int(x) for x in os.listdir(f"{folder('check')}/offsets") if x.isdigit())
    for batch in range(done, last + 1):  # what a driver that dies in the middle of this batch leaves
        gone = [f"{folder('check')}/commits/{batch}"] + [f"{folder('out')}/_spark_metadata/{batch}"] * (lost != "commit")
        for path in gone:
            for name in (path, f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"):
                if os.path.exists(name):
                    os.remove(name)
    start().awaitTermination()
    out = spark.read.parquet(folder("out"))
    assert sorted(r[0] for r in out.where("unreadable_record is null").select("customerID").collect()) == sorted(
        r[0] for r in records.select("customerID").collect())
    assert out.where("unreadable_record is not null").count() == 4


def test_candidate_run(spark, folder):
    params = {"random_forest": {"trees": 5, "depth": 3}, "gradient_boosting": {"rounds": 3}}
    run = train_candidates(fx.accounts(spark, "/root/testdata/sf0.01"), folder("out"), params=params)
    assert {r["split"]: r["n"] for r in run.summary.collect()} == {"train": 900, "validation": 300, "test": 300}
    order = [r["roc_auc"] for r in run.comparison.collect()]
    assert order == sorted(order, reverse=True) and run.best == run.comparison.first()["model"]
    assert all(t.seconds > 0 for t in run.trained.values())
    assert set(os.listdir(folder("out"))) == {run.best, "logistic_regression"}
    assert run.overfit.count() == 3
