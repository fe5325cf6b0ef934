import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

import fixtures as fx
from conftest import SF, rows
from holdfast.operators import models as md, trees as tr


@pytest.fixture(scope="module")
def train(spark):
    frame = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(fx.model_frame(spark, SF))
    return frame.select("id", "label", "features").persist()


@pytest.fixture(scope="module")
def boosted(train):
    return md.gradient_boosting(12).fit(train)


@pytest.mark.parametrize("k", [1, 5, 12])
def test_cut_model_is_the_long_one_after_k_rounds(spark, train, boosted, k):
    cut = tr.first_trees(spark, boosted, k)
    assert cut.getNumTrees == k and cut.getMaxIter() == k
    assert cut.evaluateEachIteration(train) == boosted.evaluateEachIteration(train)[:k]
    assert [t.toDebugString.split("\n", 1)[1] for t in cut.trees] == [t.toDebugString.split("\n", 1)[1] for t in boosted.trees[:k]]
    short = md.gradient_boosting(k).fit(train)  # what fitting anew would give
    assert rows(md.score(cut, train, ["id"])) == rows(md.score(short, train, ["id"]))


def test_rounds_out_of_range_and_other_models_raise(spark, train, boosted):
    for k in (0, 13):
        with pytest.raises(ValueError, match="trees"):
            tr.first_trees(spark, boosted, k)
    with pytest.raises(ValueError, match="no forest"):
        tr.node_table(spark, md.fit_logistic(train))


def test_patience_fits_once(spark, train, monkeypatch):
    fits, plain = [], md.GBTClassifier.fit
    monkeypatch.setattr(md.GBTClassifier, "fit", lambda self, df: fits.append(self.getMaxIter()) or plain(self, df))
    model = md.fit_boosting(train, "id", rounds=15, patience=1, tol=0.05)
    assert fits == [15] and model.getNumTrees < 15


def test_importances_from_nodes(spark, train, boosted):
    forest = md.fit_forest(train, trees=7, depth=4)
    for model, per_tree in ((boosted, False), (forest, True)):
        nodes = tr.node_table(spark, model)
        got = dict(rows(tr.node_importance(nodes, per_tree)))
        want = {i: v for i, v in enumerate(model.featureImportances.toArray()) if v}
        assert got == pytest.approx(want, abs=1e-12)
        assert nodes.count() == model.totalNumNodes
        assert nodes.select("tree").distinct().count() == model.getNumTrees
        assert nodes.where("feature is null").count() == sum(t.numNodes // 2 + 1 for t in model.trees)
        assert nodes.where("(feature is null) <> (left is null) or (left is null) <> (right is null)").isEmpty()
        inner = nodes.where("left is not null").alias("a")
        children = nodes.select("tree", "node", F.col("rows").alias("n")).alias("b")
        both = inner.join(children, (F.col("a.tree") == F.col("b.tree")) & (
            (F.col("b.node") == F.col("left")) | (F.col("b.node") == F.col("right"))))
        sums = both.groupBy("a.tree", "a.node", "rows").agg(F.sum("n").alias("n"))
        assert sums.where("abs(n - rows) > 1e-6").isEmpty() and sums.count() == inner.count()
