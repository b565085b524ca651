"""Boosted trees grown by one stage against Spark ML's own fit."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel, classification
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from tollgate.operators import boost

SETTINGS = {"labelCol": "label", "featuresCol": "raw", "weightCol": "w", "maxIter": 8, "maxDepth": 4, "minInstancesPerNode": 7, "stepSize": 0.2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(1500):
        y = float(rng.random() < 0.2)
        out.append((i, y, 2.5 if y else 0.6, rng.gauss(y, 1.0), rng.random() ** 3, float(rng.randrange(5)) + 2 * y * (i % 3 == 0), 7.0, float(i % 2)))
    df = spark.createDataFrame(out, "i long, label double, w double, a double, b double, c double, same double, flag double")
    return VectorAssembler(inputCols=["a", "b", "same", "c", "flag"], outputCol="raw").transform(df).persist()


def _scores(model, df):
    return np.array([r["p"] for r in model.transform(df).orderBy("i").select(vector_to_array("probability")[1].alias("p")).collect()])


def _jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = f()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_fit_equals_that_of_spark_ml(spark, rows, monkeypatch, tmp_path):
    theirs = classification.GBTClassifier(seed=0, **SETTINGS).fit(rows)
    for share in (10**9, 300):  # one task, and as many as there are slots
        monkeypatch.setattr(boost, "_SHARE", share)
        ours = boost.GBTClassifier(seed=0, **SETTINGS).fit(rows)
        assert ours.getNumTrees == 8 and ours.treeWeights == theirs.treeWeights and ours.numFeatures == 5 and ours.totalNumNodes == theirs.totalNumNodes
        assert _scores(ours, rows) == pytest.approx(_scores(theirs, rows), abs=1e-9)
        assert ours.getMaxDepth() == 4 and ours.getMinInstancesPerNode() == 7 and ours.getWeightCol() == "w"
    PipelineModel([ours]).save(f"{tmp_path}/held")
    assert (_scores(PipelineModel.load(f"{tmp_path}/held"), rows) == _scores(ours, rows)).all()


def test_jobs_do_not_grow_with_rounds(spark, rows):
    few, many = (_jobs(spark, f"boost-{n}", lambda n=n: boost.GBTClassifier(**SETTINGS | {"maxIter": n}).fit(rows))[1] for n in (1, 12))
    assert few == many


def test_thresholds_read_every_row(spark):
    n = 30_000
    df = spark.range(n, numPartitions=3).selectExpr("array(double(id * 7919 % 30000), if(id = 17, 1D, 0D)) x", "1D w")
    width, count, cuts = boost.thresholds(df, 32)
    assert (width, count) == (2, n) and cuts[1].tolist() == [0.5]  # one row in 30,000
    assert len(cuts[0]) == 31 and np.abs(cuts[0] - np.arange(1, 32) * n / 32).max() < n / boost.SUMMARY * 3


def test_bad_labels_end_the_fit(spark, rows):
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        boost.GBTClassifier(**SETTINGS).fit(rows.selectExpr("raw", "w", "label + 1 as label"))
