"""Models on small tables whose classes and targets are known."""

import numpy as np
import pytest

from trackloom.operators import models as M, stats as S


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, float(rng.normal(4 * (i % 2), 0.3)), float(rng.normal())) for i in range(40) for _ in range(10)]
    return spark.createDataFrame(rows, "id long, code int, x double, y double")


@pytest.mark.parametrize("kind", ["tree", "forest", "svm", "boosting"])
def test_separable_classes_are_told_apart(points, kind):
    model = M.fit(points.filter("id < 30"), ["x", "y"], kind=kind)
    got = M.majority_vote(M.predict(model, points.filter("id >= 30"))).collect()
    assert len(got) == 10 and all(r.pred == r.id % 2 and r.confidence > 0.9 for r in got)


def test_cross_validation_tests_each_track_once(points):
    got = M.cross_validate(points, ["x", "y"], k=4).collect()
    assert sorted(r.id for r in got) == list(range(40)) and all(r.predicted == r.id % 2 for r in got)
    assert {r.fold for r in got} == {0, 1, 2, 3}


def test_a_sweep_has_a_report_for_each_setting(spark, points):
    settings = spark.createDataFrame([("tree", 1, 20), ("forest", 2, 30)], "kind string, seed int, n int")
    got = M.sweep(points, settings, ["x", "y"]).collect()
    assert sorted((r.setting, r.predicted == r.id % 2) for r in got) == [(0, True)] * 20 + [(1, True)] * 30


def test_regression_finds_a_plain_dependence(spark):
    rows = [(i, i / 100, (i * 7919 % 100) / 100) for i in range(100)]
    df = spark.createDataFrame([(i, a, b, 0.9 if a > 0.5 else 0.1) for i, a, b in rows], "id long, a double, b double, target double")
    got = M.cross_validated_regression(df, ["a", "b"], "target", k=4, numTrees=20).collect()
    assert sorted(r.id for r in got) == list(range(100)) and sum(abs(r.y - r.pred) for r in got) / 100 < 0.15


def test_principal_components_of_two_dependent_columns(spark):
    rows = [(float(i), 2.0 * i + 1, float(i * 7919 % 31)) for i in range(100)]
    share, weight = S.pca(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], 2)
    share, weight = [r.share for r in share.collect()], {r.feature: r.importance for r in weight.collect()}
    assert abs(sum(share) - 1) < 1e-6 and share[0] > 0.6 and abs(weight["a"] - weight["b"]) < 1e-6
