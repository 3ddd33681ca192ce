"""Queries call the operators of the inventory rows that they stand for; queries without SQL against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_oracles import DATA, QUERIES
from trackloom import registry
from trackloom.functions import times
from trackloom.operators import distances, enrich, motion, prune, report, resample, stats
from trackloom.sources import io
from trackloom.streaming import rows

CALLS = [
    ("S1", io, "read_fixes"), ("S2", io, "read_metadata"), ("S3", io, "clean_legacy"), ("S4", io, "base_table"), ("S5", io, "write_base"), ("S6", io, "read_effort"), ("S7", io, "read_matrix"), ("S8", io, "melt_grid"),
    ("S12", io, "materialize"), ("S13", io, "read_reports"), ("S14", io, "append_results"), ("S15", io, "add_missing"), ("F14", prune, "keep_inside"), ("F15", prune, "common_window"), ("F16", prune, "select_columns"),
    ("J9", enrich, "nearest_l1"), ("J16", enrich, "merge_covariates"), ("J17", enrich, "merge_covariates"), ("J18", enrich, "nearest_site"), ("J19", enrich, "impute_nearest"), ("J21", enrich, "distance_matrix"), ("J22", enrich, "shapelet_distances"),
    ("T4", stats, "representatives"), ("T12", stats, "bca_interval"), ("T17", stats, "sample_size_intervals"), ("T27", distances, "pooled_quantile"), ("T28", distances, "nearest_rows"), ("T29", distances, "stress"), ("F20", prune, "reported"), ("T11", stats, "resampled_means"), ("T13", stats, "resampled_medians"), ("W21", motion, "dead_reckon"), ("T7", stats, "feature_information"), ("T8", stats, "feature_redundancy"), ("V9", times, "day_from_periodic"), ("V16", times, "sentinel_to_null"),
    ("A18", enrich, "species_overlap"), ("C15", report, "maintained_summary"), ("C17", report, "multi_transfer"), ("C27", report, "taxa_accuracy_intervals"), ("W15", resample, "resample"), ("W16", resample, "impute_polynomial"), ("W20", motion, "translate_to_origin"),
    ("J4", rows, "enrich_stream"),
]


@pytest.mark.parametrize("row, module, name", CALLS)
def test_a_query_of_the_row_calls_the_operator(spark, monkeypatch, row, module, name):
    called, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **b: called.append(name) or plain(*a, **b))
    for query in (q for q, found in registry.covered().items() if row in found):
        QUERIES[query](spark, DATA)
        if called:
            return
    raise AssertionError(f"no query of {row} calls {name}")


def test_polynomials_are_those_of_least_cross_validated_error(spark):
    x = np.arange(40)
    tracks = {1: 3 + 0.5 * x, 2: 0.01 * x**2 - x, 3: np.full(40, 7.0)}
    data = [(i, int(k) + 100 * i, f"2024-01-{1 + k // 2:02d} {12 * (k % 2):02d}:00:00", float(v), 0.0) for i, t in tracks.items() for k, v in enumerate(t)]
    df = spark.createDataFrame(data, "id long, fix_id long, date_time string, latitude double, longitude double").withColumn("date_time", F.to_timestamp("date_time"))
    got = resample.impute_polynomial(df, rate=4.0).toPandas().sort_values(["id", "slot"])
    for i, t in tracks.items():
        p = got[got.id == i]
        assert p.latitude_degree.iloc[0] == {1: 1, 2: 2, 3: 0}[i] and len(p) == 79
        at = (p.slot.to_numpy() - p.slot.iloc[0]) / 2
        want = {1: 3 + 0.5 * at, 2: 0.01 * at**2 - at, 3: np.full(79, 7.0)}[i]
        assert np.allclose(p.latitude, want, atol=1e-6) and (p.longitude == 0).all()
    one = resample.impute_polynomial(df.filter("fix_id = 100")).toPandas()
    assert one.latitude.tolist() == [3.0] and one.latitude_error.isna().all()


def test_imputation_reaches_every_track(spark):
    got = {r.id for r in QUERIES["w16_impute_polynomial"](spark, DATA).select("id").distinct().collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().count()


def test_chi_square_tail(spark):
    v = [0.0, 0.1, 1.0, 3.84, 10.0, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in v], "x double").select(report.chi_square_tail(F.col("x")).alias("p")).collect()]
    assert all(math.isclose(p, math.erfc(math.sqrt(x / 2)), rel_tol=2e-7) for p, x in zip(got, v, strict=True))


def test_intervals_hold_their_means(spark):
    for name, mean in (("c27_taxa_intervals", "accuracy"), ("t17_sample_size_intervals", "n_required")):
        found = QUERIES[name](spark, DATA).collect()
        assert found and all(r.low is None or r.low - 1e-6 <= r[mean] <= r.high + 1e-6 for r in found)
