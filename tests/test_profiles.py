"""Profiles merged against profiles of all rows, and exact quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxgrain.operators import profiles as pf


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(6)
    rows = [
        (i % 4, float(x) if i % 9 else None, int(k), 5.0 if i % 10 else float(x), None)
        for i, (x, k) in enumerate(zip(rng.lognormal(size=6000), rng.integers(0, 40, 6000)))
    ]
    return spark.createDataFrame(rows, "run int, skewed double, whole long, same double, nothing double").repartition(5)


COLUMNS = ["skewed", "whole", "same", "nothing"]


def test_merged_runs_are_the_whole(numbers):
    whole = {r["column_name"]: r for r in pf.figures(pf.profile(numbers, COLUMNS), (0.5,)).collect()}
    runs = pf.profile(numbers, COLUMNS, ["run"])
    assert runs.count() == 16
    merged = {r["column_name"]: r for r in pf.figures(pf.merged(runs.drop("run")), (0.5,)).collect()}
    for name in COLUMNS:
        values = np.array([r[name] for r in numbers.collect() if r[name] is not None], float)
        a, b = merged[name], whole[name]
        assert (a["n"], a["nulls"], a["low"], a["high"]) == (b["n"], b["nulls"], b["low"], b["high"]) and a["n"] == len(values)
        if len(values):
            assert np.isclose(a["mean"], values.mean()) and np.isclose(a["std"], values.std(ddof=1))
            assert abs(a["about_distinct"] - len(set(values))) <= 0.05 * len(set(values))
            assert 0.46 <= (values <= a["about_q50"]).mean() and (values < a["about_q50"]).mean() <= 0.54
    by_run = {(r["run"], r["column_name"]): r["mean"] for r in pf.merged(runs.union(runs), ["run"]).collect()}
    assert np.isclose(by_run[2, "whole"], numbers.where("run = 2").agg(F.avg("whole")).first()[0])


@pytest.mark.parametrize("few", [1_000_000, 60, 1])
def test_quantiles_are_exact(numbers, few):
    wanted = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    found = pf.exact_quantiles(numbers, pf.profile(numbers, COLUMNS), wanted, few)
    got = {r["column_name"]: [r[f"q{round(p * 100)}"] for p in wanted] for r in found.collect()}
    for name in COLUMNS:
        values = np.array([r[name] for r in numbers.collect() if r[name] is not None], float)
        assert np.allclose(got[name], np.quantile(values, wanted)) if len(values) else got[name] == [None] * len(wanted)


def test_a_sketch_that_is_off_is_noticed(numbers, monkeypatch):
    monkeypatch.setattr(pf, "MARGIN", -0.2)  # the bounds from the sketch miss the place
    found = pf.exact_quantiles(numbers, pf.profile(numbers, ["skewed"]), (0.5,), 500)
    values = np.array([r["skewed"] for r in numbers.collect() if r["skewed"] is not None])
    assert np.isclose(found.first()["q50"], np.median(values))


def test_no_rows(spark, numbers):
    empty = numbers.where("false")
    found = pf.profile(empty, COLUMNS)
    assert [r["n"] for r in found.collect()] == [0] * 4
    assert [r["q50"] for r in pf.exact_quantiles(empty, found, (0.5,)).collect()] == [None] * 4
