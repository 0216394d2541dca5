import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators.spikes import implausible_readings, kalman_excursions, vanished_variance


def series(n=300, seed=1):
    rng = np.random.default_rng(seed)
    return 40 + np.cumsum(rng.normal(0, 1, n)) * 0.3 + rng.normal(0, 0.2, n)


def test_short_excursions_are_found_and_swings_are_not():
    x = series()
    x[50] += 30
    x[120:123] -= 25
    x[200:260] += np.concatenate([np.linspace(0, 40, 30), np.linspace(40, 0, 30)])  # builds up and fades
    x[280:] += 20  # the level moves
    got = set(np.flatnonzero(kalman_excursions(x, np.arange(len(x)), 6.0, 3)))
    assert got == {50, 120, 121, 122}


def test_stuck():
    x = series(60)
    x[10:16] = x[10]
    x[30:35] = x[30]
    assert set(np.flatnonzero(vanished_variance(x, np.arange(60), 6))) == set(range(10, 16))


def test_operator(spark):
    x = series(200)
    x[60] += 50
    rows = [(i, "z", float(v), i * 3600) for i, v in enumerate(x)]
    rows += [(500, "z", float(x[60]), 60 * 3600), (501, "z", None, 61 * 3600), (502, None, 5.0, 3600), (503, "z", 1e6, None), (504, "z", float("nan"), 7), (505, "y", 3.0, 0)]
    df = spark.createDataFrame(rows, "id long, zone string, price double, t long").selectExpr("*", "1 as series", "2 as w", "3 as v")
    got = {(r.id, r.reason) for r in implausible_readings(df, ["zone"], "t", "price", "id", (-100.0, 1000.0)).collect()}
    assert got == {(60, "spike"), (500, "spike"), (503, "impossible"), (504, "impossible")}
    assert implausible_readings(df.limit(0), ["zone"], "t", "price", "id", (-1.0, 1.0)).count() == 0


def test_windows_do_not_change_the_verdict(spark):
    x = series(1500, 3)
    x[::97] += 40
    df = spark.createDataFrame([(i, "z", float(v), i * 3600) for i, v in enumerate(x)], "id long, zone string, price double, t long")
    whole = {r.id for r in implausible_readings(df, ["zone"], "t", "price", "id", (-1e3, 1e3), window_steps=100_000, margin_steps=96).collect()}
    cut = {r.id for r in implausible_readings(df, ["zone"], "t", "price", "id", (-1e3, 1e3), window_steps=336, margin_steps=96).collect()}
    assert whole == cut and len(whole) >= 14


def test_a_stuck_value_with_jitter_has_no_innovation_variance():
    x = series(60)
    x[10:18] = x[10] + np.array([0, 1, -1, 2, 0, 1, 0, -1]) * 1e-9
    assert set(np.flatnonzero(vanished_variance(x, np.arange(60), 6))) == set(range(10, 18))
    x[30:36] = x[30] + np.array([0, 1, -1, 1, 0, 1]) * 0.01  # small, but a movement
    assert 30 not in np.flatnonzero(vanished_variance(x, np.arange(60), 6))


@pytest.mark.parametrize("step", [1, 300, 14 * 86_400, 30 * 86_400])
def test_series_of_any_step_are_judged_alike(spark, step):
    x = series(200)
    x[60] += 50
    x[100:107] = x[100]
    df = spark.createDataFrame([(i, "z", float(v), 1_500_000_000 + i * step) for i, v in enumerate(x)], "id long, zone string, price double, t long")
    got = {(r.id, r.reason) for r in implausible_readings(df, ["zone"], "t", "price", "id", (-1e3, 1e3)).collect()}
    assert got == {(60, "spike"), *((i, "stuck") for i in range(100, 107))}
    twice = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    again = {(r.id % 1000, r.reason) for r in implausible_readings(twice, ["zone"], "t", "price", "id", (-1e3, 1e3)).collect()}
    assert again == got


def test_short_series():
    assert list(kalman_excursions(np.array([5.0, 6.0, 500.0, 5.5, 6.5, 5.2]), np.arange(6.0), 4.5, 3)) == [False, False, True, False, False, False]
    for n in range(4):
        assert not kalman_excursions(np.arange(n, dtype=float), np.arange(n, dtype=float), 4.5, 3).any()
