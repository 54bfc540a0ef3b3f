import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.operators import scans

SCHEMA = "name string, time timestamp_ntz, tie int, value double"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def made(seed, n=400, missing=0.2):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), at(rng.randint(0, 3000)), k, None if rng.random() < missing else rng.uniform(-5, 50)) for k in range(n)]


def by_name(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [7, 100, 10**7, None])
def test_carried_values_match_a_walk(spark, width):
    rows = made(width or 5)
    value = F.col("value")
    got = scans.carried(spark.createDataFrame(rows, SCHEMA), ["name"], ["time", "tie"], sums={"total": value}, lasts={"before": value}, nexts={"after": value}, marks={"mark": ("total", value > 40)}, width=width)
    found = {r["tie"]: (r["total"], r["before"], r["after"], r["mark"]) for r in got.collect()}
    assert len(found) == len(rows)
    for own in by_name(rows).values():
        for k, r in enumerate(own):
            upto = [x[3] for x in own[: k + 1] if x[3] is not None]
            before = [x[3] for x in own[:k] if x[3] is not None]
            after = [x[3] for x in own[k + 1 :] if x[3] is not None]
            high = [j for j, x in enumerate(own[:k]) if (x[3] or 0) > 40]
            mark = pytest.approx(sum(x[3] or 0 for x in own[: high[-1] + 1])) if high else None
            assert found[r[2]] == (pytest.approx(sum(upto)) if upto else None, before[-1] if before else None, after[0] if after else None, mark)


@pytest.mark.parametrize("within", [None, 60, 1])
def test_asof_join_matches_a_search(spark, within):
    left, right = made(1), made(2, missing=0)
    found = scans.asof_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).withColumnRenamed("value", "price"), ["name"], ["price"], tie="tie", within=within, width=50)
    assert found.columns == ["name", "time", "tie", "value", "price"]
    got = {r["tie"]: r["price"] for r in found.collect()}
    for name, time, tie, _ in left:
        earlier = [r for r in by_name(right).get(name, []) if r[1] <= time and (within is None or r[1] > time - datetime.timedelta(seconds=within))]
        assert got[tie] == (earlier[-1][3] if earlier else None)


@pytest.mark.parametrize("missing, width", [(0, 40 * 60), (0.3, None), (0.95, None)])
def test_recursive_averages_match_pandas(spark, missing, width):
    rng = random.Random(7)
    rows = [(name, at(60 * k), k, None if rng.random() < missing else rng.uniform(1, 100)) for name in ("a", "b", None) for k in range(3000 if name == "a" else 50)]
    alphas = {"slow": 2 / 27, "fast": 2 / 13, "steep": 0.97, "whole": 1.0}
    got = scans.recursive_averages(spark.createDataFrame(rows, SCHEMA), ["name"], {n: ("value", a) for n, a in alphas.items()}, width=width).orderBy("name", "time").toPandas()
    assert len(got) == len(rows)
    for name, own in got.groupby(got["name"].fillna("none")):
        for column, alpha in alphas.items():
            want = own["value"].ewm(alpha=alpha, adjust=False).mean()
            pd.testing.assert_series_equal(own[column].astype(float), want, check_names=False, rtol=1e-13)


def test_averages_after_very_long_gaps(spark):
    rows = [("a", at(k), k, 1.0 + k if k in (0, 1, 5000, 5001, 9000) else None) for k in range(9002)]
    got = scans.recursive_averages(spark.createDataFrame(rows, SCHEMA), ["name"], {"e": ("value", 2 / 13)}).orderBy("time").toPandas()
    pd.testing.assert_series_equal(got["e"].astype(float), got["value"].ewm(alpha=2 / 13, adjust=False).mean(), check_names=False, rtol=1e-12)


@pytest.mark.parametrize("width", [None, 40 * 86_400])
def test_indicators_of_bars_with_gaps_match_pandas(spark, width):
    rng = random.Random(12)
    rows = [(name, at(86_400 * k), rng.uniform(50, 60), rng.uniform(30, 40), None if rng.random() < 0.15 else rng.uniform(40, 50)) for name in "ab" for k in range(120)]
    bars = spark.createDataFrame(rows, "symbol string, time timestamp_ntz, high double, low double, close double")
    both = recursive.macd_rsi(bars, "symbol", width=width).join(recursive.atr_wilder(bars, "symbol", width=width), ["symbol", "time"]).join(recursive.ema(bars.drop("high", "low"), "symbol", (12, 26), width=width), ["symbol", "time"])
    for _, own in both.join(bars.drop("close"), ["symbol", "time"]).orderBy("symbol", "time").toPandas().groupby("symbol"):
        close = own["close"].astype(float)
        fast, slow = (close.ewm(span=n, adjust=False).mean() for n in (12, 26))
        change = close.diff()
        up, down = (part.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for part in (change.clip(lower=0), (-change).clip(lower=0)))
        reach = pd.concat([own["high"] - own["low"], (own["high"] - close.shift()).abs(), (own["low"] - close.shift()).abs()], axis=1).max(axis=1)
        want = {"ema_12": fast, "ema_26": slow, "macd": fast - slow, "macd_signal": (fast - slow).ewm(span=9, adjust=False).mean(), "rsi": 100 * up / (up + down), "atr_wilder": reach.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()}
        for name, values in want.items():
            pd.testing.assert_series_equal(own[name].astype(float), values, check_names=False, rtol=1e-10)


def test_spans_below_one_are_refused(spark):
    with pytest.raises(ValueError):
        recursive.ema(spark.createDataFrame([], "symbol string, time timestamp_ntz, close double"), "symbol", (0,))


def test_nothing_and_wrong_weights(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scans.recursive_averages(none, ["name"], {"e": ("value", 0.5)}).isEmpty()
    assert scans.asof_join(none, none.select("name", "time", F.lit(1).alias("p")), ["name"], ["p"]).isEmpty()
    with pytest.raises(ValueError):
        scans.recursive_averages(none, ["name"], {"e": ("value", 0.0)})
