import datetime
import random

import pytest

from tidemark.operators import monitoring
from tidemark.streaming import alerts

SCHEMA = "name string, time timestamp_ntz, value double"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def made(seed, n=300):
    """Samples at uneven times, with gaps, values that are no number, and one series that stops."""
    rng, rows = random.Random(seed), []
    for name in ("a", "b", "c"):
        now, high = rng.randint(0, 100), False
        for _ in range(n if name != "c" else 20):
            now += rng.choice([5, 20, 60, 60, 60, 61, 150, 900])
            high = high if rng.random() < 0.8 else not high
            rows.append((name, at(now), float("nan") if rng.random() < 0.03 else rng.uniform(50, 99) if high else rng.uniform(0, 49)))
    return rows


def plain(rows, limit, hold, step=60, lookback=300):
    """Each series evaluated step by step."""
    out, last = [], max((r[1] - at(0)).total_seconds() for r in rows)
    for name in sorted({r[0] for r in rows}):
        own = sorted(((r[1] - at(0)).total_seconds(), r[2]) for r in rows if r[0] == name)
        since, now = None, 0
        while now <= last + 10 * lookback:
            seen = [s for s in own if now - lookback < s[0] <= now]
            if seen and not seen[-1][1] <= limit:
                since = now if since is None else since
            elif since is not None:
                fired = since + hold < now
                out.append((name, at(since), at(since + hold) if fired else None, at(now), "resolved" if fired else "cancelled", "ok" if seen else "no data"))
                since = None
            now += step
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, width", [(1, 86_400), (2, 600), (3, 3600)])
def test_batch_intervals_match_a_walk(spark, seed, width):
    rows = made(seed)
    found = rows_of(monitoring.alert_intervals(spark.createDataFrame(rows, SCHEMA), ["name"], 49.5, 180, width=width))
    want = plain(rows, 49.5, 180)
    assert found == want
    # A value counts for longer than the rule waits, so without data an alert has fired.
    assert {r[4:] for r in want} == {("resolved", "ok"), ("resolved", "no data"), ("cancelled", "ok")}


def test_stream_gives_the_intervals_of_the_batch(spark, tmp_path):
    """Rows come in four parts; the stream is stopped after each and started again."""
    alerts.use_state_store(spark)
    rows = sorted(made(4, 120), key=lambda r: r[1])
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "kept"))
    parts = [rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4] for k in range(4)]
    random.Random(0).shuffle(parts[1])
    # A last sample far ahead lets the watermark pass all evaluations.
    parts.append([("end", at(10**6), 0.0)])
    for part in parts:
        spark.createDataFrame(part, SCHEMA).selectExpr("name", "cast(time as timestamp) as time", "value").coalesce(1).write.mode("append").parquet(source)
        stream = alerts.stream_alerts(spark.readStream.schema("name string, time timestamp, value double").parquet(source), ["name"], 49.5, 180)
        run = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        run.awaitTermination()
    want = rows_of(monitoring.alert_intervals(spark.createDataFrame(rows, SCHEMA), ["name"], 49.5, 180))
    assert len(want) > 20 and rows_of(spark.read.parquet(out)) == want


def test_rates_match_a_search(spark):
    """The extrapolated rate at each step, from the samples of its window alone."""
    rng = random.Random(9)
    rows, value = [], 0.0
    for k in range(200):
        value = rng.uniform(0, 3) if rng.random() < 0.05 else value + rng.uniform(0, 9)
        rows.append(("a", at(sum((15, 15, 40, 700)[(k * j) % 4] for j in range(3)) + 97 * k), value))
    rows = list({r[1]: r for r in rows}.values())
    own = sorted(((r[1] - at(0)).total_seconds(), r[2]) for r in rows)
    want = {}
    for now in range(0, 40_000, 60):
        seen = [s for s in own if now - 300 < s[0] <= now]
        if len(seen) < 2:
            continue
        grown = seen[-1][1] - seen[0][1] + sum(a[1] for a, b in zip(seen, seen[1:]) if b[1] < a[1])
        length = seen[-1][0] - seen[0][0]
        mean = length / (len(seen) - 1)
        ahead, behind = seen[0][0] - (now - 300), now - seen[-1][0]
        ahead = ahead if ahead < 1.1 * mean else mean / 2
        if grown > 0:
            ahead = min(ahead, length * seen[0][1] / grown)
        want[at(now)] = grown * (length + ahead + (behind if behind < 1.1 * mean else mean / 2)) / length / 300
    for width in (86_400, 500):
        got = {r["step"]: r["rate"] for r in monitoring.rate_range(spark.createDataFrame(rows, SCHEMA), ["name"], 60, 300, width=width).collect()}
        assert len(want) > 100 and got.keys() == want.keys() and all(got[t] == pytest.approx(v, rel=1e-9) for t, v in want.items())


def test_instants_within_a_range(spark):
    rows = [("a", at(10), 1.0), ("a", at(10), 2.0), ("a", at(130), 3.0), ("b", at(60), 4.0), ("b", at(61), None)]
    ties = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", k int")
    got = monitoring.instant_range(ties, ["name"], 60, lookback=120, start="2024-01-01 00:01:00", end="2024-01-01 00:03:00", tie="k")
    assert rows_of(got) == sorted([("a", at(60), 2.0), ("a", at(120), 2.0), ("a", at(180), 3.0), ("b", at(60), 4.0), ("b", at(120), None), ("b", at(180), None)], key=str)
    assert monitoring.rate_range(ties.where("1 = 0"), ["name"], 60, 300).isEmpty() and monitoring.alert_intervals(ties.where("1 = 0"), ["name"], 1, 60).isEmpty()
