"""Threshold policies against plain arrays."""

import random
from math import inf

import numpy as np
import pytest
from pyspark.sql import functions as F

from farepanel.operators import policy


def metrics(now, later, wait, friction):
    best = np.minimum(now, later + friction)
    regret = np.where(wait, later + friction, now) - best
    p95 = np.quantile(regret, 0.95)
    return len(now), regret.mean(), wait.mean(), 1 - regret.sum() / max((now - best).sum(), 1.0), p95, regret[regret >= p95].mean()


@pytest.mark.parametrize("seed", [1, 2])
def test_all_policies_from_one_histogram(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice([0.0, 0.25, 0.5, 0.5, 0.75, 1.0, rng.random()]), rng.randint(1, 9) * 1000, rng.randint(1, 9) * 1000) for _ in range(500)]
    rows += [("hot", 0.5, 5000, 4000)] * 300 + [("single", 0.1, 100, 900)]
    df = spark.createDataFrame(rows, "g string, p_drop double, price_vnd long, target_price_vnd long").repartition(6)
    thresholds, frictions = [0.25, inf, 0.5, -inf, 0.9], [0, 1500]
    got = policy.threshold_policies(df, thresholds, frictions, ["g"]).collect()
    assert len(got) == 4 * len(thresholds) * len(frictions)
    for r in got:
        part = [x for x in rows if x[0] == r.g]
        p, now, later = (np.array([x[i] for x in part], float) for i in (1, 2, 3))
        expected = metrics(now, later, p >= r.threshold, r.friction_vnd)
        assert (r.rows, r.mean_regret_vnd, r.wait_rate, r.oracle_savings_capture, r.p95_regret_vnd, r.cvar95_regret_vnd) == pytest.approx(expected)
    single = policy.policy_metrics(policy.with_regret(df, F.col("p_drop") >= 0.5, 1500.0), ["g"], 1500.0).collect()
    table = {(r.g, r.threshold, r.friction_vnd): r for r in got}
    for r in single:
        other = table[r.g, 0.5, 1500.0]
        assert [r[c] for c in r.asDict() if c != "g"] == pytest.approx([other[c] for c in r.asDict() if c != "g"])


def test_rows_are_not_fanned_out_by_threshold(spark):
    df = spark.createDataFrame([("a", 0.5, 5, 4)], "g string, p_drop double, price_vnd long, target_price_vnd long")
    spread = policy.threshold_policies(df, [i / 20 for i in range(20)], [10], ["g"])
    plan = spread._jdf.queryExecution().optimizedPlan().toString()
    entries = [line for line in plan.splitlines() if "Generate inline" in line and "friction_vnd" in line and "regret" in line and "__waits" in line]
    assert entries and all(line.count("__waits, true") == 1 and line.count("__waits, false") == 1 for line in entries)
    assert "explode" not in plan


def test_null_scores_and_an_empty_table(spark):
    schema = "g string, p_drop double, price_vnd long, target_price_vnd long"
    rows = policy.threshold_policies(spark.createDataFrame([("a", None, 500, 400)], schema), [-inf, 0.5], [0], ["g"]).collect()
    assert {r.threshold: (r.wait_rate, r.mean_regret_vnd) for r in rows} == {-inf: (1.0, 0.0), 0.5: (0.0, 100.0)}
    assert policy.threshold_policies(spark.createDataFrame([], schema), [0.5], [0], ["g"]).collect() == []


def plain_safety(rows, points=20, min_actual=500):
    """(buy_below, wait_from) of the rows by trying all pairs, or None."""
    best = None
    p, y, now, later = (np.array(c, float) for c in zip(*rows))
    for a in range(points + 1):
        for b in range(a, points + 1):
            buy, wait = p < a / points, p >= b / points
            drops, unsafe = y.sum(), y[buy].sum()
            if not buy.any() or not drops:
                continue
            n, share, z = buy.sum(), y[buy].mean(), 1.959963984540054
            upper = (share + z * z / (2 * n) + z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if upper > 0.15 or n / len(p) < 0.2 or (drops - unsafe) / drops < 0.75 or (n + wait.sum()) / len(p) < 0.6:
                continue
            cost = np.where(buy, 2 * np.maximum(now - later, 0), np.maximum(later - now, 0) + 50_000).mean()
            shown = ~buy
            f1 = [2 * (t & s).sum() / max(t.sum() + s.sum(), 1) for t, s in ((y == 1, shown), (y == 0, buy))]
            key = (round(cost, 6), -round(sum(f1), 9), a / points, b / points)
            best = min(best, key) if best else key
    return best and best[2:]


def test_safety_thresholds_per_horizon_with_fallback(spark):
    rng = random.Random(9)

    def outcome(dud, good):
        y = int(rng.random() < 0.5)
        p = min(max(rng.gauss(0.75 if y else 0.25, 0.12 if good else 0.6), 0.0), 0.999)
        return dud, p, y, 1_000_000, 800_000 if y else 1_000_000 + rng.randint(0, 90_000)

    rows = [outcome(1, True) for _ in range(1500)] + [outcome(2, True) for _ in range(300)] + [outcome(3, False) for _ in range(1500)]
    df = spark.createDataFrame(rows, "days_until_departure int, p double, y int, price_vnd long, target_price_vnd long").repartition(5)
    table = {r.days_until_departure: r for r in policy.safety_thresholds(df, "y", "p").collect()}
    pooled = plain_safety([r[1:] for r in rows])
    for dud in (1, 2, 3):
        part = [r[1:] for r in rows if r[0] == dud]
        own = plain_safety(part) if min(sum(r[1] for r in part), sum(1 - r[1] for r in part)) >= 500 else None
        r = table[dud]
        assert r.threshold_source == ("OWN" if own else "GLOBAL" if pooled else "NONE")
        expected = own or pooled
        assert (r.buy_below, r.wait_from) == (pytest.approx(expected) if expected else (None, None))
    assert table[1].threshold_source == "OWN" and table[2].threshold_source != "OWN"
    done = policy.with_actions(df, policy.safety_thresholds(df, "y", "p"), "p")
    for r in done.collect():
        t = table[r.days_until_departure]
        assert r.action == ("WAIT" if t.buy_below is None or r.p >= t.wait_from else "BUY" if r.p < t.buy_below else "UNCERTAIN")


def test_no_safe_pair_never_buys(spark):
    df = spark.createDataFrame([(1, 0.1, 1, 100, 50), (1, 0.9, 0, 100, 150)], "days_until_departure int, p double, y int, price_vnd long, target_price_vnd long")
    table = policy.safety_thresholds(df, "y", "p")
    assert [(r.threshold_source, r.buy_below) for r in table.collect()] == [("NONE", None)]
    assert {r.action for r in policy.with_actions(df, table, "p").collect()} == {"WAIT"}
