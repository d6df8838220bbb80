"""Buy-or-wait decisions: regret, thresholds, friction stress and safety bounds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.metrics import with_rates
from farepanel.operators.scale import join_on, running_totals, with_scalars
from farepanel.session import materialise


def with_regret(df: DataFrame, wait: Column, friction: Column | float = C.FRICTION_VND, p_now: str = "price_vnd", p_later: str = "target_price_vnd") -> DataFrame:
    return df.withColumn("wait", wait).withColumn("regret", K.policy_regret(p_now, p_later, F.col("wait"), friction))


def _of_histogram(hist: DataFrame, keys: Sequence[str], labels: Sequence[Column]) -> DataFrame:
    """Policy metrics from one row per (keys, regret): for policy i the rows ``n<i>`` and those of them that wait
    ``w<i>``; ``saving`` is what the best actions save over buying. One pass of running totals serves mean, percentile
    and tail of all policies."""
    n = range(len(labels))
    hist = hist.withColumns({f"s{i}": F.col("regret") * F.col(f"n{i}") for i in n})
    totals = running_totals(hist, keys, "regret", [f"{m}{i}" for i in n for m in "ns"])

    def at(i: int, rank: Column) -> Column:
        before = F.col(f"n{i}_before")
        here = F.struct("regret", before.alias("n"), F.col(f"s{i}_before").alias("s"))
        return F.max(F.when((before <= rank) & (rank < before + F.col(f"n{i}")), here))

    place = lambda i: (F.col(f"n{i}_total") - 1) * F.lit(0.95)
    grouped = totals.groupBy(*keys).agg(
        F.sum("saving").alias("__saving"),
        *[F.sum(f"w{i}").alias(f"w{i}") for i in n],
        *[F.max(f"{m}{i}_total").alias(f"{m}{i}") for i in n for m in "ns"],
        *[at(i, F.floor(place(i))).alias(f"lo{i}") for i in n],
        *[at(i, F.ceil(place(i))).alias(f"hi{i}") for i in n],
    )

    def row(i: int) -> Column:
        rows, total, lo, hi = (F.col(f"{c}{i}") for c in ("n", "s", "lo", "hi"))
        position = (rows - 1) * F.lit(0.95)
        p95 = lo["regret"] + (hi["regret"] - lo["regret"]) * (position - F.floor(position))
        start = F.when(p95 == lo["regret"], lo).otherwise(hi)
        return F.struct(
            labels[i].alias("threshold"),
            rows.alias("rows"),
            (total / rows).alias("mean_regret_vnd"),
            (F.col(f"w{i}") / rows).alias("wait_rate"),
            (F.lit(1.0) - total / F.greatest("__saving", F.lit(1.0))).alias("oracle_savings_capture"),
            p95.alias("p95_regret_vnd"),
            ((total - start["s"]) / (rows - start["n"])).alias("cvar95_regret_vnd"),
        )

    return grouped.select(*keys, F.inline(F.array(*[row(i) for i in n])))


def policy_metrics(df: DataFrame, by: Sequence[str] = (), friction: Column | float = C.FRICTION_VND) -> DataFrame:
    """Mean, p95 and CVaR95 of regret, wait rate and savings capture; needs ``wait`` and ``regret``.

    Everything comes from one histogram of regrets: rows are shuffled once.
    """
    by = list(by)
    friction = friction if isinstance(friction, Column) else F.lit(float(friction))
    later = F.col("target_price_vnd") + friction
    saving = F.greatest(F.col("price_vnd") - F.least(F.col("price_vnd"), later), F.lit(0.0))
    hist = df.where(F.col("regret").isNotNull()).groupBy(*by, "regret").agg(
        F.count(F.lit(1)).alias("n0"), F.sum(F.col("wait").cast("bigint")).alias("w0"), F.sum(saving).alias("saving")
    )
    return _of_histogram(hist, by, [F.lit(None).cast("double")]).drop("threshold")


def threshold_policies(
    df: DataFrame,
    thresholds: Sequence[float],
    frictions: Sequence[float],
    by: Sequence[str],
    p: str = "p_drop",
    p_now: str = "price_vnd",
    p_later: str = "target_price_vnd",
) -> DataFrame:
    """Policy metrics of every (group, friction, threshold): wait where the score reaches the threshold.

    As a function of the threshold a row's regret takes two values, and one of them is zero. So one histogram of
    regrets, with a count per threshold, holds all policies; its running totals give means, percentiles and tails of all
    thresholds together. Rows become two entries per friction, whatever the number of thresholds, and zeros combine
    before the shuffle. The threshold -inf always waits, +inf never does; a null score waits at -inf only.
    """
    by, levels = list(by), sorted(float(t) for t in thresholds)
    keys = [*by, "friction_vnd"]
    reached = reduce(lambda a, b: a + b, [F.coalesce(F.col(p) >= t, F.lit(t == -inf)).cast("int") for t in levels])
    change = F.col(p_later).cast("double") - F.col(p_now)
    action = lambda f, gap, waits: F.struct(F.lit(float(f)).alias("friction_vnd"), F.greatest(gap, F.lit(0.0)).alias("regret"), F.lit(waits).alias("__waits"))
    actions = [a for f in frictions for a in (action(f, change + float(f), True), action(f, -(change + float(f)), False))]
    entries = df.select(*by, reached.alias("__k"), F.inline(F.array(*actions)))
    k, waits, n = F.col("__k"), F.col("__waits"), range(len(levels))
    one = lambda condition: F.sum(condition.cast("bigint"))
    hist = entries.where(F.col("regret").isNotNull()).groupBy(*keys, "regret").agg(
        *[one(waits == (k > i)).alias(f"n{i}") for i in n],
        *[one(waits & (k > i)).alias(f"w{i}") for i in n],
        (F.col("regret") * one(~waits)).alias("saving"),  # buying always loses just what the best action would save
    )
    return _of_histogram(hist, keys, [F.lit(t) for t in levels])


def tournament(df: DataFrame, thresholds: Sequence[float] = C.THRESHOLDS, p: str = "p_drop", fold: str = "fold", friction: float = C.FRICTION_VND) -> DataFrame:
    """Selection score of every threshold over the screen folds."""
    folds = threshold_policies(df, thresholds, [friction], [fold], p)
    return folds.groupBy("threshold").agg(
        F.avg("mean_regret_vnd").alias("screen_mean_regret_vnd"),
        F.avg("cvar95_regret_vnd").alias("screen_cvar95_regret_vnd"),
        F.max("mean_regret_vnd").alias("screen_worst_fold_regret_vnd"),
    ).withColumn(
        "selection_score",
        F.col("screen_mean_regret_vnd")
        + F.lit(0.20) * F.col("screen_cvar95_regret_vnd")
        + F.lit(0.10) * F.col("screen_worst_fold_regret_vnd"),
    )


def best_threshold(table: DataFrame) -> DataFrame:
    """Lowest score, then the threshold nearest to one half."""
    order = F.struct(F.col("selection_score"), F.abs(F.col("threshold") - 0.5), F.col("threshold"))
    return table.agg(F.min_by("threshold", order).alias("threshold"))


def stress(df: DataFrame, threshold: float, frictions: Sequence[int] = C.FRICTIONS_VND, p: str = "p_drop", fold_set: str = "fold_set") -> DataFrame:
    """The frozen policy, buying all and waiting for all, against frictions, per fold set."""
    out = threshold_policies(df, [-inf, threshold, inf], frictions, [fold_set], p)
    policy = F.when(F.col("threshold") == -inf, "WAIT_ALL").when(F.col("threshold") == inf, "BUY_ALL").otherwise("FROZEN")
    return out.withColumn("policy", policy).drop("threshold")


def tune_threshold(df: DataFrame, y: str, p: str, drop_floor: float = 0.5, keep_floor: float = 0.5, points: int = 197) -> DataFrame:
    """Cheapest grid threshold that keeps both recalls above their floors, else the best minimum recall.

    Every row falls into one grid step; costs and counts are running totals over at most points + 1 steps.
    """
    price, later, zero = F.col("price_vnd").cast("double"), F.col("target_price_vnd").cast("double"), F.lit(0.0)
    buy = F.lit(C.UNSAFE_BUY_WEIGHT) * F.greatest(price - later, zero)
    wait = F.greatest(later - price, zero) + F.lit(float(C.FRICTION_VND))
    step = 0.98 / (points - 1)
    # first grid index whose threshold exceeds the score: the row waits at every smaller index
    guess = F.floor((F.col(p) - 0.01) / step).cast("int")
    grid = lambda i: F.lit(0.01) + i * F.lit(step)
    exact = (
        F.when(grid(guess + 1) <= F.col(p), guess + 2).when(grid(guess) <= F.col(p), guess + 1).otherwise(guess)
    )
    index = F.greatest(F.least(exact, F.lit(points)), F.lit(0))
    cells = df.groupBy(index.alias("first_buy")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(y) == 1).cast("bigint")).alias("pos"),
        F.sum(buy).alias("buy_cost"),
        F.sum(wait).alias("wait_cost"),
    )
    # at most points + 1 rows from here on
    steps = df.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("i"))
    w = Window.partitionBy(F.lit(0))
    measures = ("n", "pos", "buy_cost", "wait_cost")
    table = steps.join(cells, F.col("i") == F.col("first_buy"), "left").select(
        "i",
        *[F.sum(F.coalesce(F.col(m), F.lit(0))).over(w.orderBy("i")).alias(f"{m}_buy") for m in measures],
        *[F.sum(F.coalesce(F.col(m), F.lit(0))).over(w).alias(f"{m}_all") for m in measures],
    ).where(F.col("i") < points)
    c = F.col
    table = table.select(
        "i",
        c("n_all").alias("rows"),
        (c("pos_all") - c("pos_buy")).alias("tp"),
        (c("n_all") - c("pos_all") - (c("n_buy") - c("pos_buy"))).alias("fp"),
        c("pos_buy").alias("fn"),
        (c("n_buy") - c("pos_buy")).alias("tn"),
        ((c("wait_cost_all") - c("wait_cost_buy") + c("buy_cost_buy")) / c("n_all")).alias("mean_vnd_cost"),
    )
    table = with_rates(table).withColumn("threshold", grid(F.col("i"))).withColumn(
        "min_class_recall", F.least("drop_recall", "no_drop_recall")
    )
    passed = (F.col("drop_recall") >= drop_floor) & (F.col("no_drop_recall") >= keep_floor)
    centre = F.abs(F.col("threshold") - 0.5)
    key = F.when(
        passed, F.struct(F.lit(0).alias("a"), F.col("mean_vnd_cost").alias("b"), (-F.col("min_class_recall")).alias("c"), centre.alias("d"))
    ).otherwise(
        F.struct(F.lit(1).alias("a"), (-F.col("min_class_recall")).alias("b"), F.col("mean_vnd_cost").alias("c"), centre.alias("d"))
    )
    fields = ["threshold", "mean_vnd_cost", "min_class_recall", "drop_recall", "no_drop_recall"]
    return table.agg(
        F.min_by(F.struct(*fields, passed.alias("tuning_feasible")), key).alias("best")
    ).select("best.*")


def wilson_safety(df: DataFrame, by: Sequence[str] = (), z: float = 1.959963984540054, y: str = "drop_5pct", max_unsafe: float = 0.15, min_buys: float = 0.20, min_recall: float = 0.75) -> DataFrame:
    """Unsafe-buy share with its Wilson upper bound, and whether bound, buy coverage and recall of waits pass.

    Every row is either a buy or a wait, so the share of rows with an action is one.
    """
    buy = ~F.col("wait")
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(buy).alias("buys"),
        F.count_if(buy & (F.col(y) == 1)).alias("unsafe_buys"),
        F.count_if(F.col(y) == 1).alias("__drops"),
    )
    n, share = F.col("buys").cast("double"), F.try_divide(F.col("unsafe_buys").cast("double"), F.col("buys"))
    centre = share + z * z / (2 * n)
    margin = F.lit(z) * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return out.withColumns(
        {
            "unsafe_rate": share,
            "wilson_upper": F.when(n > 0, (centre + margin) / (1 + z * z / n)),
            "buy_coverage": n / F.col("rows"),
            "wait_recall": F.try_divide((F.col("__drops") - F.col("unsafe_buys")).cast("double"), F.col("__drops")),
        }
    ).withColumn(
        "safe",
        F.coalesce(
            (F.col("wilson_upper") <= max_unsafe) & (F.col("buy_coverage") >= min_buys) & (F.col("wait_recall") >= min_recall),
            F.lit(False),
        ),
    ).drop("__drops")


def wilson_upper(events: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """Upper end of the Wilson interval of a share; null without trials."""
    n = trials.cast("double")
    share = F.try_divide(events.cast("double"), n)
    centre = share + z * z / (2 * n)
    margin = F.lit(z) * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.when(n > 0, (centre + margin) / (1 + z * z / n))


SAFETY = {"wilson_upper": 0.15, "buy_coverage": 0.20, "wait_recall": 0.75, "action_coverage": 0.60}  # fixed values


def safety_thresholds(
    df: DataFrame, y: str, p: str, group: str = "days_until_departure", points: int = 20, min_actual: int = 500, weight: float = C.UNSAFE_BUY_WEIGHT,
    friction: float = C.FRICTION_VND,
) -> DataFrame:
    """Two thresholds per horizon: buy below ``buy_below``, wait from ``wait_from``, uncertain (shown as waiting) between.

    Of the pairs on a grid that pass all safety floors the cheapest by asymmetric cost is taken, then the one with the
    larger macro F1, then the lower pair. A horizon has its own pair only with ``min_actual`` rows of both outcomes;
    otherwise, and if none passes, the pooled pair serves it; if that fails too, nothing is ever bought
    (``threshold_source`` NONE). Rows are read once, into counts per (horizon, grid cell).
    """
    now, later, zero = F.col("price_vnd").cast("double"), F.col("target_price_vnd").cast("double"), F.lit(0.0)
    cell = F.least(F.greatest(F.floor(F.col(p) * points).cast("int"), F.lit(0)), F.lit(points - 1))
    cells = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).alias("g"), cell.alias("c")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(y) == 1).cast("bigint")).alias("pos"),
        F.sum(F.lit(float(weight)) * F.greatest(now - later, zero)).alias("buy"),
        F.sum(F.greatest(later - now, zero) + float(friction)).alias("wait"),
    )
    cells = materialise(cells, "safety")  # horizons x grid from here on
    measures = ("n", "pos", "buy", "wait")
    pooled = cells.groupBy("c").agg(*[F.sum(m).alias(m) for m in measures])
    both = cells.withColumn("own", F.lit(True)).unionByName(
        pooled.select(F.lit(None).cast(cells.schema["g"].dataType).alias("g"), "c", *measures, F.lit(False).alias("own"))
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(points + 1) for b in range(a, points + 1)]))
    below, above = F.col("c") < F.col("a"), F.col("c") >= F.col("b")
    part = lambda m, where: F.sum(F.when(where, F.col(m)).otherwise(0))
    table = both.withColumn("x", pairs).select("*", "x.*").groupBy("g", "own", "a", "b").agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("drops"), part("n", below).alias("buys"), part("pos", below).alias("unsafe"),
        part("n", above).alias("waits"), (part("buy", below) + part("wait", ~below)).alias("cost"),
    )
    c = F.col
    f1 = lambda hit, miss, false: F.coalesce(F.try_divide(2.0 * hit, 2 * hit + miss + false), zero)
    caught, safe = c("drops") - c("unsafe"), c("buys") - c("unsafe")
    table = table.select(
        "g", "own", (c("a") / F.lit(points)).alias("buy_below"), (c("b") / F.lit(points)).alias("wait_from"),
        (c("cost") / c("rows")).alias("mean_vnd_cost"),
        ((f1(caught, c("unsafe"), c("rows") - c("buys") - caught) + f1(safe, c("rows") - c("drops") - safe, c("unsafe"))) / 2).alias("macro_f1"),
        wilson_upper(c("unsafe"), c("buys")).alias("wilson_upper"), (c("buys") / c("rows")).alias("buy_coverage"),
        F.try_divide(caught.cast("double"), c("drops")).alias("wait_recall"), ((c("buys") + c("waits")) / c("rows")).alias("action_coverage"),
        (F.least(c("drops"), c("rows") - c("drops")) >= min_actual).alias("supported"),
    )
    floors = reduce(lambda a, b: a & b, [c(n) <= v if n == "wilson_upper" else c(n) >= v for n, v in SAFETY.items()])
    order = F.struct("mean_vnd_cost", (-c("macro_f1")).alias("f"), "buy_below", "wait_from")
    names = ["buy_below", "wait_from", "mean_vnd_cost", "macro_f1", *SAFETY]
    best = table.where(floors & (c("supported") | ~c("own"))).groupBy("g", "own").agg(F.min_by(F.struct(*names), order).alias("best"))
    groups = cells.select("g").distinct()
    own = join_on(groups, best.where("own").select("g", "best"), ["g"], "left")
    whole = best.where("NOT own").agg(F.first("best").alias("pooled"))
    out = with_scalars(own, whole)
    source = F.when(c("best").isNotNull(), "OWN").when(c("pooled").isNotNull(), "GLOBAL").otherwise("NONE")
    return out.withColumn("x", F.coalesce("best", "pooled")).select(c("g").alias(group), source.alias("threshold_source"), *[c(f"x.{n}").alias(n) for n in names])


def with_actions(df: DataFrame, table: DataFrame, p: str, group: str = "days_until_departure", name: str = "action") -> DataFrame:
    """BUY, UNCERTAIN or WAIT by the thresholds of a row's horizon; a horizon without any, and a null score, wait."""
    found = join_on(df, table.select(group, "threshold_source", F.col("buy_below").alias("__a"), F.col("wait_from").alias("__b")), [group], "left")
    action = F.when(F.col(p) < F.col("__a"), "BUY").when(F.col(p) < F.col("__b"), "UNCERTAIN").otherwise("WAIT")
    return found.withColumn(name, action).drop("__a", "__b")
