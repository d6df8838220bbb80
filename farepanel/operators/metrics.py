"""Scores for probabilities, points, quantiles and rankings, and block bootstraps.

Rank-based scores work on the histogram of distinct scores, so no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.scale import (
    average_rank, exact_quantiles, histogram, join_on, ranks, running_totals, with_scalars,
)
from farepanel.session import materialise

EPS = 1e-7


def clip_probability(p: str, eps: float = EPS) -> Column:
    return F.greatest(F.least(F.col(p).cast("double"), F.lit(1.0 - eps)), F.lit(eps))


def log_loss(y: str, p: Column) -> Column:
    return -F.when(F.col(y) == 1, F.ln(p)).otherwise(F.log1p(-p))


def score_histogram(df: DataFrame, y: str, p: str, by: Sequence[str], eps: float = EPS) -> DataFrame:
    """Positives and negatives below and at every distinct score."""
    work = df.withColumn("score", clip_probability(p, eps))
    hist = histogram(work, by, "score", pos=(F.col(y) == 1).cast("bigint"), neg=(F.col(y) == 0).cast("bigint"))
    return running_totals(hist, by, "score", ["pos", "neg"])


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs ordered right, ties half; 0.5 when a class is absent."""
    hist = score_histogram(df, y, p, by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    area = F.try_divide(wins, F.max("pos_total").cast("double") * F.max("neg_total"))
    return hist.groupBy(*by).agg(F.coalesce(area, F.lit(0.5)).alias("auc"))


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """Step area under the precision-recall curve, scores taken from the top."""
    hist = score_histogram(df, y, p, by, eps)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    step = F.col("pos") / F.col("pos_total") * (tp / (tp + fp))
    return hist.where(F.col("pos_total") > 0).groupBy(*by).agg(F.sum(step).alias("pr_auc"))


def roc_pr_curves(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One curve point per distinct score."""
    hist = score_histogram(df, y, p, by)
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return hist.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(tp.cast("double"), F.col("pos_total")).alias("tpr"),
        F.try_divide(fp.cast("double"), F.col("neg_total")).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
    )


def ece(df: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 15) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    prob = clip_probability(p)
    binned = df.withColumn("__p", prob).withColumn("__bin", F.least(F.floor(F.col("__p") * bins), F.lit(bins - 1)))
    cells = binned.groupBy(*by, "__bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"), F.avg("__p").alias("mean")
    )
    gap = F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean"))) / F.sum("n")
    return cells.groupBy(*by).agg(gap.alias(f"ece{bins}"))


def classification_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Log loss, Brier, ECE, AUC and their proper score per group."""
    by, prob = list(by), clip_probability(p)
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(log_loss(y, prob)).alias("log_loss"),
        F.avg(F.pow(prob - F.col(y), 2)).alias("brier"),
    )
    out = join_on(join_on(base, ece(df, y, p, by), by), roc_auc(df, y, p, by), by)
    return out.withColumn("proper_score", F.col("log_loss") + F.col("brier"))


def point_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors of a point forecast, both sides floored at one; R2 from squared-error sums."""
    by, one = list(by), F.lit(1.0)
    t, q = F.greatest(F.col(y).cast("double"), one), F.greatest(F.col(yhat).cast("double"), one)
    work = df.select(*by, t.alias("__t"), (q - t).alias("__e"), (F.abs(q - t) / t).alias("__ape"))
    error = F.col("__e")
    base = work.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg("__ape").alias("mape"),
        F.avg(error).alias("bias"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop("__t") * F.count(F.lit(1)))).alias("r2"),
    )
    return join_on(base, exact_quantiles(work, by, "__ape", {"median_ape": 0.5}), by)


def distribution_metrics(df: DataFrame, y: str, quantiles: str, by: Sequence[str] = ()) -> DataFrame:
    """WIS, coverage, widths, tails and the crossing rate of the raw quantiles."""
    work = df.withColumn("__q", K.rearrange(quantiles))
    q, t = [F.col("__q")[i] for i in range(7)], F.col(y)
    share = lambda condition: F.avg(condition.cast("double"))
    loss = K.pinball_mean(y, "__q")
    return work.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.lit(2.0) * F.avg(loss)).alias("wis"),
        F.avg(loss).alias("pinball_mean"),
        share((t >= q[2]) & (t <= q[4])).alias("coverage50"),
        share((t >= q[1]) & (t <= q[5])).alias("coverage80"),
        share((t >= q[0]) & (t <= q[6])).alias("coverage90"),
        F.avg(q[4] - q[2]).alias("width50"),
        F.avg(q[5] - q[1]).alias("width80"),
        F.avg(q[6] - q[0]).alias("width90"),
        share(t < q[0]).alias("lower_tail90"),
        share(t > q[6]).alias("upper_tail90"),
        F.avg(K.crossing(quantiles).cast("double")).alias("crossing_rate"),
    )


# --- ranking --------------------------------------------------------------------------------


def ndcg(
    df: DataFrame, score: str, price: str, query: str = "query_id", tie: str = "offer_id", k: int = 5, variants: Sequence[str] = (), rows: DataFrame | None = None
) -> DataFrame:
    """NDCG at k per query, relevance = n - averaged price rank + 1, gain 2^relevance - 1.

    Gains are scaled by 2^-n inside the ratio, so long queries do not overflow. Equal scores keep identity order. Prices
    are ranked over their distinct values, which also give the ideal order, since equal prices have equal gains. Only the
    first k rows per query by score survive the pre-shuffle rank filter, and only these look up their gain. With
    ``variants`` the same rows appear once per value of these columns, with other scores; ``rows`` has them once.
    """
    ranked = ranks(df if rows is None else rows, [query], price, "__").where(F.col("__n") >= 2)
    relevance = F.col("__n") - average_rank("__") + 1
    gains = ranked.withColumn("__gain", F.pow(F.lit(2.0), relevance - F.col("__n")) - F.pow(F.lit(2.0), -F.col("__n")))
    places = F.sequence(F.col("__before") + 1, F.least(F.col("__before") + F.col("__ties"), F.lit(k)))
    share = F.aggregate(places, F.lit(0.0), lambda total, r: total + 1 / F.log2(r + 1.0))
    best = gains.where(F.col("__before") < k).groupBy(query).agg(F.sum(F.col("__gain") * share).alias("__ideal"))
    position = F.row_number().over(Window.partitionBy(*variants, query).orderBy(F.col(score).desc(), F.col(tie)))
    top = df.where(F.col(price).isNotNull()).select(*variants, query, score, price, tie).withColumn("__r", position).where(F.col("__r") <= k)
    got = top.select(*variants, query, price, "__r").join(gains.select(query, price, "__gain"), [query, price])
    got = got.groupBy(*variants, query).agg(F.sum(F.col("__gain") / F.log2(F.col("__r") + 1.0)).alias("__dcg"))
    return got.join(best, query).select(*variants, query, F.coalesce(F.try_divide("__dcg", "__ideal"), F.lit(0.0)).alias(f"ndcg{k}"))


def concordance(
    df: DataFrame, score: str, price: str, query: str = "query_id", empty: float | None = 0.5
) -> DataFrame:
    """Share of pairs with different prices whose cheaper row scores strictly higher, per query.

    No pair is ever formed. Distinct scores are numbered; two different numbers first differ at exactly one
    hexadecimal digit, and at that digit the pair is counted from running totals over price inside the rows that share
    the higher digits. Work is rows times the hexadecimal digits of the number of distinct scores; prefixes with a
    single score are left out. ``empty`` is the value of a query without informative pairs; None leaves such queries out.
    """
    cells = df.where(F.col(score).isNotNull()).groupBy(query, score, price).agg(F.count(F.lit(1)).alias("__c"))
    cells = materialise(cells, "cells")  # read three times
    scores = cells.select(query, score).distinct().withColumn("one", F.lit(1))
    scores = running_totals(scores, [query], score, ["one"]).select(query, score, F.col("one_before").alias("__code"), F.col("one_total").alias("__codes"))
    rows = join_on(cells, scores, [query, score])
    # one row per distinct (query, score, price) from here on
    level = F.explode(F.sequence(F.lit(0), F.floor((F.length(F.bin(F.col("__codes") - 1)) - 1) / 4).cast("int")))
    long = rows.where((F.col("__codes") >= 2) & F.col(price).isNotNull()).select(query, price, "__c", "__code", "__codes", level.alias("__level"))
    long = long.select(
        query, price, "__c", "__level", "__codes",
        F.expr("shiftright(__code, 4 * (__level + 1))").alias("__prefix"),
        F.expr("shiftright(__code, 4 * __level) & 15").cast("int").alias("__digit"),
    ).where(F.expr("__codes - shiftleft(__prefix, 4 * (__level + 1)) >= 2")).drop("__codes")
    long = histogram(long, [query, "__level", "__prefix", "__digit"], price, __c=F.col("__c"))  # at most 16 rows a price
    # in the order of (price, digit) larger digits come earlier at strictly smaller prices only
    above = {f"d{d}": F.when(F.col("__digit") >= d, F.col("__c")).otherwise(0) for d in range(1, 16)}
    totals = running_totals(long, [query, "__level", "__prefix"], price, above, ["__digit"])
    # a cheaper row (smaller price) with the larger digit has the higher score
    cheaper = F.coalesce(F.get(F.array(*[F.col(f"d{d}_before") for d in range(1, 16)]), F.col("__digit")), F.lit(0))
    right = totals.groupBy(query).agg(F.sum(F.col("__c") * cheaper).alias("__right"))
    sizes = histogram(cells, [query], price, n=F.col("__c")).groupBy(query).agg(
        F.sum("n").alias("__n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("__tied")
    ).where(F.col("__n") >= 2)
    pairs = F.col("__n") * (F.col("__n") - 1) / 2 - F.col("__tied")
    out = sizes.join(right, query, "left").select(
        query, pairs.alias("informative_pairs"), F.try_divide(F.coalesce("__right", F.lit(0)).cast("double"), pairs).alias("concordance")
    )
    if empty is None:
        return out.where(F.col("informative_pairs") > 0)
    return out.withColumn("concordance", F.coalesce("concordance", F.lit(float(empty))))


def ranking_metrics(df: DataFrame, score: str, price: str, query: str = "query_id") -> DataFrame:
    per_query = ndcg(df, score, price, query).join(concordance(df, score, price, query), query)
    return per_query.agg(
        F.avg("ndcg5").alias("ndcg5"),
        F.avg("concordance").alias("pairwise_concordance"),
        F.count(F.lit(1)).alias("queries"),
    )


# --- thresholds and bins --------------------------------------------------------------------


def confusion(df: DataFrame, y: str, p: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts at a threshold and the rates that follow from them."""
    hit, positive = F.col(p) >= threshold, F.col(y) == 1
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & positive).alias("fn"),
        F.count_if(hit & positive).alias("tp"),
    )
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    f1_pos, f1_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return counts.withColumns(
        {
            "prevalence": (tp + fn) / F.col("rows"),
            "accuracy": (tp + tn) / F.col("rows"),
            "balanced_accuracy": (recall + specificity) / 2,
            "macro_f1": (f1_pos + f1_neg) / 2,
            "drop_precision": ratio(tp, tp + fp),
            "drop_recall": recall,
            "no_drop_precision": ratio(tn, tn + fn),
            "no_drop_recall": specificity,
        }
    )


def reliability_bins(df: DataFrame, y: str, p: str, bins: int = 6) -> DataFrame:
    """Quantile bins of the probability, right-closed, repeated edges merged."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, [], p, probs)
    edges = edges.select(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(bins + 1)])).alias("__edges"))
    inner = F.slice("__edges", F.lit(2), F.greatest(F.size("__edges") - 2, F.lit(0)))
    bin_ = F.size(F.filter(inner, lambda e: F.col(p) > e)) + 1
    return (
        with_scalars(df, edges)
        .groupBy(bin_.alias("bin"))
        .agg(F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"), F.count(F.lit(1)).alias("rows"))
    )


# --- uncertainty ----------------------------------------------------------------------------


def paired_day_delta(df: DataFrame, delta: str, date: str = "session_date", block: str = "block_id") -> DataFrame:
    return df.groupBy(block, date).agg(F.avg(delta).alias("delta"))


def _draws(daily: DataFrame, draws: int, seed: int, strata: Sequence[str], date: str) -> DataFrame:
    """One resampled mean per (draw, stratum): day picks are hashes, so they do not depend on partitions.

    The daily table has one row per calendar day and is small; draws run in parallel.
    """
    w = Window.partitionBy(*(strata or [F.lit(0)]))
    days = daily.withColumn("__i", F.row_number().over(w.orderBy(date)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    lists = days.groupBy(*strata).agg(
        F.max("__n").alias("__n"), F.sort_array(F.collect_list(F.struct("__i", "delta"))).alias("__days")
    )
    label = F.concat_ws("|", *[F.col(s) for s in strata]) if strata else F.lit("all")
    spread = lists.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = lambda i: F.element_at(
        "__days", (F.pmod(F.xxhash64(label, F.col("draw"), i, F.lit(seed)), F.col("__n")) + 1).cast("int")
    )["delta"]
    values = F.transform(F.sequence(F.lit(1), F.col("__n").cast("int")), pick)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return spread.select(*strata, "draw", total.alias("total"), F.col("__n").alias("days"))


def block_bootstrap(daily: DataFrame, draws: int = 10_000, seed: int = 17, strata: Sequence[str] = ("block_id",), date: str = "session_date") -> DataFrame:
    """Mean daily difference with a 95 percent interval from resampling days inside each stratum."""
    samples = _draws(daily, draws, seed, list(strata), date).groupBy("draw").agg(
        (F.sum("total") / F.sum("days")).alias("mean")
    )
    interval = exact_quantiles(samples, [], "mean", {"ci95_low": 0.025, "ci95_high": 0.975})
    base = daily.agg(F.avg("delta").alias("mean_delta"), F.count(F.lit(1)).alias("day_blocks"))
    return with_scalars(base, interval).withColumn("draws", F.lit(draws))


def block_heterogeneity(daily: DataFrame, first: str, second: str, draws: int = 10_000, seed: int = 17, block: str = "block_id", date: str = "session_date") -> DataFrame:
    """Difference of two block means with its bootstrap interval."""
    samples = _draws(daily, draws, seed, [block], date).withColumn("mean", F.col("total") / F.col("days"))
    wide = samples.groupBy("draw").agg(
        (F.max(F.when(F.col(block) == second, F.col("mean"))) - F.max(F.when(F.col(block) == first, F.col("mean")))).alias("d")
    )
    interval = exact_quantiles(wide, [], "d", {"difference_ci95_low": 0.025, "difference_ci95_high": 0.975})
    means = daily.agg(
        F.avg(F.when(F.col(block) == first, F.col("delta"))).alias("first_mean_delta"),
        F.avg(F.when(F.col(block) == second, F.col("delta"))).alias("second_mean_delta"),
    ).withColumn("difference", F.col("second_mean_delta") - F.col("first_mean_delta"))
    return with_scalars(means, interval).withColumn("draws", F.lit(draws))


def constant_baselines(train: DataFrame, y: str, residual: str, by: Sequence[str] = ()) -> DataFrame:
    """Constant forecasts of a training set: its rate and its empirical quantiles."""
    probs = {f"q{int(level * 100):02d}": level for level in C.QUANTILES}
    rate = train.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("rate"))
    return join_on(rate, exact_quantiles(train, list(by), residual, probs), list(by))


def relative_skill(table: DataFrame, model: str, base: str, by: Sequence[str], rows: str = "rows") -> DataFrame:
    """Percentage improvement over a baseline, pooled over groups by row count."""
    mean = lambda c: F.sum(F.col(c) * F.col(rows)) / F.sum(rows)
    return table.groupBy(*by).agg(
        F.sum(rows).alias("rows"), (F.lit(100.0) * (1 - F.try_divide(mean(model), mean(base)))).alias("skill_pct")
    )


def release_gates(metrics: DataFrame) -> DataFrame:
    """Ten boolean gates over one row of pooled metrics and audit counts; a model may equal its baseline."""
    c = F.col
    gates = {
        "both_blocks_pass": c("failed_blocks") == 0,
        "proper_score_beats_prior": c("proper_score") <= c("base_proper_score"),
        "mape_beats_anchor": c("mape") <= c("base_mape"),
        "wis_beats_empirical": c("wis") <= c("base_wis"),
        "quantiles_coherent": c("crossing_rate") == 0.0,
        "ndcg5_beats_anchor": c("ndcg5") >= c("base_ndcg5"),
        "regret_beats_buy_all": c("mean_regret") <= c("buy_all_regret"),
        "cvar_close_to_buy_all": c("cvar95_regret") <= c("buy_all_cvar95") * 1.05 + 1.0,
        "recipe_unchanged": c("recipes") == 1,  # distinct frozen recipes over all blocks and the contract
        "blocks_disjoint": (c("row_overlap") == 0) & (c("query_overlap") == 0),
    }
    out = metrics.select(*[F.coalesce(gate, F.lit(False)).alias(name) for name, gate in gates.items()])
    passed = sum((F.col(name).cast("int") for name in gates), F.lit(0))
    return out.withColumn("passed", passed)


# --- recipe selection -----------------------------------------------------------------------


def blends(df: DataFrame, first: str, second: str, incumbent: str, name: str = "value", weights: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Long table (row, recipe, value): the members, their mean and blends of the mean with the incumbent.

    Values are numbers (probabilities, fares, scores) or arrays of equal length (quantiles), blended place by place.
    """
    arrays = df.schema[first].dataType.typeName() == "array"

    def mix(a: Column, b: Column, w: float) -> Column:
        one = lambda x, y: x * w + y * (1.0 - w)
        return F.zip_with(a, b, one) if arrays else one(a, b)

    half = lambda a, b: F.zip_with(a, b, lambda x, y: (x + y) / 2) if arrays else (a + b) / 2
    mean = half(F.col(first), F.col(second))
    recipes = {"INCUMBENT": F.col(incumbent), "FIRST": F.col(first), "SECOND": F.col(second), "MEAN": mean}
    recipes |= {f"BLEND_{int(w * 100):02d}": mix(mean, F.col(incumbent), w) for w in weights}
    kind = "array<double>" if arrays else "double"
    structs = [F.struct(F.lit(n).alias("recipe"), e.cast(kind).alias(name)) for n, e in recipes.items()]
    return df.select("*", F.inline(F.array(*structs)))


def blend_probabilities(df: DataFrame, first: str, second: str, incumbent: str, weights: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    return blends(df, first, second, incumbent, "probability", weights)


#: Fixed values per task: primary metric, whether larger is better, tolerance of the late gate.
TASKS = {
    "CLASSIFICATION": ("proper_score", False, 0.01),
    "POINT": ("mape", False, 0.02),
    "DISTRIBUTION": ("wis", False, 0.03),
    "RANKING": ("ndcg5", True, 0.01),
}


def recipe_table(folds: DataFrame, task: str, value: str = "score", fold_set: str = "fold_set") -> DataFrame:
    """Screen and late means, worst folds and selection score per recipe, from one metric value per recipe and fold."""
    _, maximise, _ = TASKS[task]
    worst = F.min if maximise else F.max
    screen, late = (F.when(F.col(fold_set) == s, F.col(value)) for s in ("SCREEN", "LATE"))
    table = folds.groupBy("recipe").agg(
        F.avg(screen).alias("screen"),
        F.avg(late).alias("late"),
        F.avg(F.when(F.col(fold_set).isin("SCREEN", "LATE"), F.col(value))).alias("all"),
        worst(screen).alias("screen_worst_fold"),
        worst(late).alias("late_worst_fold"),
    )
    return table.withColumn("selection_score", -F.col("screen") if maximise else F.col("screen"))


def proper_scores(long: DataFrame, y: str, p: str = "probability", by: Sequence[str] = ("recipe", "fold_set", "fold")) -> DataFrame:
    """Log loss plus Brier score per recipe and fold."""
    prob = clip_probability(p)
    score = F.avg(log_loss(y, prob)) + F.avg(F.pow(prob - F.col(y), 2))
    return long.groupBy(*by).agg(score.alias("score"))


def recipe_scores(
    long: DataFrame, task: str, y: str, value: str = "value", by: Sequence[str] = ("recipe", "fold_set", "fold"), query: str = "query_id", tie: str = "offer_id", rows: DataFrame | None = None
) -> DataFrame:
    """Primary metric of a task per recipe and fold: proper score, MAPE, WIS of ordered quantiles, or mean NDCG at 5
    (``y`` is then the fare by which queries are ranked). Where every recipe holds the same rows, as ``blends`` makes
    them, ``rows`` may give them without the recipe, so that fares are ranked once for all recipes."""
    if task == "CLASSIFICATION":
        return proper_scores(long, y, value, by)
    if task == "POINT":
        truth = F.greatest(F.col(y).cast("double"), F.lit(1.0))
        error = F.abs(F.greatest(F.col(value).cast("double"), F.lit(1.0)) - truth) / truth
        return long.groupBy(*by).agg(F.avg(error).alias("score"))
    if task == "DISTRIBUTION":
        ordered = long.withColumn("__q", K.rearrange(value))
        return ordered.groupBy(*by).agg(F.avg(K.wis(y, "__q")).alias("score"))
    outer = [c for c in by if rows is None or c in rows.columns]
    variants = [c for c in by if c not in outer]
    key, fare = F.struct(*outer, query).alias("__query"), F.col(y).alias("__y")
    flat = long.select(*variants, key, tie, F.col(value).alias("__s"), fare)
    per_query = ndcg(flat, "__s", "__y", "__query", tie, variants=variants, rows=None if rows is None else rows.select(key, fare))
    return per_query.groupBy(*[c if c in variants else F.col(f"__query.{c}").alias(c) for c in by]).agg(F.avg("ndcg5").alias("score"))


def choose_recipe(table: DataFrame, task: str, incumbent: str = "INCUMBENT") -> DataFrame:
    """One row: the winner on the screen folds (ties by name) and the frozen recipe, which is the winner only if it
    passes the late gate."""
    gated = late_gate(table, task, incumbent)
    best = gated.agg(F.min_by(F.struct("recipe", "late_pass"), F.struct("selection_score", "recipe")).alias("x"))
    won = F.col("x.recipe")
    status = F.when(won == incumbent, "INCUMBENT_WON_SCREEN").when(F.col("x.late_pass"), "PASS").otherwise("RETAIN_INCUMBENT")
    frozen = F.when(F.col("x.late_pass"), won).otherwise(incumbent)
    return best.select(won.alias("screen_winner"), frozen.alias("frozen_recipe"), status.alias("gate_status"))


def late_gate(table: DataFrame, task: str, incumbent: str = "INCUMBENT") -> DataFrame:
    """Whether a recipe's late mean and worst late fold stay within tolerance of the incumbent (one row).

    The tolerance is absolute where larger is better, relative where smaller is, and half as large again for the
    worst fold.
    """
    _, maximise, tolerance = TASKS[task]
    base = table.where(F.col("recipe") == incumbent).agg(
        F.max("late").alias("__mean"), F.max("late_worst_fold").alias("__worst")
    )
    if maximise:
        mean = F.col("late") >= F.col("__mean") - tolerance
        worst = F.col("late_worst_fold") >= F.col("__worst") - tolerance * 1.5
    else:
        mean = F.col("late") <= F.col("__mean") * (1.0 + tolerance)
        worst = F.col("late_worst_fold") <= F.col("__worst") * (1.0 + tolerance * 1.5)
    out = with_scalars(table, base).withColumns({"pass_mean": mean, "pass_worst_fold": worst, "late_pass": mean & worst})
    return out.drop("__mean", "__worst")
