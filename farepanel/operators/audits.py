"""Audits of identity, horizon coverage, baselines, drift and composition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import metrics
from farepanel.operators.history import rolling_median
from farepanel.operators.market import session_pairs
from farepanel.operators.scale import (
    exact_quantiles, histogram, join_on, running_totals, with_scalars,
)
from farepanel.session import materialise


def pct(a: Column, b: Column) -> Column:
    """Percentage, zero when the base is zero."""
    return F.coalesce(F.try_divide(a * F.lit(100.0), b.cast("double")), F.lit(0.0))


# --- identity -------------------------------------------------------------------------------


def with_identity(df: DataFrame) -> DataFrame:
    args = ("flight_no", "airline", "departure_hhmm")
    return df.withColumns(
        {
            "flight_no_clean": K.flight_no_clean("flight_no"),
            "is_schedule_fallback": K.schedule_fallback(*args),
            "verified_flight_no": K.verified_flight_no(*args),
        }
    )


def identity_summary(df: DataFrame) -> DataFrame:
    """Rows, dates, fallback share, duplicate share and slots per era; needs the identity columns."""
    out = df.groupBy("collection_era").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("session_date").alias("first_date"),
        F.max("session_date").alias("last_date"),
        F.count_if("is_schedule_fallback").alias("fallback_rows"),
        F.count_if("is_exact_duplicate").alias("exact_duplicate_rows"),
        F.countDistinct("schedule_slot_id").alias("schedule_slots"),
    )
    return out.withColumn("fallback_pct", pct(F.col("fallback_rows"), F.col("rows"))).withColumn(
        "exact_duplicate_pct", pct(F.col("exact_duplicate_rows"), F.col("rows"))
    )


def collisions(df: DataFrame) -> DataFrame:
    """(batch, slot) states observed more than once."""
    return (
        df.groupBy("session_key", "schedule_slot_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.countDistinct("price_vnd").alias("unique_prices"),
            F.countDistinct("flight_no_clean").alias("unique_raw_flight_numbers"),
            F.min("scraped_at").alias("first_scrape"),
            F.max("scraped_at").alias("last_scrape"),
        )
        .where(F.col("rows") > 1)
    )


def schedule_shifts(df: DataFrame) -> DataFrame:
    """Verified flights with their departure slots."""
    return (
        df.where(F.col("verified_flight_no").isNotNull())
        .groupBy("route", "airline", "flight_date", "verified_flight_no")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.countDistinct("departure_hhmm").alias("departure_slots"),
            F.min("departure_hhmm").alias("first_slot"),
            F.max("departure_hhmm").alias("last_slot"),
            F.countDistinct("days_until_departure").alias("observed_duds"),
        )
        .withColumn("schedule_shift_observed", F.col("departure_slots") > 1)
    )


def merge_risk(df: DataFrame, keys: Sequence[str] = ("session_key", "schedule_slot_id")) -> DataFrame:
    """Slots of one batch that hold more than one verified number."""
    return (
        df.where(F.col("verified_flight_no").isNotNull())
        .groupBy(*keys)
        .agg(F.countDistinct("verified_flight_no").alias("verified_numbers"), F.count(F.lit(1)).alias("rows"))
        .where(F.col("verified_numbers") > 1)
    )


def retention(df: DataFrame, windows: Sequence[int] = C.BOOKING_WINDOWS) -> DataFrame:
    """Entities of one horizon seen again at the next; one flag per window and entity, no set join."""
    seen = df.groupBy("schedule_slot_id", "session_label").agg(
        *[F.max((F.col("days_until_departure") == w).cast("int")).alias(f"w{w}") for w in windows]
    )
    steps = F.array(
        *[
            F.struct(
                F.lit(a).alias("current_dud"), F.lit(b).alias("target_dud"),
                F.col(f"w{a}").alias("here"), F.col(f"w{b}").alias("there"),
            )
            for a, b in zip(windows[:-1], windows[1:])
        ]
    )
    rows = seen.select(F.explode(steps).alias("s")).select("s.*").where("here = 1")
    out = rows.groupBy("current_dud", "target_dud").agg(
        F.count(F.lit(1)).alias("current_entities"), F.sum("there").cast("bigint").alias("exact_retained_entities")
    )
    return out.withColumn(
        "exact_retention_pct", pct(F.col("exact_retained_entities"), F.col("current_entities"))
    ).withColumn("missing_exact_entities", F.col("current_entities") - F.col("exact_retained_entities"))


# --- horizons -------------------------------------------------------------------------------


def horizon_pairs(df: DataFrame, windows: Sequence[int] = C.BOOKING_WINDOWS) -> DataFrame:
    """Every offer with each lower window, observed or not; the fan-out is the fixed grid.

    An entity (era, slot, half-day) has at most one offer per window, so it is gathered once and its pairs are formed
    inside the row: offers are shuffled once, and never after the fan-out.
    """
    entity = ["collection_era", "schedule_slot_id", "session_label"]
    rest = [c for c in df.columns if c not in entity]
    seen = df.groupBy(*entity).agg(F.collect_list(F.struct(*rest)).alias("__seen"))
    current = seen.select(*entity, "__seen", F.explode("__seen").alias("__c")).select(*entity, "__seen", "__c.*")
    lower = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w < F.col("days_until_departure"))
    out = current.withColumn("target_dud", F.explode(lower)).withColumnRenamed("days_until_departure", "current_dud")
    out = out.withColumn("expected_date", F.date_sub(F.col("flight_date"), F.col("target_dud")))
    hits = F.filter("__seen", lambda s: s["days_until_departure"] == F.col("target_dud"))
    out = out.withColumn("__t", F.explode_outer(hits)).withColumns(
        {
            "target_price_vnd": F.col("__t.price_vnd"),
            "target_time": F.col("__t.session_id"),
            "target_session_date": F.col("__t.session_date"),
        }
    ).drop("__seen", "__t")
    observed = (
        F.col("target_price_vnd").isNotNull()
        & (F.col("target_time") > F.col("session_id"))
        & (F.col("target_session_date") == F.col("expected_date"))
    )
    change = F.when(observed, F.col("target_price_vnd") - F.col("price_vnd"))
    return (
        out.withColumn("observed", F.coalesce(observed, F.lit(False)))
        .withColumn("change_vnd", change)
        .withColumn("change_pct", F.when(observed, F.col("target_price_vnd") / F.col("price_vnd") - 1))
    )


def horizon_coverage(pairs: DataFrame, cutoff: str) -> DataFrame:
    """Maturity, coverage, change medians and the wait, stable and rise shares per (current, target)."""
    keys = ["current_dud", "target_dud"]
    wait, rise = F.col("change_pct") <= -0.05, F.col("change_pct") >= 0.05
    seen = F.col("observed")
    base = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("current_rows"),
        F.count_if(F.col("expected_date") <= F.lit(cutoff).cast("date")).alias("mature_rows"),
        F.count_if(seen).alias("observed_target_rows"),
        F.count_if(wait).alias("wait_rows"),
        F.count_if(rise).alias("rise_rows"),
        F.count_if(F.col("target_price_vnd").isNotNull() & ~(F.col("target_time") > F.col("session_id"))).alias(
            "strict_time_violations"
        ),
    )
    n = F.col("observed_target_rows")
    base = base.withColumns(
        {
            "horizon_gap_days": F.col("current_dud") - F.col("target_dud"),
            "is_exact_next": K.next_dud("current_dud") == F.col("target_dud"),
            "coverage_of_mature_pct": pct(n, F.col("mature_rows")),
            "wait_prevalence_pct": pct(F.col("wait_rows"), n),
            "rise_pct": pct(F.col("rise_rows"), n),
            "stable_pct": pct(n - F.col("wait_rows") - F.col("rise_rows"), n),
        }
    )
    # every measured value travels once, tagged by its kind, so the pairs are joined once for all quantiles
    kinds = {
        "change_vnd": (F.col("change_vnd").cast("double"), {"median": 0.5}),
        "change_pct": (F.col("change_pct") * F.lit(100.0), {"median": 0.5}),
        "wait_savings_vnd": (F.when(wait, -F.col("change_vnd")).cast("double"), {"median": 0.5, "p90": 0.9}),
        "rise_cost_vnd": (F.when(rise, F.col("change_vnd")).cast("double"), {"median": 0.5, "p90": 0.9}),
    }
    values = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, (v, _) in kinds.items()])
    long = pairs.where(seen).select(*keys, F.explode(values).alias("m")).select(*keys, "m.*")
    table = exact_quantiles(long, [*keys, "kind"], "v", {"median": 0.5, "p90": 0.9})
    wide = table.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("kind") == k, F.col(q))).alias(f"{q}_{k}")
            for k, (_, probs) in kinds.items()
            for q in probs
        ]
    )
    return base.join(wide, keys, "left")


def oracle_rows(offers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lowest observed later fare of every offer; on a tie the farther horizon."""
    best = pairs.groupBy("offer_id").agg(
        F.count(F.lit(1)).alias("observed_future_count"),
        F.min(F.struct(F.col("target_price_vnd"), (-F.col("target_dud")).alias("d"))).alias("b"),
    )
    out = offers.select("offer_id", "days_until_departure", "price_vnd").join(best, "offer_id", "left")
    low = F.col("b.target_price_vnd")
    return out.select(
        "offer_id",
        "days_until_departure",
        "price_vnd",
        F.coalesce("observed_future_count", F.lit(0)).alias("observed_future_count"),
        low.alias("oracle_min_future_price"),
        (-F.col("b.d")).alias("oracle_best_dud"),
        (F.col("price_vnd") - low).alias("oracle_savings_vnd"),
        (F.lit(100.0) * (F.col("price_vnd") - low) / F.col("price_vnd")).alias("oracle_savings_pct"),
    )


def oracle_ceiling(rows: DataFrame) -> DataFrame:
    by = ["days_until_departure"]
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("current_rows"),
        F.count("oracle_min_future_price").alias("rows_with_observed_future"),
        F.count_if(F.col("oracle_savings_vnd") > 0).alias("opportunity_rows"),
    )
    base = base.withColumn("future_coverage_pct", pct(F.col("rows_with_observed_future"), F.col("current_rows")))
    base = base.withColumn(
        "opportunity_pct_of_observed",
        F.try_divide(F.col("opportunity_rows") * F.lit(100.0), F.col("rows_with_observed_future")),
    )
    base = base.join(exact_quantiles(rows, by, "oracle_savings_vnd", {"median_oracle_savings_vnd": 0.5}), by, "left")
    return base.join(exact_quantiles(rows, by, "oracle_savings_pct", {"median_oracle_savings_pct": 0.5}), by, "left")


# --- baselines ------------------------------------------------------------------------------


def baseline_matrix(df: DataFrame, y: str, baselines: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """MAE, MAPE and R2 of several baseline columns per group, in one grouped aggregate."""
    structs = [F.struct(F.lit(n).alias("baseline"), F.col(c).cast("double").alias("pred")) for n, c in baselines.items()]
    long = df.select(*by, F.col(y).cast("double").alias("y"), F.explode(F.array(*structs)).alias("b")).select(*by, "y", "b.*")
    ok = F.col("pred").isNotNull() & F.col("y").isNotNull()
    truth, error = F.when(ok, F.col("y")), F.col("y") - F.col("pred")
    spread = F.var_pop(truth) * F.count(truth)
    return long.groupBy(*by, "baseline").agg(
        F.count_if(ok).alias("eligible_rows"),
        pct(F.count_if(ok), F.count(F.lit(1))).alias("coverage_pct"),
        F.avg(F.abs(error)).alias("mae_vnd"),
        (F.lit(100.0) * F.avg(F.abs(error) / F.col("y"))).alias("mape_pct"),
        F.when(spread > 0, 1 - F.sum(error * error) / spread).alias("r2"),
    )


def baseline_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("baseline").agg(
        F.sum("eligible_rows").alias("rows"), F.avg("mape_pct").alias("mean_mape_pct"), F.avg("r2").alias("mean_r2")
    )


def prevalence_baseline(split: DataFrame, y: str = "drop_5pct") -> DataFrame:
    """PR-AUC of the past overall rate and of the past rate per target horizon, per fold."""
    train, valid = split.where("role = 'TRAIN'"), split.where("role = 'VALID'")
    cells = train.groupBy("fold", "target_dud").agg(F.sum(y).alias("k"), F.count(F.lit(1)).alias("n"))
    overall = cells.groupBy("fold").agg((F.sum("k") / F.sum("n")).alias("overall"), F.sum("n").alias("train_rows"))
    scored = join_on(
        join_on(valid.select("fold", "target_dud", y), cells, ["fold", "target_dud"], "left"), overall, ["fold"]
    ).withColumn("rate", F.coalesce(F.col("k") / F.col("n"), F.col("overall")))
    structs = [F.struct(F.lit("past_overall_prevalence").alias("baseline"), F.col("overall").alias("p")),
               F.struct(F.lit("past_target_dud_prevalence").alias("baseline"), F.col("rate").alias("p"))]
    long = scored.select("fold", "train_rows", y, F.explode(F.array(*structs)).alias("b")).select("fold", "train_rows", y, "b.*")
    by = ["fold", "baseline"]
    base = long.groupBy(*by).agg(
        F.max("train_rows").alias("train_rows"),
        F.count(F.lit(1)).alias("validation_rows"),
        F.avg(F.col(y).cast("double")).alias("validation_prevalence"),
    )
    out = join_on(base, metrics.average_precision(long, y, "p", by), by, "left")
    return out.withColumn("lift", F.col("pr_auc") - F.col("validation_prevalence"))


# --- drift and composition ------------------------------------------------------------------


def with_period(df: DataFrame, date: str = "session_date") -> DataFrame:
    """EARLY before the middle distinct date, LATE from it on; the date list is calendar-sized."""
    dates = df.select(date).distinct()
    w = Window.partitionBy(F.lit(0))
    ranked = dates.withColumn("__r", F.row_number().over(w.orderBy(date)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    split = ranked.where(F.col("__r") == F.floor(F.col("__n") / 2)).agg(F.max(date).alias("__split"))
    return with_scalars(df, split).withColumn(
        "period", F.when(F.col(date) < F.col("__split"), "EARLY").otherwise("LATE")
    ).drop("__split")


def matched_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strata present in both periods with their medians and percentage change.

    A median keeps one counter per distinct fare of a stratum; without strata all rows are one cell, whose medians
    come from spread totals.
    """
    early, late = F.col("period") == "EARLY", F.col("period") == "LATE"
    if keys:
        cells = df.groupBy(*keys).agg(
            F.percentile(F.when(early, F.col("price_vnd")), 0.5).alias("early"),
            F.percentile(F.when(late, F.col("price_vnd")), 0.5).alias("late"),
            F.count_if(early).alias("early_rows"),
            F.count_if(late).alias("late_rows"),
        )
    else:
        halves = exact_quantiles(df, ["period"], "price_vnd", {"median": 0.5}, support="rows")
        pick = lambda half, column: F.max(F.when(half, F.col(column)))
        cells = halves.agg(
            pick(early, "median").alias("early"), pick(late, "median").alias("late"),
            F.coalesce(pick(early, "rows"), F.lit(0)).alias("early_rows"), F.coalesce(pick(late, "rows"), F.lit(0)).alias("late_rows"),
        )
    return cells.where(F.col("early").isNotNull() & F.col("late").isNotNull()).withColumn(
        "change_pct", F.lit(100.0) * (F.col("late") / F.col("early") - 1)
    )


def matched_shift(df: DataFrame, keys: Sequence[str], stage: str) -> DataFrame:
    cells = matched_cells(df, keys)
    weight = F.least("early_rows", "late_rows")
    base = cells.agg(
        F.lit(stage).alias("stage"),
        F.count(F.lit(1)).alias("matched_cells"),
        (F.lit(100.0) * F.avg((F.col("change_pct") < 0).cast("double"))).alias("share_cells_declining_pct"),
        (F.sum(F.col("change_pct") * weight) / F.sum(weight)).alias("weighted_mean_cell_change_pct"),
    )
    return with_scalars(base, exact_quantiles(cells, [], "change_pct", {"median_cell_change_pct": 0.5}))


def shift_ladder(df: DataFrame, ladder: Mapping[str, Sequence[str]]) -> DataFrame:
    """Matched shift at nested strata and the share of the raw shift that they explain."""
    stages = list(ladder.items())
    out = matched_shift(df, *reversed(stages[0]))
    for stage, keys in stages[1:]:
        out = out.unionByName(matched_shift(df, keys, stage))
    raw = out.where(F.col("stage") == stages[0][0]).agg(F.max("median_cell_change_pct").alias("__raw"))
    explained = F.lit(100.0) * (1 - F.try_divide(F.abs("median_cell_change_pct"), F.abs("__raw")))
    return with_scalars(out, raw).withColumn("explained_share_pct", explained).drop("__raw")


def composition_shift(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Share of every level late minus early, and the level that moved most, per dimension."""
    structs = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dims]
    counts = df.select("period", F.explode(F.array(*structs)).alias("x")).groupBy("x.dimension", "x.level").agg(
        F.count_if(F.col("period") == "EARLY").alias("e"), F.count_if(F.col("period") == "LATE").alias("l")
    )
    totals = counts.groupBy("dimension").agg(F.sum("e").alias("__e"), F.sum("l").alias("__l"))
    delta = F.lit(100.0) * (
        F.coalesce(F.try_divide(F.col("l").cast("double"), F.col("__l")), F.lit(0.0))
        - F.coalesce(F.try_divide(F.col("e").cast("double"), F.col("__e")), F.lit(0.0))
    )
    shares = counts.join(totals, "dimension").withColumn("delta", delta)
    best = shares.groupBy("dimension").agg(
        F.max(F.struct(F.abs("delta").alias("a"), F.col("level"), F.col("delta"))).alias("x")
    )
    return best.select(
        "dimension",
        F.col("x.a").alias("max_absolute_share_shift_pp"),
        F.col("x.level").alias("level_with_largest_shift"),
        F.col("x.delta").alias("signed_shift_pp"),
    )


def collection_stability(df: DataFrame) -> DataFrame:
    """Offers and distinct routes, airlines, windows and queries per batch, from one cell table."""
    keys = ["session_date", "session_label"]
    cells = df.groupBy(*keys, "route", "airline", "days_until_departure").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("offer_rows"),
        F.countDistinct("route").alias("routes"),
        F.countDistinct("airline").alias("airlines"),
        F.countDistinct("days_until_departure").alias("booking_windows"),
        F.countDistinct("route", "days_until_departure").alias("route_dud_queries"),
    )


def availability(df: DataFrame, columns: Sequence[str], warm_prefixes=("previous_", "prior_price_", "lag_age")) -> DataFrame:
    """Non-null share of every feature in one aggregate, with its warm-only flag."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns])
    structs = [
        F.struct(
            F.lit(c).alias("feature"),
            pct(F.col(c), F.col("__n")).alias("all_rows_available_pct"),
            F.lit(c.startswith(tuple(warm_prefixes))).alias("warm_only"),
        )
        for c in columns
    ]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def pearson_pairs(df: DataFrame, columns: Sequence[str], min_n: int = 100) -> DataFrame:
    """Pairwise-complete correlation of every column pair in one pass."""
    pairs = list(combinations(sorted(columns), 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    row = df.agg(
        *[F.corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(both(a, b)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
    )
    structs = [
        F.struct(F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"), F.col(f"n{i}").alias("rows"),
                 F.when(F.col(f"n{i}") >= min_n, F.col(f"r{i}")).alias("pearson"))
        for i, (a, b) in enumerate(pairs)
    ]
    out = row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    strength = F.abs("pearson")
    return out.withColumn(
        "review_band",
        F.when(strength >= 0.95, "NEAR_DUPLICATE").when(strength >= 0.80, "REVIEW").when(strength.isNotNull(), "DISTINCT").otherwise("UNAVAILABLE"),
    )


def spearman_pairs(df: DataFrame, columns: Sequence[str], min_n: int = 100) -> DataFrame:
    """Correlation of averaged ranks, pairwise complete, over all rows; ranks come from value histograms.

    A rank counts the rows that also have the other column of the pair. One histogram per column holds these counts for
    all its pairs, and a column joins the rows once, whatever the number of pairs. The columns are written once.
    """
    columns = sorted(columns)
    pairs = list(combinations(columns, 2))
    ranked = df = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "columns")
    for c in columns:
        others = {f"__{o}": F.when(F.col(o).isNotNull(), 1).otherwise(0) for o in columns if o != c}
        totals = running_totals(histogram(df, [], c, **others), [], c, list(others))
        found = [(F.col(f"{o}_before") + (F.col(o) + 1) / F.lit(2.0)).alias(f"__{c}{o}") for o in others]
        ranked = ranked.join(totals.select(c, *found), c, "left")
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    one = ranked.agg(*[
        F.struct(
            F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"), F.count_if(hit).alias("rows"),
            F.corr(F.when(hit, F.col(f"__{a}__{b}")), F.when(hit, F.col(f"__{b}__{a}"))).alias("spearman"),
        ).alias(f"{a}|{b}")
        for (a, b), hit in both.items()
    ])
    long = one.select(F.inline(F.array(*[f"`{a}|{b}`" for a, b in pairs]))).where("rows > 0")
    return long.withColumn("spearman", F.when(F.col("rows") >= min_n, F.col("spearman")))


def frame_summary(offers: DataFrame, events: DataFrame, registry: DataFrame) -> DataFrame:
    """Long report (section, item, value) of one data product.

    Every frame is read once, into a written table of its categories; totals and rates are sums over these.
    """
    def melt(df: DataFrame, section: str, values: Mapping[str, Column]) -> DataFrame:
        row = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
        items = [F.struct(F.lit(k).alias("item"), F.col(k).alias("value")) for k in values]
        return row.select(F.lit(section).alias("section"), F.explode(F.array(*items)).alias("x")).select("section", "x.*")

    def counts(df: DataFrame, section: str, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("item")).agg(F.sum("n").cast("double").alias("value")).select(
            F.lit(section).alias("section"), "item", "value"
        )

    n = F.count(F.lit(1)).alias("n")
    eligible, event = "relative_history_eligible", "event_drop_5pct_or_50k"
    offers = materialise(offers.groupBy("anchor_source").agg(
        n, F.count("anchor_vnd").alias("anchored"), F.sum(eligible).alias("eligible"), F.count(eligible).alias("judged")
    ), "summary")
    flag = F.col(event).cast("double")
    events = materialise(events.groupBy("transition").agg(n, F.sum(flag).alias("hits"), F.count(flag).alias("judged")), "summary")
    registry = materialise(registry.groupBy("event_label_status", "exact_status").agg(n), "summary")
    rows = F.coalesce(F.sum("n"), F.lit(0))
    parts = [
        melt(offers, "offers", {
            "rows": rows,
            "anchor_coverage": F.try_divide(F.sum("anchored").cast("double"), F.sum("n")),
            "relative_history_eligible_rate": F.try_divide(F.sum("eligible").cast("double"), F.sum("judged")),
        }),
        counts(offers, "anchor_source", "anchor_source"),
        melt(events, "events", {"rows": rows, "prevalence": F.try_divide(F.sum("hits"), F.sum("judged"))}),
        counts(events, "transition", "transition"),
        counts(registry, "event_label_status", "event_label_status"),
        counts(registry, "exact_status", "exact_status"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- folds ----------------------------------------------------------------------------------


def fold_structure(split: DataFrame, y: str = "drop_5pct", warm: str = "is_warm", min_rows: int = 100) -> DataFrame:
    """Rows per role, supported transition cells, warm share, prevalence and the purge check per fold."""
    train, valid = F.col("role") == "TRAIN", F.col("role") == "VALID"
    cells = split.groupBy("fold", "current_dud", "target_dud").agg(
        F.count_if(train).alias("tn"),
        F.count_if(valid).alias("vn"),
        F.count_if(valid & (F.col(warm) == 1)).alias("vw"),
        F.sum(F.when(valid, F.col(y))).alias("vk"),
        F.max(F.when(train, F.col("label_time"))).alias("tl"),
        F.max("fold_start").alias("fs"),
    )
    out = cells.groupBy("fold").agg(
        F.sum("tn").alias("train_rows"),
        F.sum("vn").alias("validation_rows"),
        F.count_if(F.col("tn") >= min_rows).alias("supported_cells"),
        F.count_if(F.col("tn") > 0).alias("observed_cells"),
        pct(F.sum("vw"), F.sum("vn")).alias("validation_warm_pct"),
        pct(F.sum("vk"), F.sum("vn")).alias("validation_prevalence_pct"),
        F.max("tl").alias("max_training_label_time"),
        F.max("fs").alias("fs"),
    )
    return out.withColumn("label_time_purge_pass", F.col("max_training_label_time") < F.col("fs")).drop("fs")


def common_cells(split: DataFrame, folds: int) -> DataFrame:
    """Validation transitions present in every fold."""
    seen = split.where("role = 'VALID'").select("fold", "current_dud", "target_dud").distinct()
    return seen.groupBy("current_dud", "target_dud").agg(F.count(F.lit(1)).alias("folds")).where(F.col("folds") == folds)


def frame_gate(frames: Mapping[str, DataFrame], cutoff: str) -> DataFrame:
    """Rows per task, fold, window and part, and whether any label passes the cutoff."""
    edge = F.date_add(F.lit(cutoff).cast("date"), 1).cast("timestamp_ntz")
    out = None
    for name, frame in frames.items():
        task, window = name.split("/")
        part = frame.groupBy("fold", "part").agg(
            F.count(F.lit(1)).alias("rows"), F.max("label_time").alias("max_label_time")
        ).withColumns({"task": F.lit(task), "training_window": F.lit(window), "inside_cutoff": F.col("max_label_time") < edge})
        out = part if out is None else out.unionByName(part)
    return out


# --- report aggregates ----------------------------------------------------------------------


def daily_spine(df: DataFrame, date: str = "session_date") -> DataFrame:
    """Every date between the first and the last observed one."""
    bounds = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b")).alias(date))


def offer_volume(df: DataFrame, sources: Sequence[str] = (C.FLI_ERA, C.TRIP_ERA), source: str = "collection_era") -> DataFrame:
    """Distinct offers per date and source on the full date spine; a missing date stays null."""
    cells = df.groupBy("session_date", source).agg(F.countDistinct("offer_id").alias("n"))
    wide = cells.groupBy("session_date").pivot(source, list(sources)).agg(F.sum("n"))
    filled = wide.select("session_date", *[F.coalesce(F.col(s), F.lit(0)).alias(s.lower()) for s in sources])
    out = daily_spine(df).join(filled, "session_date", "left")
    return out.withColumn("is_missing", F.col(sources[0].lower()).isNull())


def fare_index(df: DataFrame, strata: Sequence[str] = ("route", "airline", "days_until_departure", "session_label")) -> DataFrame:
    """100 * exp(daily median of log(fare / stratum median)) with a trailing seven-day median."""
    reference = exact_quantiles(df, list(strata), "price_vnd", {"__ref": 0.5})
    rel = join_on(df, reference, list(strata)).withColumn("__z", F.ln(F.col("price_vnd") / F.col("__ref")))
    daily = exact_quantiles(rel, ["session_date"], "__z", {"z": 0.5}).select(
        "session_date", (F.lit(100.0) * F.exp("z")).alias("fare_index")
    )
    return rolling_median(daily_spine(df).join(daily, "session_date", "left"), "session_date", "fare_index")


def airline_drift(df: DataFrame, min_support: int = 100) -> DataFrame:
    """Daily median relative log and offer share per airline, with a centred seven-day median."""
    counts = df.groupBy("session_date", "airline").agg(F.count(F.lit(1)).alias("rows"))
    days = counts.groupBy("session_date").agg(F.sum("rows").alias("__all"))
    medians = exact_quantiles(df, ["session_date", "airline"], "current_relative_log", {"z": 0.5})
    grid = daily_spine(df).withColumn("airline", F.explode(F.array(*[F.lit(a) for a in C.AIRLINES])))
    keys = ["session_date", "airline"]
    out = grid.join(counts, keys, "left").join(medians, keys, "left").join(days, "session_date", "left")
    out = out.withColumn("drift", F.when(F.col("rows") >= min_support, F.col("z"))).withColumn(
        "share_pct", F.when(F.col("__all").isNotNull(), pct(F.coalesce("rows", F.lit(0)), F.col("__all")))
    )
    out = rolling_median(out, "session_date", "drift", ["airline"], centred=True)
    return out.withColumn("drift_smooth", F.when(F.col("drift").isNotNull(), F.col("drift_smooth"))).drop("__all", "z")


def ape_by(df: DataFrame, key: str, y: str = "price_vnd", yhat: str = "pred_vnd") -> DataFrame:
    ape = F.abs(F.col(yhat) - F.col(y)) / F.col(y)
    return exact_quantiles(df.withColumn("ape", ape), [key], "ape", {"q25": 0.25, "median": 0.5, "q75": 0.75}, support="rows")


def density2d(df: DataFrame, x: str, y: str, bins: int = 43, level: float = 0.999) -> DataFrame:
    """Square bins of two fares below a shared upper quantile, with counts."""
    both = df.select(F.explode(F.array(x, y)).alias("v"))
    limit = exact_quantiles(both, [], "v", {"__limit": level})
    cell = lambda c: F.floor(F.col(c) * bins / F.col("__limit")).cast("int")
    inside = (F.col(x) < F.col("__limit")) & (F.col(y) < F.col("__limit"))
    return with_scalars(df, limit).where(inside).groupBy(cell(x).alias("x_bin"), cell(y).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def session_frame(df: DataFrame, windows: Sequence[int] = C.BOOKING_WINDOWS) -> DataFrame:
    """Offers of every batch that has a predecessor, with gap, half-days and eras of the two batches as tags.

    The batch before is also where a prior anchor comes from, so its age is the gap. The list of batch pairs is
    bounded by the calendar.
    """
    pairs = session_pairs(df).select(
        "session_key", F.col("target_session_time").alias("label_time"), "source_session_time", "source_session_label", "source_collection_era"
    )
    gap = K.hours_between("source_session_time", "label_time")
    grid = F.col("days_until_departure").isin(*windows)
    return join_on(df, pairs, ["session_key"]).withColumns(
        {
            "session_gap_hours": gap,
            "session_gap_band": K.right_closed_band(gap, C.SESSION_GAP_BANDS),
            "session_transition": F.concat_ws("->", "source_session_label", "session_label"),
            "source_target_era_transition": F.concat_ws("->", "source_collection_era", "collection_era"),
            "anchor_age_band": K.right_closed_band(gap, C.ANCHOR_AGE_BANDS),
            "dud_support_mode": F.when(grid, "ON_GRID").otherwise("INTERIOR_OFF_GRID_INTERPOLATED"),
        }
    ).drop("source_session_time", "source_session_label", "source_collection_era")


def slice_metrics(
    df: DataFrame, dims: Mapping[str, str], y: str, yhat: str, slot: str = "schedule_slot_id", by: Sequence[str] = ()
) -> DataFrame:
    """One metric record for OVERALL and for every value of every slice dimension, in one aggregate.

    Partial sums per slice keep a hot slice small before the shuffle; slots are counted from a
    distinct (slice, slot) table.
    """
    structs = [F.struct(F.lit("OVERALL").alias("slice_type"), F.lit("ALL").alias("slice_value"))] + [
        F.struct(F.lit(n).alias("slice_type"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("slice_value"))
        for n, c in dims.items()
    ]
    t, q = F.col(y).cast("double"), F.col(yhat).cast("double")
    long = df.select(
        *by, F.explode(F.array(*structs)).alias("s"), F.col(slot).alias("__slot"), t.alias("t"), F.abs(t - q).alias("e")
    ).select(*by, "s.*", "__slot", "t", "e")
    keys = [*by, "slice_type", "slice_value"]
    spread = F.var_pop("t") * F.count(F.lit(1))
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("support"),
        F.avg("e").alias("mae_vnd"),
        F.avg(F.col("e") / F.greatest(F.col("t"), F.lit(1.0))).alias("mape"),
        (F.sum("e") / F.greatest(F.sum(F.abs("t")), F.lit(1.0))).alias("wmape"),
        F.when(spread > 0, 1 - F.sum(F.col("e") * F.col("e")) / spread).alias("r2"),
    )
    slots = long.select(*keys, "__slot").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("schedule_slots"))
    return base.join(slots, keys)


def pivot_coverage(coverage: DataFrame, windows: Sequence[int] = C.BOOKING_WINDOWS) -> DataFrame:
    """Coverage of mature rows, current horizon by target horizon."""
    wide = coverage.groupBy("current_dud").pivot("target_dud", list(windows[1:])).agg(F.first("coverage_of_mature_pct"))
    return wide.select("current_dud", *[F.col(str(w)).alias(f"target_{w}") for w in windows[1:]])
