"""Queries over identity, horizon, baseline, drift and report audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import audits, market, pairs, quality, serving, splits
from farepanel.plans.aggregates_q import DUPE, with_period as with_departure_period
from farepanel.plans.columns_q import CLEAN, FALLBACK, MARKET, VERIFIED
from farepanel.plans.history_q import r
from farepanel.plans.joins_q import registry_frame
from farepanel.plans.metrics_q import rounded, rsql
from farepanel.plans.panel_views import band, hours, next_dud
from farepanel.plans.registry import query, view
from farepanel.plans.selection_q import split
from farepanel.sources.panel import CUTOFF, FOLDS

view(
    "identified",
    f"""SELECT *, {CLEAN} AS flight_no_clean, {FALLBACK} AS is_schedule_fallback, {VERIFIED} AS verified_flight_no,
count(*) OVER (PARTITION BY {DUPE}) > 1 AS is_exact_duplicate FROM raw_offers""",
)


def identified(p):
    return quality.flag_duplicates(audits.with_identity(p.raw), DUPE.split(", "))


@query(
    "identity_by_era",
    f"""SELECT collection_era, count(*) AS rows, min(session_date) AS first_date, max(session_date) AS last_date,
count(*) FILTER (is_schedule_fallback) AS fallback_rows, count(*) FILTER (is_exact_duplicate) AS exact_duplicate_rows,
count(DISTINCT schedule_slot_id) AS schedule_slots, {rsql('100e0 * count(*) FILTER (is_schedule_fallback) / count(*)', 'fallback_pct')},
{rsql('100e0 * count(*) FILTER (is_exact_duplicate) / count(*)', 'exact_duplicate_pct')} FROM identified GROUP BY 1""",
)
def identity_by_era(p):
    return rounded(audits.identity_summary(identified(p)))


@query(
    "batch_slot_collisions",
    """SELECT session_key, schedule_slot_id, count(*) AS rows, count(DISTINCT price_vnd) AS unique_prices,
count(DISTINCT flight_no_clean) AS unique_raw_flight_numbers, min(scraped_at) AS first_scrape, max(scraped_at) AS last_scrape
FROM identified GROUP BY ALL HAVING count(*) > 1""",
)
def batch_slot_collisions(p):
    return audits.collisions(audits.with_identity(p.raw))


@query(
    "schedule_shifts",
    """SELECT route, airline, flight_date, verified_flight_no, count(*) AS rows, count(DISTINCT departure_hhmm) AS departure_slots,
min(departure_hhmm) AS first_slot, max(departure_hhmm) AS last_slot, count(DISTINCT days_until_departure) AS observed_duds,
count(DISTINCT departure_hhmm) > 1 AS schedule_shift_observed FROM identified WHERE verified_flight_no IS NOT NULL GROUP BY route, airline, flight_date, verified_flight_no""",
)
def schedule_shifts(p):
    return audits.schedule_shifts(audits.with_identity(p.raw))


@query(
    "slot_merge_risk",
    """SELECT session_key, route, airline, departure_minute, count(DISTINCT verified_flight_no) AS verified_numbers, count(*) AS rows
FROM identified WHERE verified_flight_no IS NOT NULL GROUP BY ALL HAVING count(DISTINCT verified_flight_no) > 1""",
)
def slot_merge_risk(p):
    keys = ["session_key", "route", "airline", "departure_minute"]
    return audits.merge_risk(audits.with_identity(p.raw), keys)


STEPS = ", ".join(f"({a}, {b})" for a, b in zip(C.BOOKING_WINDOWS[:-1], C.BOOKING_WINDOWS[1:]))


@query(
    "horizon_retention",
    f"""WITH e AS (SELECT DISTINCT schedule_slot_id, session_label, days_until_departure AS d FROM offers)
SELECT s.a AS current_dud, s.b AS target_dud, count(*) AS current_entities, count(t.d) AS exact_retained_entities,
{rsql('100e0 * count(t.d) / count(*)', 'exact_retention_pct')}, count(*) - count(t.d) AS missing_exact_entities
FROM (VALUES {STEPS}) s(a, b) JOIN e c ON c.d = s.a LEFT JOIN e t ON t.schedule_slot_id = c.schedule_slot_id AND t.session_label = c.session_label AND t.d = s.b
GROUP BY s.a, s.b""",
)
def horizon_retention(p):
    return rounded(audits.retention(p.offers))


# --- horizons -------------------------------------------------------------------------------

DUD_ROWS = ", ".join(f"({w})" for w in C.BOOKING_WINDOWS)
view(
    "horizon_rows",
    f"""SELECT *, CASE WHEN observed THEN tp - price_vnd END AS change_vnd, CASE WHEN observed THEN tp / price_vnd - 1 END AS change_pct FROM (
SELECT c.*, c.days_until_departure AS current_dud, w.t AS target_dud, c.flight_date - w.t AS expected_date, t.price_vnd AS tp, t.session_id AS tt,
t.price_vnd IS NOT NULL AND t.session_id > c.session_id AND t.session_date = c.flight_date - w.t AS observed
FROM offers c JOIN (SELECT CAST(t AS INTEGER) AS t FROM (VALUES {DUD_ROWS}) x(t)) w ON w.t < c.days_until_departure
LEFT JOIN offers t ON t.schedule_slot_id = c.schedule_slot_id AND t.session_label = c.session_label AND t.collection_era = c.collection_era AND t.days_until_departure = w.t)""",
)
view(
    "coverage_table",
    f"""SELECT current_dud, target_dud, current_dud - target_dud AS horizon_gap_days, coalesce({next_dud('current_dud')} = target_dud, FALSE) AS is_exact_next,
count(*) AS current_rows, count(*) FILTER (expected_date <= DATE '{CUTOFF}') AS mature_rows, count(*) FILTER (observed) AS observed_target_rows,
count(*) FILTER (change_pct <= -0.05e0) AS wait_rows, count(*) FILTER (change_pct >= 0.05e0) AS rise_rows,
count(*) FILTER (tp IS NOT NULL AND NOT tt > session_id) AS strict_time_violations,
{rsql(f"coalesce(100e0 * count(*) FILTER (observed) / nullif(count(*) FILTER (expected_date <= DATE '{CUTOFF}'), 0), 0)", 'coverage_of_mature_pct')},
{rsql('coalesce(100e0 * count(*) FILTER (change_pct <= -0.05e0) / nullif(count(*) FILTER (observed), 0), 0)', 'wait_prevalence_pct')},
{rsql('coalesce(100e0 * count(*) FILTER (change_pct >= 0.05e0) / nullif(count(*) FILTER (observed), 0), 0)', 'rise_pct')},
{rsql('coalesce(100e0 * count(*) FILTER (change_pct > -0.05e0 AND change_pct < 0.05e0) / nullif(count(*) FILTER (observed), 0), 0)', 'stable_pct')},
{rsql('quantile_cont(change_vnd, 0.5)', 'median_change_vnd', 4)}, {rsql('quantile_cont(100e0 * change_pct, 0.5)', 'median_change_pct', 6)},
{rsql('quantile_cont(CASE WHEN change_pct <= -0.05e0 THEN -change_vnd END, 0.5)', 'median_wait_savings_vnd', 4)},
{rsql('quantile_cont(CASE WHEN change_pct <= -0.05e0 THEN -change_vnd END, 0.9)', 'p90_wait_savings_vnd', 4)},
{rsql('quantile_cont(CASE WHEN change_pct >= 0.05e0 THEN change_vnd END, 0.5)', 'median_rise_cost_vnd', 4)},
{rsql('quantile_cont(CASE WHEN change_pct >= 0.05e0 THEN change_vnd END, 0.9)', 'p90_rise_cost_vnd', 4)} FROM horizon_rows GROUP BY current_dud, target_dud""",
)
MONEY = {"median_change_vnd", "median_wait_savings_vnd", "p90_wait_savings_vnd", "median_rise_cost_vnd", "p90_rise_cost_vnd"}


HORIZON = ("collection_era", "schedule_slot_id", "session_label", "offer_id", "days_until_departure", "flight_date", "price_vnd", "session_id", "session_date")


def coverage(p):
    out = audits.horizon_coverage(audits.horizon_pairs(p.offers.select(*HORIZON)), CUTOFF)
    digits = {c: 4 if c in MONEY else 6 if c == "median_change_pct" else 8 for c, t in out.dtypes if t == "double"}
    return out.withColumns({c: F.round(c, d) + 0.0 for c, d in digits.items()})


@query("horizon_coverage", "SELECT * FROM coverage_table")
def horizon_coverage(p):
    return coverage(p)


@query(
    "coverage_matrix",
    "SELECT current_dud, "
    + ", ".join(f"max(CASE WHEN target_dud = {w} THEN coverage_of_mature_pct END) AS target_{w}" for w in C.BOOKING_WINDOWS[1:])
    + " FROM coverage_table GROUP BY current_dud",
)
def coverage_matrix(p):
    df = audits.horizon_pairs(p.offers.select(*HORIZON)).groupBy("current_dud", "target_dud").agg(
        audits.pct(F.count_if("observed"), F.count_if(F.col("expected_date") <= F.lit(CUTOFF).cast("date"))).alias("coverage_of_mature_pct")
    )
    return audits.pivot_coverage(rounded(df))


view(
    "oracle_rows",
    """SELECT o.offer_id, o.days_until_departure, o.price_vnd, coalesce(m.n, 0) AS observed_future_count, m.lo AS oracle_min_future_price, m.d AS oracle_best_dud,
o.price_vnd - m.lo AS oracle_savings_vnd, 100e0 * (o.price_vnd - m.lo) / o.price_vnd AS oracle_savings_pct FROM offers o LEFT JOIN (
SELECT offer_id, count(*) AS n, min(tp) AS lo, CAST(arg_min(target_dud, tp * 1000 - target_dud) AS INTEGER) AS d FROM horizon_rows WHERE observed GROUP BY 1) m USING (offer_id)""",
)


def oracle(p):
    return audits.oracle_rows(p.offers, pairs.multi_horizon_pairs(p.offers, "session_id"))


@query(
    "oracle_rows",
    f"""SELECT offer_id, days_until_departure, price_vnd, observed_future_count, oracle_min_future_price, oracle_best_dud, oracle_savings_vnd,
{rsql('oracle_savings_pct', 'oracle_savings_pct')} FROM oracle_rows""",
)
def oracle_rows(p):
    return rounded(oracle(p))


@query(
    "oracle_ceiling",
    f"""SELECT days_until_departure, count(*) AS current_rows, count(oracle_min_future_price) AS rows_with_observed_future,
count(*) FILTER (oracle_savings_vnd > 0) AS opportunity_rows, {rsql('100e0 * count(oracle_min_future_price) / count(*)', 'future_coverage_pct')},
{rsql('100e0 * count(*) FILTER (oracle_savings_vnd > 0) / nullif(count(oracle_min_future_price), 0)', 'opportunity_pct_of_observed')},
{rsql('quantile_cont(oracle_savings_vnd, 0.5)', 'median_oracle_savings_vnd', 4)}, {rsql('quantile_cont(oracle_savings_pct, 0.5)', 'median_oracle_savings_pct')}
FROM oracle_rows GROUP BY 1""",
)
def oracle_ceiling(p):
    return rounded(audits.oracle_ceiling(oracle(p)))


# --- baselines ------------------------------------------------------------------------------


def baseline_sql(select: str, source: str, y: str, pred: str, group: str) -> str:
    return f"""SELECT {select}, count({pred}) AS eligible_rows, {rsql(f'100e0 * count({pred}) / count(*)', 'coverage_pct', 6)}, {rsql(f'avg(abs({y} - {pred}))', 'mae_vnd', 4)},
{rsql(f'100e0 * avg(abs({y} - {pred}) / {y})', 'mape_pct', 6)},
{rsql(f'CASE WHEN var_pop(CASE WHEN {pred} IS NOT NULL THEN {y} END) > 0 THEN 1 - sum(({y} - {pred}) * ({y} - {pred})) / (var_pop(CASE WHEN {pred} IS NOT NULL THEN {y} END) * count({pred})) END', 'r2', 6)}
FROM {source} GROUP BY {group}"""


BASE = {"current_price_carry_forward": "price_vnd", "current_other_airline_minimum": "competitor_min_price_other_airlines",
        "causal_route_airline_target_dud_market": "causal_target_market_median"}
view(
    "pairs_base",
    """SELECT m.*, o.competitor_min_price_other_airlines FROM pairs_mkt m LEFT JOIN others o USING (session_key, route, flight_date, airline)""",
)
view(
    "base_long",
    " UNION ALL ".join(f"SELECT current_dud, target_dud, CAST(target_price_vnd AS DOUBLE) AS y, '{n}' AS baseline, CAST({c} AS DOUBLE) AS pred FROM pairs_base" for n, c in BASE.items()),
)
view("baseline_table", baseline_sql("current_dud, target_dud, baseline", "base_long", "y", "pred", "current_dud, target_dud, baseline"))


def baseline_table(p):
    offers = market.with_other_airlines(p.timed)
    joined = pairs.target_market(pairs.multi_horizon_pairs(offers), p.timed)
    out = audits.baseline_matrix(joined, "target_price_vnd", BASE, ["current_dud", "target_dud"])
    return out.select(
        "current_dud", "target_dud", "baseline", "eligible_rows", r("coverage_pct", 6), r("mae_vnd", 4), r("mape_pct", 6), r("r2", 6)
    )


@query("baseline_matrix", "SELECT * FROM baseline_table")
def baseline_matrix(p):
    return baseline_table(p)


@query(
    "baseline_summary",
    f"SELECT baseline, CAST(sum(eligible_rows) AS BIGINT) AS rows, {rsql('avg(mape_pct)', 'mean_mape_pct', 5)}, {rsql('avg(r2)', 'mean_r2', 5)} FROM baseline_table GROUP BY 1",
)
def baseline_summary(p):
    return rounded(audits.baseline_summary(baseline_table(p)), 5)


BASE0 = {"prior_route_airline_dud_market_median": "temporal_market_median_price", "previous_same_schedule_carry_forward": "previous_price_same_schedule"}
view("base0", " UNION ALL ".join(f"SELECT CAST(price_vnd AS DOUBLE) AS y, '{n}' AS baseline, CAST({c} AS DOUBLE) AS pred FROM featured" for n, c in BASE0.items()))


@query("baseline_current", baseline_sql("baseline", "base0", "y", "pred", "baseline"))
def baseline_current(p):
    out = audits.baseline_matrix(p.feature_table, "price_vnd", BASE0, [])
    return out.select("baseline", "eligible_rows", r("coverage_pct", 6), r("mae_vnd", 4), r("mape_pct", 6), r("r2", 6))


@query(
    "prevalence_baseline",
    f"""WITH c AS (SELECT fold, target_dud, sum(drop_5pct) AS k, count(*) AS n FROM split_rows WHERE role = 'TRAIN' GROUP BY ALL),
o AS (SELECT fold, sum(k) / CAST(sum(n) AS DOUBLE) AS overall, CAST(sum(n) AS BIGINT) AS train_rows FROM c GROUP BY 1),
v AS (SELECT s.fold, s.drop_5pct AS y, o.overall, o.train_rows, coalesce(c.k / CAST(c.n AS DOUBLE), o.overall) AS rate FROM split_rows s LEFT JOIN c USING (fold, target_dud) JOIN o USING (fold) WHERE role = 'VALID'),
l AS (SELECT fold, train_rows, y, 'past_overall_prevalence' AS baseline, overall AS p FROM v UNION ALL SELECT fold, train_rows, y, 'past_target_dud_prevalence', rate FROM v),
h AS (SELECT fold, baseline, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY ALL),
a AS (SELECT fold, baseline, sum(pos / np * (tp / cn)) AS pr_auc FROM (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY fold, baseline) AS np
FROM h WINDOW w AS (PARTITION BY fold, baseline ORDER BY p DESC)) GROUP BY ALL)
SELECT fold, baseline, max(train_rows) AS train_rows, count(*) AS validation_rows, {rsql('avg(y)', 'validation_prevalence')}, {rsql('max(pr_auc)', 'pr_auc')},
{rsql('max(pr_auc) - avg(y)', 'lift')} FROM l JOIN a USING (fold, baseline) GROUP BY fold, baseline""",
)
def prevalence_baseline(p):
    return rounded(audits.prevalence_baseline(split(p)))


# --- drift ----------------------------------------------------------------------------------

LADDER = {
    "RAW": [],
    "ROUTE_AIRLINE_DUD": ["route", "airline", "days_until_departure"],
    "PLUS_PERIOD": ["route", "airline", "days_until_departure", "departure_period"],
    "PLUS_MONTH": ["route", "airline", "days_until_departure", "departure_period", "flight_month"],
    "PLUS_WEEKDAY": ["route", "airline", "days_until_departure", "departure_period", "flight_month", "flight_weekday"],
}
view(
    "periods",
    f"""SELECT o.*, {band('departure_minute', C.DEPARTURE_PERIODS)} AS departure_period, strftime(flight_date, '%Y-%m') AS flight_month,
CAST(isodow(flight_date) - 1 AS INTEGER) AS flight_weekday, CASE WHEN session_date < (SELECT d[len(d) // 2 + 1] FROM (SELECT list_sort(list(DISTINCT session_date)) AS d FROM offers))
THEN 'EARLY' ELSE 'LATE' END AS period FROM offers o""",
)


def ladder_sql(stage: str, keys: list[str]) -> str:
    group = ", ".join(keys) or "'ALL'"
    return f"""SELECT '{stage}' AS stage, count(*) AS matched_cells, 100e0 * avg(CAST(c < 0 AS DOUBLE)) AS share_cells_declining_pct,
sum(c * w) / sum(w) AS weighted_mean_cell_change_pct, quantile_cont(c, 0.5) AS median_cell_change_pct FROM (SELECT 100e0 * (l / e - 1) AS c, w FROM (
SELECT median(CASE WHEN period = 'EARLY' THEN price_vnd END) AS e, median(CASE WHEN period = 'LATE' THEN price_vnd END) AS l,
CAST(least(count(*) FILTER (period = 'EARLY'), count(*) FILTER (period = 'LATE')) AS DOUBLE) AS w FROM periods GROUP BY {group}) WHERE e IS NOT NULL AND l IS NOT NULL)"""


def periods(p):
    df = with_departure_period(audits.with_period(p.offers))
    return df.withColumn("flight_month", F.date_format("flight_date", "yyyy-MM")).withColumn("flight_weekday", F.weekday("flight_date"))


SHIFT = "stage, matched_cells, " + ", ".join(rsql(c, c, 6) for c in ("share_cells_declining_pct", "weighted_mean_cell_change_pct", "median_cell_change_pct"))


@query("matched_cell_shift", f"SELECT {SHIFT} FROM ({ladder_sql('ROUTE_AIRLINE_DUD', LADDER['ROUTE_AIRLINE_DUD'])})")
def matched_cell_shift(p):
    return rounded(audits.matched_shift(audits.with_period(p.offers), LADDER["ROUTE_AIRLINE_DUD"], "ROUTE_AIRLINE_DUD"), 6)


@query(
    "shift_decomposition",
    f"""WITH t AS ({' UNION ALL '.join(ladder_sql(s, k) for s, k in LADDER.items())})
SELECT {SHIFT}, {rsql("100e0 * (1 - abs(median_cell_change_pct) / (SELECT abs(median_cell_change_pct) FROM t WHERE stage = 'RAW'))", 'explained_share_pct', 6)} FROM t""",
)
def shift_decomposition(p):
    return rounded(audits.shift_ladder(periods(p), LADDER), 6)


DIMS = ["airline", "route", "days_until_departure", "flight_month"]


@query(
    "composition_shift",
    f"""WITH x AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, period FROM periods" for d in DIMS)}),
c AS (SELECT dimension, level, count(*) FILTER (period = 'EARLY') AS e, count(*) FILTER (period = 'LATE') AS l FROM x GROUP BY ALL),
d AS (SELECT dimension, level, 100e0 * (l / CAST(sum(l) OVER (PARTITION BY dimension) AS DOUBLE) - e / CAST(sum(e) OVER (PARTITION BY dimension) AS DOUBLE)) AS delta FROM c)
SELECT dimension, {rsql('abs(delta)', 'max_absolute_share_shift_pp', 7)}, level AS level_with_largest_shift, {rsql('delta', 'signed_shift_pp', 7)} FROM (
SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(delta) DESC, level DESC) AS rn FROM d) WHERE rn = 1""",
)
def composition_shift(p):
    return rounded(audits.composition_shift(periods(p), DIMS), 7)


@query(
    "collection_stability",
    """SELECT session_date, session_label, count(*) AS offer_rows, count(DISTINCT route) AS routes, count(DISTINCT airline) AS airlines,
count(DISTINCT days_until_departure) AS booking_windows, count(DISTINCT route || '|' || days_until_departure) AS route_dud_queries FROM offers GROUP BY ALL""",
)
def collection_stability(p):
    return audits.collection_stability(p.offers)


AVAILABLE = ["temporal_market_median_price", "temporal_market_support", "temporal_market_age_hours", "prior_market_change_pct_per_day",
             "previous_price_same_schedule", "prior_price_trend_vnd_per_dud_day", "prior_price_volatility_vnd", "lag_age_hours"]
WARM = [c for c in AVAILABLE if c.startswith(("previous_", "prior_price_", "lag_age"))]


@query(
    "feature_availability",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {rsql(f'100e0 * count({c}) / count(*)', 'all_rows_available_pct')}, {str(c in WARM).upper()} AS warm_only FROM featured" for c in AVAILABLE),
)
def feature_availability(p):
    return rounded(audits.availability(p.feature_table, AVAILABLE))


CORR = ["price_vnd", "days_until_departure", "departure_minute", "temporal_market_median_price", "previous_price_same_schedule"]
PAIRS = [(a, b) for i, a in enumerate(sorted(CORR)) for b in sorted(CORR)[i + 1 :]]


@query(
    "pearson_pairs",
    """SELECT feature_left, feature_right, rows, round(c, 7) + 0e0 AS pearson, CASE WHEN abs(c) >= 0.95 THEN 'NEAR_DUPLICATE' WHEN abs(c) >= 0.8 THEN 'REVIEW'
WHEN c IS NOT NULL THEN 'DISTINCT' ELSE 'UNAVAILABLE' END AS review_band FROM ("""
    + " UNION ALL ".join(f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, count(*) AS rows, corr({a}, {b}) AS c FROM featured WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)
    + ")",
)
def pearson_pairs(p):
    return rounded(audits.pearson_pairs(p.feature_table, CORR), 7)


SPEAR = ["price_vnd", "days_until_departure", "temporal_market_median_price", "previous_price_same_schedule"]
SPAIRS = [(a, b) for i, a in enumerate(sorted(SPEAR)) for b in sorted(SPEAR)[i + 1 :]]
RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"


@query(
    "spearman_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, count(*) AS rows, {rsql('corr(x, y)', 'spearman', 7)} FROM (SELECT {RANK.format(c=a)} AS x, {RANK.format(c=b)} AS y "
        f"FROM featured WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in SPAIRS
    ),
)
def spearman_pairs(p):
    return rounded(audits.spearman_pairs(p.featured_once, SPEAR), 7)


EVENT_FLAG = "CAST(price_vnd - target_price_vnd >= least(CAST(price_vnd AS DOUBLE) * 0.05e0, 50000e0) AS DOUBLE)"


@query(
    "frame_summary",
    f"""SELECT 'offers' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM featured
UNION ALL SELECT 'offers', 'anchor_coverage', round(count(anchor_vnd) / CAST(count(*) AS DOUBLE), 8) FROM featured
UNION ALL SELECT 'offers', 'relative_history_eligible_rate', round(avg(relative_history_eligible), 8) FROM featured
UNION ALL SELECT 'anchor_source', anchor_source, CAST(count(*) AS DOUBLE) FROM featured GROUP BY anchor_source
UNION ALL SELECT 'events', 'rows', CAST(count(*) AS DOUBLE) FROM exact_pairs
UNION ALL SELECT 'events', 'prevalence', round(avg({EVENT_FLAG}), 8) FROM exact_pairs
UNION ALL SELECT 'transition', transition, CAST(count(*) AS DOUBLE) FROM exact_pairs GROUP BY transition
UNION ALL SELECT 'event_label_status', event_label_status, CAST(count(*) AS DOUBLE) FROM event_states GROUP BY event_label_status
UNION ALL SELECT 'exact_status', exact_status, CAST(count(*) AS DOUBLE) FROM event_states GROUP BY exact_status""",
)
def frame_summary(p):
    events = pairs.attach_events(p.exact_pairs, C.EVENT_DEFINITIONS_MIN)
    return rounded(audits.frame_summary(p.featured_once, events, registry_frame(p)))


# --- folds ----------------------------------------------------------------------------------


def warm_split(p):
    return split(p).withColumn("is_warm", (F.col("p_drop") >= 0.5).cast("int"))


@query(
    "fold_structure",
    f"""WITH c AS (SELECT fold, current_dud, target_dud, count(*) FILTER (role = 'TRAIN') AS tn, count(*) FILTER (role = 'VALID') AS vn,
count(*) FILTER (role = 'VALID' AND p_drop >= 0.5e0) AS vw, sum(CASE WHEN role = 'VALID' THEN drop_5pct END) AS vk,
max(CASE WHEN role = 'TRAIN' THEN label_time END) AS tl, max(fold_start) AS fs FROM split_rows GROUP BY ALL)
SELECT fold, CAST(sum(tn) AS BIGINT) AS train_rows, CAST(sum(vn) AS BIGINT) AS validation_rows, count(*) FILTER (tn >= 100) AS supported_cells,
count(*) FILTER (tn > 0) AS observed_cells, {rsql('100e0 * sum(vw) / sum(vn)', 'validation_warm_pct')}, {rsql('100e0 * sum(vk) / sum(vn)', 'validation_prevalence_pct')},
max(tl) AS max_training_label_time, max(tl) < max(fs) AS label_time_purge_pass FROM c GROUP BY fold""",
)
def fold_structure(p):
    return rounded(audits.fold_structure(warm_split(p)))


@query(
    "common_transitions",
    f"""SELECT current_dud, target_dud, count(DISTINCT fold) AS folds FROM split_rows WHERE role = 'VALID' GROUP BY ALL HAVING count(DISTINCT fold) = {len(FOLDS)}""",
)
def common_transitions(p):
    return audits.common_cells(split(p), len(FOLDS))


@query(
    "pit_violations",
    """SELECT count(*) AS rows, count(*) FILTER (previous_schedule_time >= feature_time) AS history_not_prior,
count(*) FILTER (temporal_market_time >= feature_time) AS market_not_prior, count(*) FILTER (previous_schedule_session_key = session_key) AS same_batch_history,
count(*) FILTER (previous_schedule_collection_era <> collection_era) AS cross_era_history,
count(*) FILTER (temporal_market_collection_era <> collection_era) AS cross_era_market FROM featured""",
)
def pit_violations(p):
    return quality.pit_violations(p.feature_table)


GATE_PART = """SELECT '{task}' AS task, '{window}' AS training_window, fold, part, count(*) AS rows, max(label_time) AS max_label_time,
max(label_time) < CAST(DATE '{cut}' + 1 AS TIMESTAMP) AS inside_cutoff FROM ({source}) WHERE part IS NOT NULL GROUP BY fold, part"""


def inner_source(split_view: str, time: str, reserve: str, minimum: str, fit: str, window: str) -> str:
    return f"""SELECT *, CASE WHEN {fit} THEN 'FIT' WHEN {time} >= origin THEN 'HEAD' END AS part FROM (SELECT * FROM {split_view} WHERE role = 'TRAIN' {window}) JOIN (
SELECT fold, CAST(d AS TIMESTAMP) AS origin FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY d DESC) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM (
SELECT fold, CAST({time} AS DATE) AS d FROM {split_view} WHERE role = 'TRAIN' {window} GROUP BY ALL)) WHERE {minimum} AND rn = {reserve}) USING (fold)"""


CLASS_R = "least(greatest(6, CAST(ceil(n * 0.15e0) AS BIGINT)), n - 10)"
REG_R = "least(greatest(10, least(21, CAST(ceil(n * 0.15e0) AS BIGINT))), n - 10)"


@query(
    "frame_gate",
    " UNION ALL ".join(
        GATE_PART.format(task=t, window=w, cut=CUTOFF, source=inner_source(v, tm, rs, mn, fit, win))
        for t, w, v, tm, rs, mn, fit, win in (
            ("CLASSIFICATION", "EXPANDING", "split_rows", "feature_time", CLASS_R, "n >= 16", "feature_time < origin AND label_time < origin", ""),
            ("REGRESSION", "EXPANDING", "split_rows_label", "label_time", REG_R, "n >= 17", "label_time < origin", ""),
            ("REGRESSION", "RECENT28", "split_rows_label", "label_time", REG_R, "n >= 17", "label_time < origin", "AND label_time >= fold_start - INTERVAL 28 DAY"),
        )
    ),
)
def frame_gate(p):
    reg = split(p, "REGRESSION").where("role = 'TRAIN'")
    frames = {
        "CLASSIFICATION/EXPANDING": splits.inner_split(split(p).where("role = 'TRAIN'")),
        "REGRESSION/EXPANDING": splits.inner_split(reg, mode="REGRESSION"),
        "REGRESSION/RECENT28": splits.inner_split(splits.apply_window(reg, 28, "label_time"), mode="REGRESSION"),
    }
    return audits.frame_gate(frames, CUTOFF)


# --- reports --------------------------------------------------------------------------------

SPINE = """(SELECT CAST(d AS DATE) AS session_date FROM range((SELECT min(session_date) FROM offers), (SELECT max(session_date) FROM offers) + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d))"""


@query(
    "offer_volume",
    f"""SELECT session_date, v.fli_library_era, v.trip_com_browser_era, v.fli_library_era IS NULL AS is_missing FROM {SPINE} LEFT JOIN (SELECT session_date,
count(*) FILTER (collection_era = '{C.FLI_ERA}') AS fli_library_era, count(*) FILTER (collection_era = '{C.TRIP_ERA}') AS trip_com_browser_era FROM offers GROUP BY 1) v USING (session_date)""",
)
def offer_volume(p):
    return audits.offer_volume(p.offers)


@query(
    "fare_index",
    f"""WITH r AS (SELECT session_date, ln(price_vnd / median(price_vnd) OVER (PARTITION BY route, airline, days_until_departure, session_label)) AS z FROM offers),
d AS (SELECT session_date, 100e0 * exp(quantile_cont(z, 0.5)) AS v FROM r GROUP BY 1), s AS (SELECT session_date, v FROM {SPINE} LEFT JOIN d USING (session_date))
SELECT session_date, {rsql('v', 'fare_index', 6)}, round(CASE WHEN count(v) OVER w >= 3 THEN quantile_cont(v, 0.5) OVER w END, 6) AS fare_index_smooth FROM s
WINDOW w AS (ORDER BY session_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def fare_index(p):
    return rounded(audits.fare_index(p.offers), 6)


AIR = ", ".join(f"('{a}')" for a in C.AIRLINES)


@query(
    "airline_drift",
    f"""WITH c AS (SELECT session_date, airline, count(*) AS rows, quantile_cont(current_relative_log, 0.5) AS z FROM anchored GROUP BY ALL),
a AS (SELECT session_date, sum(rows) AS n FROM c GROUP BY 1),
g AS (SELECT s.session_date, x.airline, c.rows, CASE WHEN c.rows >= 100 THEN c.z END AS drift, CASE WHEN a.n IS NOT NULL THEN 100e0 * coalesce(c.rows, 0) / a.n END AS share_pct
FROM {SPINE} s CROSS JOIN (VALUES {AIR}) x(airline) LEFT JOIN c ON c.session_date = s.session_date AND c.airline = x.airline LEFT JOIN a ON a.session_date = s.session_date)
SELECT session_date, airline, rows, {rsql('drift', 'drift')}, {rsql('share_pct', 'share_pct')}, round(CASE WHEN drift IS NOT NULL AND count(drift) OVER w >= 3 THEN quantile_cont(drift, 0.5) OVER w END, 8) + 0e0 AS drift_smooth
FROM g WINDOW w AS (PARTITION BY airline ORDER BY session_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def airline_drift(p):
    return rounded(audits.airline_drift(p.anchored, min_support=100))


@query(
    "ape_by_dud",
    "SELECT days_until_departure, count(*) AS rows, "
    + ", ".join(rsql(f"quantile_cont(abs(pred_vnd - price_vnd) / CAST(price_vnd AS DOUBLE), {q})", n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))
    + " FROM offers GROUP BY 1",
)
def ape_by_dud(p):
    return rounded(audits.ape_by(p.offers, "days_until_departure"))


@query(
    "density_bins",
    """WITH l AS (SELECT quantile_cont(v, 0.999) AS lim FROM (SELECT price_vnd AS v FROM offers UNION ALL SELECT pred_vnd FROM offers))
SELECT CAST(floor(price_vnd * 43 / lim) AS INTEGER) AS x_bin, CAST(floor(pred_vnd * 43 / lim) AS INTEGER) AS y_bin, count(*) AS rows FROM offers, l
WHERE price_vnd < lim AND pred_vnd < lim GROUP BY 1, 2""",
)
def density_bins(p):
    return audits.density2d(p.offers, "price_vnd", "pred_vnd")


@query(
    "prediction_catalog",
    """SELECT route, string_agg(airline, ',' ORDER BY airline) AS airlines, count(*) AS airline_count, CAST(sum(n) AS BIGINT) AS offers
FROM (SELECT route, airline, count(*) AS n FROM offers GROUP BY ALL) GROUP BY route""",
)
def prediction_catalog(p):
    return serving.prediction_catalog(p.offers)


SLICES = {"REGIME": "regime", "HISTORY_SUPPORT": "history_support_band", "COLLECTION_ERA": "collection_era", "MARKET_GROUP": "market_group",
          "ANCHOR_SOURCE": "anchor_source", "ANCHOR_SUPPORT": "anchor_support_band", "AIRLINE": "airline", "TARGET_DUD": "days_until_departure",
          "TARGET_SESSION": "session_label", "ROUTE_AIRLINE": "route_airline", "MOVEMENT": "actual_movement_band"}
view(
    "sliced",
    f"""SELECT *, CASE WHEN prior_relative_count >= 3 THEN 'WARM' ELSE 'COLD' END AS regime, {band('coalesce(prior_relative_count, 0)', C.HISTORY_BANDS)} AS history_support_band,
{MARKET} AS market_group, {band('coalesce(peer_anchor_support, 0)', C.PEER_SUPPORT_BANDS)} AS anchor_support_band, route || '|' || airline AS route_airline,
CASE WHEN previous_price_same_schedule IS NULL THEN 'NO_LEGAL_CARRY' WHEN mv <= -0.10e0 THEN 'DROP_GE_10PCT' WHEN mv <= -0.05e0 THEN 'DROP_5_10PCT' WHEN abs(mv) <= 0.01e0 THEN 'STABLE_LE_1PCT'
WHEN mv < 0.05e0 THEN 'MILD_WITHIN_5PCT' WHEN mv < 0.10e0 THEN 'RISE_5_10PCT' ELSE 'RISE_GE_10PCT' END AS actual_movement_band
FROM (SELECT *, price_vnd / previous_price_same_schedule - 1 AS mv FROM featured)""",
)


def slice_sql(name: str, value: str, group: str) -> str:
    t, e = "CAST(price_vnd AS DOUBLE)", "abs(CAST(price_vnd AS DOUBLE) - pred_vnd)"
    return f"""SELECT '{name}' AS slice_type, {value} AS slice_value, count(*) AS support, {rsql(f'avg({e})', 'mae_vnd', 4)}, {rsql(f'avg({e} / {t})', 'mape')},
{rsql(f'sum({e}) / sum({t})', 'wmape')}, {rsql(f'CASE WHEN var_pop({t}) > 0 THEN 1 - sum({e} * {e}) / (var_pop({t}) * count(*)) END', 'r2', 7)}, count(DISTINCT schedule_slot_id) AS schedule_slots
FROM sliced {group}"""


@query(
    "slice_metrics",
    slice_sql("OVERALL", "'ALL'", "") + " UNION ALL " + " UNION ALL ".join(slice_sql(n, f"CAST({c} AS VARCHAR)", f"GROUP BY {c}") for n, c in SLICES.items()),
)
def slice_metrics(p):
    legal = F.col("previous_price_same_schedule").isNotNull()
    df = serving.with_bands(p.feature_table).withColumn(
        "actual_movement_band", K.movement_band("price_vnd", "previous_price_same_schedule", legal)
    )
    out = audits.slice_metrics(df, SLICES, "price_vnd", "pred_vnd")
    return out.select("slice_type", "slice_value", "support", r("mae_vnd", 4), r("mape", 8), r("wmape", 8), r("r2", 7), "schedule_slots")


SESSION_SLICES = {"ERA_TRANSITION": "source_target_era_transition", "SESSION_TRANSITION": "session_transition", "SESSION_GAP": "session_gap_band",
                  "COVERAGE_BAND": "coverage_band", "SUPPORT_TIER": "support_tier", "ROUTE_AIRLINE_SUPPORT": "route_airline_support_band",
                  "ANCHOR_AGE": "anchor_age_band", "DUD_SUPPORT": "dud_support_mode"}
GAP = hours("st", "feature_time")
view(
    "session_rows",
    f"""SELECT o.*, {band(GAP, C.SESSION_GAP_BANDS)} AS session_gap_band, {band(GAP, C.ANCHOR_AGE_BANDS)} AS anchor_age_band, sl || '->' || session_label AS session_transition,
se || '->' || collection_era AS source_target_era_transition, 'ON_GRID' AS dud_support_mode
FROM timed o JOIN (SELECT session_key, lag(t) OVER w AS st, lag(l) OVER w AS sl, lag(e) OVER w AS se FROM (
SELECT session_key, min(feature_time) AS t, min(session_label) AS l, min(collection_era) AS e FROM timed GROUP BY 1) WINDOW w AS (ORDER BY t, session_key)) s USING (session_key) WHERE st IS NOT NULL""",
)
view("session_cells", "SELECT fold, route, airline, count(*) AS n FROM session_rows, fold_table WHERE feature_time < fold_start GROUP BY ALL")
view(
    "session_slices",
    f"""SELECT v.*, {band('coalesce(n, 0)', C.ANCHOR_SUPPORT_BANDS)} AS route_airline_support_band,
CASE WHEN a >= 5 THEN 'UNIVERSAL_5' WHEN a = 4 THEN 'BROAD_4_5' WHEN a >= 2 THEN 'MID_2_3' WHEN a = 1 THEN 'SINGLE_1' ELSE 'UNOBSERVED_0' END AS coverage_band,
CASE WHEN a >= 4 THEN 'HIGH_SUPPORT' ELSE 'LOWER_SUPPORT' END AS support_tier
FROM (SELECT s.*, f.fold FROM session_rows s, fold_table f WHERE feature_time >= fold_start AND feature_time < fold_end) v
LEFT JOIN session_cells c USING (fold, route, airline) LEFT JOIN (SELECT fold, route, count(*) AS a FROM session_cells GROUP BY ALL) r USING (fold, route)""",
)


def fold_slice_sql(name: str, value: str) -> str:
    group = ", ".join(["fold"] + ([value] if not value.startswith("'") else []))
    return slice_sql(name, value if value.startswith("'") else f"CAST({value} AS VARCHAR)", f"GROUP BY {group}").replace("SELECT", "SELECT fold,", 1).replace("FROM sliced", "FROM session_slices")


def session_slices(p):
    """Validation rows of the fold calendar, tagged by what their fold's training rows cover."""
    return splits.fold_tags(splits.outer_split(audits.session_frame(p.timed), FOLDS, "REGRESSION"))


def slice_out(out, *more):
    return out.select(*more, "support", r("mae_vnd", 4), r("mape", 8), r("wmape", 8), r("r2", 7), "schedule_slots")


@query("slice_metrics_sessions", " UNION ALL ".join(fold_slice_sql(n, c) for n, c in {"OVERALL": "'ALL'", **SESSION_SLICES}.items()))
def slice_metrics_sessions(p):
    out = audits.slice_metrics(session_slices(p), SESSION_SLICES, "price_vnd", "pred_vnd", by=["fold"])
    return slice_out(out, "fold", "slice_type", "slice_value")


@query("fare_metrics", f"SELECT * EXCLUDE (slice_type, slice_value) FROM ({fold_slice_sql('OVERALL', chr(39) + 'ALL' + chr(39))})")
def fare_metrics(p):
    return slice_out(audits.slice_metrics(session_slices(p), {}, "price_vnd", "pred_vnd", by=["fold"]), "fold")
