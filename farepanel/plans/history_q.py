"""Queries over strictly prior windows, event lanes and history arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.operators import history, market, splits
from farepanel.operators.scale import average_rank, with_rank
from farepanel.plans.panel_views import CHANGE, MARKET_LAGS, band, hours
from farepanel.plans.registry import query, view


# Slopes are ratios of integers and often lie exactly between two decimals, where engines round
# apart; both sides are shifted off those halves by the same amount.
OFF_HALF = 1.7e-5


def r(column: str, digits: int = 9, shift: float = 0.0):
    """Rounded without a negative zero."""
    value = F.col(column) + shift if shift else F.col(column)
    return (F.round(value, digits) + 0.0).alias(column)


@query("batch_feature_time", "SELECT offer_id, feature_time, batch_offer_count FROM timed")
def batch_feature_time(p):
    return p.timed.select("offer_id", "feature_time", "batch_offer_count")


view(
    "mkt_era",
    f"""SELECT *, {CHANGE} FROM (SELECT collection_era, route, airline, days_until_departure, session_key, {MARKET_LAGS}
FROM (SELECT collection_era, route, airline, days_until_departure, session_key, median(price_vnd) AS market_price,
count(*) AS market_support, max(feature_time) AS market_time, any_value(collection_era) AS market_era FROM timed GROUP BY ALL)
WINDOW w AS (PARTITION BY collection_era, route, airline, days_until_departure ORDER BY market_time, session_key))""",
)
MARKET_OUT = "offer_id, temporal_market_median_price, temporal_market_support, temporal_market_time, temporal_market_collection_era"


@query(
    "market_anchor",
    f"""SELECT {MARKET_OUT}, round({hours('temporal_market_time', 'feature_time')}, 9) AS temporal_market_age_hours
FROM timed JOIN mkt_era USING (collection_era, route, airline, days_until_departure, session_key)""",
)
def market_anchor(p):
    return market.market_anchor(p.timed).select(*MARKET_OUT.split(", "), r("temporal_market_age_hours"))


@query(
    "market_direction",
    """SELECT offer_id, round(prior_market_change_pct_per_day, 7) + 0e0 AS prior_market_change_pct_per_day,
CAST(prior_market_change_pct_per_day IS NOT NULL AS INTEGER) AS has_prior_market_change
FROM timed JOIN mkt_era USING (collection_era, route, airline, days_until_departure, session_key)""",
)
def market_direction(p):
    return market.market_anchor(p.timed).select("offer_id", r("prior_market_change_pct_per_day", 7), "has_prior_market_change")


@query("market_anchor_cross_era", f"SELECT {MARKET_OUT}, round(prior_market_change_pct_per_day, 7) + 0e0 AS prior_market_change_pct_per_day FROM mkt_joined")
def market_anchor_cross_era(p):
    return market.market_anchor(p.timed, by_era=False).select(*MARKET_OUT.split(", "), r("prior_market_change_pct_per_day", 7))


ERA_P = "PARTITION BY collection_era, schedule_slot_id ORDER BY feature_time, session_key"
view(
    "era_history",
    f"""SELECT *, row_number() OVER w - 1 AS cnt, lag(price_vnd) OVER w AS prev_price, lag(feature_time) OVER w AS prev_time,
lag(session_key) OVER w AS prev_key, lag(session_label) OVER w AS prev_label,
CASE WHEN row_number() OVER w > 2 THEN stddev_pop(price_vnd) OVER p END AS vol,
CASE WHEN row_number() OVER w > 2 AND min(days_until_departure) OVER p < max(days_until_departure) OVER p
THEN regr_slope(price_vnd, days_until_departure) OVER p END AS slope FROM timed
WINDOW w AS ({ERA_P}), p AS ({ERA_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)


def era_history(p):
    return history.schedule_history(p.timed, relative=False)


@query(
    "schedule_history",
    f"""SELECT offer_id, CAST(cnt AS INTEGER) AS prior_observation_count, prev_price AS previous_price_same_schedule,
prev_time AS previous_schedule_time, prev_key AS previous_schedule_session_key, prev_label AS previous_schedule_session_label,
round({hours('prev_time', 'feature_time')}, 9) AS lag_age_hours FROM era_history""",
)
def schedule_history(p):
    return era_history(p).select(
        "offer_id", "prior_observation_count", "previous_price_same_schedule", "previous_schedule_time",
        "previous_schedule_session_key", "previous_schedule_session_label", r("lag_age_hours"),
    )


@query("prior_volatility", "SELECT offer_id, round(vol, 3) + 0e0 AS prior_price_volatility_vnd FROM era_history")
def prior_volatility(p):
    return era_history(p).select("offer_id", r("prior_price_volatility_vnd", 3))


@query("prior_trend", "SELECT offer_id, round(slope + 1.7e-5, 3) + 0e0 AS prior_price_trend_vnd_per_dud_day FROM era_history")
def prior_trend(p):
    return era_history(p).select("offer_id", r("prior_price_trend_vnd_per_dud_day", 3, OFF_HALF))


REL = "PARTITION BY collection_era, schedule_slot_id ORDER BY feature_time, session_key"
view(
    "anchored_era0",
    """SELECT l.* EXCLUDE (temporal_market_median_price, temporal_market_support, temporal_market_time, temporal_market_collection_era,
prior_market_change_pct_per_day, temporal_market_age_hours), m.temporal_market_median_price AS mmed, m.temporal_market_time AS mtime,
m.temporal_market_collection_era AS mera
FROM loo l JOIN mkt_era m USING (collection_era, route, airline, days_until_departure, session_key)""",
)
view(
    "anchored_era",
    """SELECT *, ln(price_vnd / anchor_vnd) AS current_relative_log FROM (SELECT *,
CASE WHEN peer_anchor_support >= 3 THEN peer_anchor_vnd WHEN mmed > 0 AND mtime < feature_time AND mera = collection_era THEN mmed
WHEN peer_anchor_support >= 1 THEN peer_anchor_vnd END AS anchor_vnd FROM anchored_era0)""",
)


@query(
    "relative_history",
    f"""SELECT offer_id, count(current_relative_log) OVER p AS prior_relative_count,
round(lag(current_relative_log) OVER w, 9) + 0e0 AS previous_relative_log, lag(anchor_vnd) OVER w AS previous_anchor_vnd,
round(CASE WHEN count(current_relative_log) OVER p >= 2 THEN stddev_pop(current_relative_log) OVER p END, 7) + 0e0 AS prior_relative_volatility,
round(CASE WHEN count(current_relative_log) OVER p >= 2 AND min(CASE WHEN current_relative_log IS NOT NULL THEN days_until_departure END) OVER p
 < max(CASE WHEN current_relative_log IS NOT NULL THEN days_until_departure END) OVER p
 THEN regr_slope(current_relative_log, days_until_departure) OVER p END, 7) + 0e0 AS prior_relative_trend_per_dud_day,
round(ln(anchor_vnd) - ln(lag(anchor_vnd) OVER w), 9) + 0e0 AS market_shift_log,
CAST(count(current_relative_log) OVER p >= 3 AS INTEGER) AS relative_history_eligible FROM anchored_era
WINDOW w AS ({REL}), p AS ({REL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def relative_history(p):
    df = history.schedule_history(market.peer_anchor(market.market_anchor(p.timed)))
    return df.select(
        "offer_id", "prior_relative_count", r("previous_relative_log"), "previous_anchor_vnd",
        r("prior_relative_volatility", 7), r("prior_relative_trend_per_dud_day", 7), r("market_shift_log"),
        "relative_history_eligible",
    )


@query(
    "schedule_history_cross_era",
    """SELECT offer_id, CAST(prior_observation_count AS INTEGER) AS prior_observation_count, previous_price_same_schedule,
previous_schedule_collection_era, round(prior_price_volatility_vnd, 3) + 0e0 AS prior_price_volatility_vnd,
round(prior_price_trend_vnd_per_dud_day + 1.7e-5, 3) + 0e0 AS prior_price_trend_vnd_per_dud_day, prior_relative_count,
round(prior_relative_volatility, 7) + 0e0 AS prior_relative_volatility,
round(prior_relative_trend_per_dud_day, 7) + 0e0 AS prior_relative_trend_per_dud_day FROM featured""",
)
def schedule_history_cross_era(p):
    return p.featured.select(
        "offer_id", "prior_observation_count", "previous_price_same_schedule", "previous_schedule_collection_era",
        r("prior_price_volatility_vnd", 3), r("prior_price_trend_vnd_per_dud_day", 3, OFF_HALF), "prior_relative_count",
        r("prior_relative_volatility", 7), r("prior_relative_trend_per_dud_day", 7),
    )


TPL = "PARTITION BY route, airline, departure_minute ORDER BY t, session_key"


@query(
    "template_history",
    f"""SELECT route, airline, departure_minute, session_key, round(lag(z) OVER w, 9) + 0e0 AS template_previous_relative_log,
lag(t) OVER w AS template_previous_time, CAST(coalesce(sum(n) OVER p, 0) AS BIGINT) AS template_history_support_count,
round(CASE WHEN row_number() OVER w > 2 THEN stddev_pop(z) OVER p END, 7) + 0e0 AS template_prior_relative_volatility,
round(CASE WHEN row_number() OVER w > 2 AND min(CASE WHEN z IS NOT NULL THEN x END) OVER p < max(CASE WHEN z IS NOT NULL THEN x END) OVER p
 THEN regr_slope(z, x) OVER p END, 7) + 0e0 AS template_prior_relative_trend_per_dud_day
FROM (SELECT route, airline, departure_minute, session_key, median(current_relative_log) AS z, count(*) AS n, max(feature_time) AS t,
median(days_until_departure) AS x FROM anchored GROUP BY ALL)
WINDOW w AS ({TPL}), p AS ({TPL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def template_history(p):
    return history.template_history(p.anchored).select(
        "route", "airline", "departure_minute", "session_key", r("template_previous_relative_log"), "template_previous_time",
        "template_history_support_count", r("template_prior_relative_volatility", 7),
        r("template_prior_relative_trend_per_dud_day", 7),
    )


view(
    "lane",
    f"""SELECT collection_era, route, airline, {band('days_until_departure', C.DUD_BUCKETS)} AS booking_window_bucket, session_key,
max(feature_time) AS event_time, median(price_vnd) AS median_price, count(*) AS support FROM timed GROUP BY ALL""",
)
LANE = ["collection_era", "route", "airline", "booking_window_bucket"]
view(
    "lane_gaps",
    f"""SELECT *, row_number() OVER w - 1 AS prior_events, {hours('lag(event_time) OVER w', 'event_time')} AS gap_hours FROM lane
WINDOW w AS (PARTITION BY {', '.join(LANE)} ORDER BY event_time, session_key)""",
)


@query("market_event_lane", "SELECT * FROM lane")
def market_event_lane(p):
    return market.market_event_lane(p.timed)


@query(
    "sequence_gaps",
    "SELECT count(*) AS events, "
    + ", ".join(f"round(count(*) FILTER (prior_events >= {n}) * 100e0 / count(*), 9) AS eligible_{n}_pct" for n in (7, 14, 21))
    + """, count(*) FILTER (gap_hours > 0) AS positive_gaps, count(*) FILTER (gap_hours <= 0) AS nonpositive_gaps,
round(max(CASE WHEN gap_hours > 0 THEN gap_hours END), 9) AS max_gap_hours,
round(quantile_cont(CASE WHEN gap_hours > 0 THEN gap_hours END, 0.5), 9) AS gap_p50,
round(quantile_cont(CASE WHEN gap_hours > 0 THEN gap_hours END, 0.9), 9) AS gap_p90,
round(quantile_cont(CASE WHEN gap_hours > 0 THEN gap_hours END, 0.95), 9) AS gap_p95 FROM lane_gaps""",
)
def sequence_gaps(p):
    out = history.sequence_summary(history.sequence_gaps(market.market_event_lane(p.timed), LANE))
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 9) for c in doubles})


view(
    "states0",
    """SELECT route || '|' || airline || '|' || departure_minute || '|' || days_until_departure // 7 AS "group", session_key, max(feature_time) AS event_time,
median(ln(price_vnd / coalesce(temporal_market_median_price, anchor_vnd, price_vnd))) AS f_relative_log, median(ln(CAST(price_vnd AS DOUBLE))) AS f_log_price,
median(days_until_departure / 60e0) AS f_dud, median(ln(1e0 + coalesce(temporal_market_support, 0))) AS f_support_log,
median(ln(1e0 + batch_offer_count)) AS f_batch_log FROM anchored GROUP BY ALL""",
)
view(
    "states",
    f"""SELECT *, ln(1 + least(coalesce({hours('lag(event_time) OVER w', 'event_time')}, 0e0), {C.SEQUENCE_GAP_CLIP_HOURS})) AS f_gap_log
FROM states0 WINDOW w AS (PARTITION BY "group" ORDER BY event_time, session_key)""",
)


STATE_ROWS = [
    "offer_id", "schedule_slot_id", "session_key", "feature_time", "route", "airline", "departure_minute", "days_until_departure",
    "price_vnd", "temporal_market_median_price", "temporal_market_support", "anchor_vnd", "batch_offer_count",
]


def state_rows(p):
    """What the states and their queries need of the anchored offers, as a written table: it has several readers."""
    return p.stored("states", lambda: p.anchored.select(*STATE_ROWS))


@query(
    "sequence_source",
    'SELECT "group", session_key, event_time, '
    + ", ".join(f"round({c}, 7) + 0e0 AS {c}" for c in history.STATE_FEATURES)
    + " FROM states",
)
def sequence_source(p):
    return history.sequence_source(state_rows(p)).select("group", "session_key", "event_time", *[r(c, 7) for c in history.STATE_FEATURES])


def arrays(p, kind: str = "EXACT"):
    rows = state_rows(p)
    source = history.sequence_source(rows, kind)
    queries = rows.select(
        "offer_id", F.col("schedule_slot_id").cast("string").alias("group"), "feature_time", "session_key"
    )
    return history.history_arrays(queries, source, ["group"])


@query(
    "history_arrays",
    """WITH s AS (SELECT CAST(schedule_slot_id AS VARCHAR) AS g, session_key, feature_time AS t, ln(CAST(price_vnd AS DOUBLE)) AS x FROM anchored)
SELECT q.offer_id, CAST(least(count(s.g), 21) AS INTEGER) AS length,
round(coalesce(sum(s.x), 0), 6) + 0e0 AS log_price_sum, 21 - CAST(least(count(s.g), 21) AS INTEGER) AS padded
FROM anchored q LEFT JOIN LATERAL (SELECT * FROM s WHERE s.g = CAST(q.schedule_slot_id AS VARCHAR) AND s.t < q.feature_time
 AND s.session_key <> q.session_key ORDER BY s.t DESC LIMIT 21) s ON TRUE GROUP BY q.offer_id""",
)
def history_arrays(p):
    out = arrays(p)
    total = F.aggregate("history", F.lit(0.0), lambda acc, x: acc + x[1])
    return out.select(
        "offer_id", "length", (F.round(total, 6) + 0.0).alias("log_price_sum"),
        F.size(F.filter("mask", lambda m: ~m)).alias("padded"),
    )


@query("sequence_normalise")
def sequence_normalise(p):
    out = arrays(p)
    fit = out.where(F.col("feature_time") < F.lit("2026-05-01").cast("timestamp_ntz"))
    scaled = splits.normalise_arrays(out, splits.sequence_statistics(fit))
    first = F.when(F.col("length") > 0, F.col("history")[0][1])
    return scaled.select("offer_id", "length", F.round(first, 7).alias("first_log_price_z"))


view(
    "daily",
    """SELECT d.session_date, x.v FROM (SELECT CAST(d AS DATE) AS session_date FROM range((SELECT min(session_date) FROM offers),
(SELECT max(session_date) FROM offers) + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)) d LEFT JOIN (SELECT session_date, avg(price_vnd) AS v FROM offers
GROUP BY 1) x USING (session_date)""",
)


@query(
    "rolling_median",
    """SELECT session_date, round(CASE WHEN count(v) OVER b >= 3 THEN quantile_cont(v, 0.5) OVER b END, 6) AS trailing,
round(CASE WHEN count(v) OVER c >= 3 THEN quantile_cont(v, 0.5) OVER c END, 6) AS centred FROM daily
WINDOW b AS (ORDER BY session_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), c AS (ORDER BY session_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def rolling_median(p):
    days = p.offers.groupBy("session_date").agg(F.avg("price_vnd").alias("v"))
    bounds = days.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("session_date")).join(days, "session_date", "left")
    out = history.rolling_median(spine, "session_date", "v").withColumnRenamed("v_smooth", "trailing")
    out = history.rolling_median(out, "session_date", "v", centred=True).withColumnRenamed("v_smooth", "centred")
    return out.select("session_date", F.round("trailing", 6).alias("trailing"), F.round("centred", 6).alias("centred"))


@query(
    "average_rank",
    """SELECT offer_id, rank() OVER w + (count(*) OVER (PARTITION BY query_id, pred_vnd // 50000) - 1) / 2e0 AS avg_rank,
round((rank() OVER w + (count(*) OVER (PARTITION BY query_id, pred_vnd // 50000) - 1) / 2e0) / count(*) OVER (PARTITION BY query_id), 9) AS pct_rank
FROM queried WINDOW w AS (PARTITION BY query_id ORDER BY pred_vnd // 50000)""",
)
def average_rank_q(p):
    from farepanel.operators.serving import query_ids

    df = query_ids(p.offers).withColumn("v", F.expr("pred_vnd div 50000"))
    ranked = with_rank(df, ["query_id"], "v")
    return ranked.select(
        "offer_id", average_rank().alias("avg_rank"), F.round(average_rank() / F.col("n"), 9).alias("pct_rank")
    )


@query(
    "transition_weights",
    """SELECT offer_id, round(w / avg(w) OVER (), 9) AS weight FROM (SELECT offer_id, 1e0 / count(*) OVER (PARTITION BY target_dud, session_label) AS w FROM exact_pairs)""",
)
def transition_weights(p):
    return splits.cell_weights(p.exact_pairs, ["target_dud", "session_label"]).select("offer_id", r("weight"))


@query(
    "duplicate_ordinal",
    """SELECT offer_id, scraped_at, row_number() OVER (PARTITION BY offer_id ORDER BY scraped_at) - 1 AS ordinal FROM raw_offers""",
)
def duplicate_ordinal(p):
    from farepanel.operators.serving import duplicate_ordinal as ordinal

    return ordinal(p.raw, ["offer_id"], ["scraped_at"]).select("offer_id", "scraped_at", F.col("ordinal").cast("bigint").alias("ordinal"))
