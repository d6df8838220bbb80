"""Queries over joins, label pairs, as-of lookups and block comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.operators import market, pairs, quality, serving
from farepanel.plans.panel_views import next_dud
from farepanel.plans.columns_q import event_sql
from farepanel.plans.registry import query, view
from farepanel.sources.panel import BLOCKS, CUTOFF


@query(
    "drop_rate_by_transition",
    """SELECT transition, count(*) AS pairs, CAST(sum(drop_5pct) AS BIGINT) AS drops,
round(avg(drop_5pct), 9) AS drop_rate, count(temporal_market_median_price) AS with_market
FROM exact_pairs JOIN (SELECT offer_id, temporal_market_median_price FROM mkt_joined) USING (offer_id) GROUP BY 1""",
)
def drop_rate_by_transition(p):
    labelled = pairs.exact_next_pairs(market.market_anchor(p.timed, by_era=False))
    return labelled.groupBy("transition").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("drop_5pct").alias("drops"),
        F.round(F.avg("drop_5pct"), 9).alias("drop_rate"),
        F.count("temporal_market_median_price").alias("with_market"),
    )


@query(
    "checked_join",
    "SELECT offer_id, drop_5pct, e.price_vnd, route FROM exact_pairs e",
)
def checked_join(p):
    left = p.exact_pairs.select("offer_id", "drop_5pct")
    right = p.offers.select("offer_id", "price_vnd", "route")
    return quality.checked_join(left, right, ["offer_id"], "left", "m:1", require_full=True)


@query(
    "join_cardinality",
    """WITH l AS (SELECT schedule_slot_id, count(*) AS ln FROM raw_offers WHERE session_label = 'AM' GROUP BY 1),
r AS (SELECT schedule_slot_id, count(*) AS rn FROM offers WHERE days_until_departure = 7 GROUP BY 1)
SELECT CAST(sum(coalesce(ln, 0)) AS BIGINT) AS left_rows, CAST(sum(coalesce(rn, 0)) AS BIGINT) AS right_rows,
count(*) FILTER (ln > 1) AS left_repeated_keys, count(*) FILTER (rn > 1) AS right_repeated_keys,
CAST(sum(CASE WHEN rn IS NULL THEN ln ELSE 0 END) AS BIGINT) AS left_uncovered_rows,
CAST(sum(coalesce(ln, 0) * coalesce(rn, 0)) AS BIGINT) AS joined_rows FROM l FULL JOIN r USING (schedule_slot_id)""",
)
def join_cardinality(p):
    return quality.join_report(
        p.raw.where("session_label = 'AM'"), p.offers.where("days_until_departure = 7"), ["schedule_slot_id"]
    )


PAIR = ["offer_id", "target_offer_id", "transition", "price_change_vnd", "label_time", "drop_5pct"]


@query("exact_next_pairs", f"SELECT {', '.join(PAIR)}, round(price_change_pct, 9) + 0e0 AS price_change_pct FROM exact_pairs")
def exact_next_pairs(p):
    return p.exact_pairs.select(*PAIR, (F.round("price_change_pct", 9) + 0.0).alias("price_change_pct"))


@query(
    "multi_horizon_pairs",
    "SELECT offer_id, target_offer_id, current_dud, target_dud, horizon_gap_days, is_exact_next, price_change_vnd FROM multi_pairs",
)
def multi_horizon_pairs(p):
    return p.multi_pairs.select(
        "offer_id", "target_offer_id", "current_dud", "target_dud", "horizon_gap_days", "is_exact_next", "price_change_vnd"
    )


view(
    "intraday",
    """SELECT * FROM (SELECT a.*, b.offer_id AS target_offer_id, b.feature_time AS label_time, b.price_vnd AS target_price_vnd,
(epoch(b.feature_time) - epoch(a.feature_time)) / 3600e0 AS horizon_gap_hours,
CAST(b.price_vnd <= 0.95e0 * a.price_vnd AS INTEGER) AS will_drop_intraday,
row_number() OVER (PARTITION BY a.offer_id ORDER BY b.feature_time, b.offer_id) AS rn
FROM timed a JOIN timed b ON a.collection_era = b.collection_era AND a.schedule_slot_id = b.schedule_slot_id
 AND a.session_date = b.session_date AND a.days_until_departure = 1 AND b.days_until_departure = 1
 AND a.session_label = 'AM' AND b.session_label = 'PM' AND b.feature_time > a.feature_time) WHERE rn = 1""",
)


@query(
    "dud1_intraday",
    "SELECT offer_id, target_offer_id, round(horizon_gap_hours, 9) AS horizon_gap_hours, will_drop_intraday FROM intraday",
)
def dud1_intraday(p):
    return pairs.dud1_intraday(p.timed).select(
        "offer_id", "target_offer_id", F.round("horizon_gap_hours", 9).alias("horizon_gap_hours"), "will_drop_intraday"
    )


view(
    "aux_pairs",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY target_dud DESC, label_time, target_offer_id) AS rn
FROM multi_pairs WHERE offer_id NOT IN (SELECT offer_id FROM exact_pairs)) WHERE rn = 1""",
)


@query("nearest_lower_aux", "SELECT offer_id, target_offer_id, target_dud, label_time FROM aux_pairs")
def nearest_lower_aux(p):
    return pairs.nearest_lower(p.exact_pairs, p.multi_pairs).select("offer_id", "target_offer_id", "target_dud", "label_time")


view(
    "target_mkt",
    """SELECT collection_era, route, airline, days_until_departure AS target_dud, feature_time AS market_time,
median(price_vnd) AS causal_target_market_median FROM timed GROUP BY ALL""",
)
view(
    "pairs_mkt",
    """SELECT e.*, m.causal_target_market_median FROM multi_pairs e ASOF LEFT JOIN target_mkt m
ON e.collection_era = m.collection_era AND e.route = m.route AND e.airline = m.airline AND e.target_dud = m.target_dud
AND e.feature_time > m.market_time""",
)


@query("asof_target_market", "SELECT offer_id, target_dud, causal_target_market_median FROM pairs_mkt")
def asof_target_market(p):
    return pairs.target_market(p.multi_pairs, p.timed).select("offer_id", "target_dud", "causal_target_market_median")


view(
    "sessions",
    f"""SELECT session_key, min(feature_time) AS target_session_time, min(session_date) AS target_session_date,
min(session_label) AS target_session_label,
CASE WHEN count(*) FILTER (collection_era = '{C.FLI_ERA}') * 2 > count(*) THEN '{C.FLI_ERA}'
     WHEN count(*) FILTER (collection_era = '{C.TRIP_ERA}') * 2 > count(*) THEN '{C.TRIP_ERA}' ELSE 'MIXED' END AS target_collection_era
FROM timed GROUP BY 1""",
)
view(
    "session_links",
    """SELECT * FROM (SELECT *, lag(session_key) OVER w AS source_session_key, lag(target_session_time) OVER w AS source_session_time,
lag(target_session_date) OVER w AS source_session_date, lag(target_session_label) OVER w AS source_session_label,
lag(target_collection_era) OVER w AS source_collection_era FROM sessions
WINDOW w AS (ORDER BY target_session_time, session_key)) WHERE source_session_key IS NOT NULL""",
)


@query("session_pairs", "SELECT * FROM session_links")
def session_pairs(p):
    return market.session_pairs(p.timed)


view(
    "ledger",
    f"""SELECT c.*, c.t AS target_dud, c.days_until_departure - c.t AS horizon_gap_days, c.flight_date - c.t AS expected_label_date,
o.offer_id AS observed_target_offer_id,
CASE WHEN c.flight_date - c.t > DATE '{CUTOFF}' THEN 'IMMATURE_RIGHT_CENSORED' WHEN o.offer_id IS NOT NULL THEN 'OBSERVED'
ELSE 'MATURE_NOT_OBSERVED' END AS target_observation_state
FROM (SELECT *, {next_dud('days_until_departure')} AS t FROM timed) c
LEFT JOIN timed o ON c.schedule_slot_id = o.schedule_slot_id AND c.session_label = o.session_label AND c.t = o.days_until_departure
WHERE c.t IS NOT NULL""",
)


@query(
    "observability_ledger",
    """SELECT offer_id, target_dud, expected_label_date, observed_target_offer_id, target_observation_state,
target_observation_state = 'OBSERVED' AS metric_eligible FROM ledger""",
)
def observability_ledger(p):
    return pairs.observability(p.timed, CUTOFF).select(
        "offer_id", "target_dud", "expected_label_date", "observed_target_offer_id", "target_observation_state", "metric_eligible"
    )


view(
    "event_states",
    f"""SELECT offer_id, has_exact_label, has_aux_nearest_lower_label, has_dud1_intraday_label, expected_label_date, session_date,
CASE WHEN has_exact_label = 1 THEN 'EXACT_MATURE' WHEN days_until_departure = 1 THEN 'NOT_APPLICABLE_DUD1'
WHEN expected_label_date > DATE '{CUTOFF}' THEN 'RIGHT_CENSORED' ELSE 'MATURED_NOT_REOBSERVED' END AS exact_status,
CASE WHEN has_exact_label = 1 THEN 'EXACT_MATURE'
WHEN days_until_departure = 1 AND session_label = 'AM' AND has_dud1_intraday_label = 1 THEN 'DUD1_INTRADAY_MATURE'
WHEN days_until_departure = 1 AND session_label = 'AM' THEN 'DUD1_INTRADAY_MISSING'
WHEN days_until_departure = 1 THEN 'DUD1_PM_TERMINAL' WHEN has_aux_nearest_lower_label = 1 THEN 'AUX_NEAREST_AVAILABLE'
WHEN expected_label_date > DATE '{CUTOFF}' THEN 'RIGHT_CENSORED' ELSE 'MATURED_NOT_REOBSERVED' END AS event_label_status
FROM (SELECT t.*, t.flight_date - {next_dud('days_until_departure')} AS expected_label_date,
CAST(e.offer_id IS NOT NULL AS INTEGER) AS has_exact_label, CAST(a.offer_id IS NOT NULL AS INTEGER) AS has_aux_nearest_lower_label,
CAST(d.offer_id IS NOT NULL AS INTEGER) AS has_dud1_intraday_label
FROM timed t LEFT JOIN (SELECT offer_id FROM exact_pairs) e USING (offer_id)
LEFT JOIN (SELECT offer_id FROM aux_pairs) a USING (offer_id) LEFT JOIN (SELECT offer_id FROM intraday) d USING (offer_id))""",
)


def registry_frame(p):
    aux = pairs.nearest_lower(p.exact_pairs, p.multi_pairs)
    return pairs.event_registry(p.timed, p.exact_pairs, aux, pairs.dud1_intraday(p.timed), CUTOFF)


@query(
    "event_registry",
    """SELECT offer_id, has_exact_label, has_aux_nearest_lower_label, has_dud1_intraday_label, exact_status, event_label_status
FROM event_states""",
)
def event_registry(p):
    return registry_frame(p).select(
        "offer_id", "has_exact_label", "has_aux_nearest_lower_label", "has_dud1_intraday_label", "exact_status", "event_label_status"
    )


@query(
    "event_truth",
    f"""SELECT offer_id, 'AUX_NEAREST_LOWER' AS event_source, target_offer_id,
greatest(horizon_gap_days - (current_dud - {next_dud('current_dud')}), 0) AS aux_gap_extra_days,
price_vnd - target_price_vnd AS saving_vnd,
CAST(price_vnd - target_price_vnd >= least(CAST(price_vnd AS DOUBLE) * 0.05e0, 50000e0) AS INTEGER) AS event_drop_5pct_or_50k
FROM aux_pairs""",
)
def event_truth(p):
    aux = pairs.nearest_lower(p.exact_pairs, p.multi_pairs)
    return pairs.event_truth(p.timed, aux, "AUX_NEAREST_LOWER").select(
        "offer_id", "event_source", "target_offer_id", "aux_gap_extra_days", "saving_vnd", "event_drop_5pct_or_50k"
    )


@query(
    "dud1_events",
    """SELECT offer_id, target_offer_id, 'DUD1_AM->PM' AS transition, price_vnd - target_price_vnd AS saving_vnd,
CAST(price_vnd - target_price_vnd >= least(CAST(price_vnd AS DOUBLE) * 0.05e0, 50000e0) AS INTEGER) AS event_drop_5pct_or_50k
FROM intraday""",
)
def dud1_events(p):
    return pairs.dud1_events(p.timed, pairs.dud1_intraday(p.timed)).select(
        "offer_id", "target_offer_id", "transition", "saving_vnd", "event_drop_5pct_or_50k"
    )


@query(
    "reobservation_frame",
    """SELECT offer_id, target_dud, CAST(target_observation_state = 'OBSERVED' AS INTEGER) AS reobserved,
CAST(expected_label_date + 1 AS TIMESTAMP) AS outcome_time, price_vnd FROM ledger
WHERE target_observation_state <> 'IMMATURE_RIGHT_CENSORED' AND feature_time < CAST(expected_label_date + 1 AS TIMESTAMP)""",
)
def reobservation_frame(p):
    return pairs.reobservation(p.timed, pairs.observability(p.timed, CUTOFF)).select(
        "offer_id", "target_dud", "reobserved", "outcome_time", "price_vnd"
    )


@query(
    "event_frame",
    f"""WITH e AS ({event_sql(C.EVENT_DEFINITIONS_MAX)})
SELECT offer_id, x.label_time AS outcome_time, e.event_drop_3pct, e.event_drop_max_5pct_50k, f.temporal_market_median_price
FROM exact_pairs x JOIN e USING (offer_id) JOIN (SELECT offer_id, temporal_market_median_price FROM mkt_joined) f USING (offer_id)""",
)
def event_frame(p):
    return pairs.event_frame(market.market_anchor(p.timed, by_era=False), p.exact_pairs).select(
        "offer_id", "outcome_time", "event_drop_3pct", "event_drop_max_5pct_50k", "temporal_market_median_price"
    )


SLOT_KEYS = ["session_date", "session_label", "route", "days_until_departure", "flight_date", "airline", "departure_hhmm"]
view(
    "second_source",
    """SELECT * REPLACE (price_vnd * (1000 + schedule_slot_id % 70) // 1000 AS price_vnd) FROM raw_offers
WHERE NOT (session_label = 'PM' AND days_until_departure = 60)""",
)


def second_source(p):
    return p.raw.where("not (session_label = 'PM' and days_until_departure = 60)").withColumn(
        "price_vnd", F.expr("price_vnd * (1000 + schedule_slot_id % 70) div 1000")
    )


@query(
    "cross_source_match",
    f"""WITH a AS (SELECT {', '.join(SLOT_KEYS)}, min(price_vnd) AS pa, count(*) AS na FROM raw_offers GROUP BY ALL),
b AS (SELECT {', '.join(SLOT_KEYS)}, min(price_vnd) AS pb, count(*) AS nb FROM second_source GROUP BY ALL)
SELECT session_date, count(*) AS matched_slots, CAST(sum(na) AS BIGINT) AS a_rows, CAST(sum(nb) AS BIGINT) AS b_rows,
round(quantile_cont(pb / pa, 0.5), 9) AS median_ratio,
round(avg(CASE WHEN 100e0 * abs(pb / pa - 1) <= 5 THEN 1e0 ELSE 0e0 END), 9) AS within_5pct,
round(avg(CASE WHEN 100e0 * abs(pb / pa - 1) <= 10 THEN 1e0 ELSE 0e0 END), 9) AS within_10pct
FROM a JOIN b USING ({', '.join(SLOT_KEYS)}) GROUP BY 1""",
)
def cross_source_match(p):
    matched = pairs.cross_source(p.raw, second_source(p), SLOT_KEYS)
    return serving.daily_agreement(matched, "session_date")


view(
    "assembled",
    """SELECT offer_id || '' AS row_key, price_vnd, pred_vnd AS fare_vnd, p_drop AS probability, schedule_slot_id % 97 AS rank_score,
CASE WHEN flight_no IS NULL THEN 'BUY' WHEN p_drop >= 0.3e0 THEN 'WAIT' ELSE 'BUY' END AS action
FROM offers""",
)


@query("assemble_predictions", "SELECT * FROM assembled")
def assemble_predictions(p):
    base = p.offers.withColumn("row_key", F.col("offer_id").cast("string"))
    parts = {
        "point": base.select("row_key", F.col("pred_vnd").alias("fare_vnd")),
        "classification": base.select("row_key", F.col("p_drop").alias("probability")),
        "ranking": base.select("row_key", (F.col("schedule_slot_id") % 97).alias("rank_score")),
    }
    actions = base.where("flight_no is not null").select(
        "row_key", F.when(F.col("p_drop") >= C.WAIT_THRESHOLD, "WAIT").otherwise("BUY").alias("action")
    )
    return serving.assemble(base.select("row_key", "price_vnd"), parts, actions)


WANTED = (1, 4, 6, 8, 12, 17, 25, 37, 52)


def interpolation_sql() -> str:
    rows = []
    for d in WANTED:
        lower, upper = serving.bracket(d)
        weight = "0e0" if lower == upper else f"({d - lower}e0 / {upper - lower}e0)"
        rows.append(f"({d}, {lower}, {upper}, {weight})")
    return f"""SELECT l.session_key, l.route, l.airline, l.departure_hhmm, w.d AS wanted_dud,
round((1 - w.f) * l.price_vnd + w.f * u.price_vnd, 6) AS price_vnd, round((1 - w.f) * l.p_drop + w.f * u.p_drop, 9) AS p_drop,
CASE WHEN (1 - w.f) * l.p_drop + w.f * u.p_drop >= 0.3e0 THEN 'WAIT' ELSE 'BUY' END AS action
FROM (VALUES {', '.join(rows)}) w(d, lo, hi, f)
JOIN offers l ON l.days_until_departure = w.lo JOIN offers u ON u.days_until_departure = w.hi
AND u.session_key = l.session_key AND u.route = l.route AND u.airline = l.airline AND u.departure_hhmm = l.departure_hhmm"""


@query("horizon_interpolation", interpolation_sql())
def horizon_interpolation(p):
    keys = ["session_key", "route", "airline", "departure_hhmm"]
    out = serving.interpolate_horizon(p.offers, keys, ["price_vnd", "p_drop"], WANTED)
    return out.withColumn("price_vnd", F.round("price_vnd", 6)).withColumn("p_drop", F.round("p_drop", 9))


@query(
    "choice_set",
    """SELECT a.offer_id, count(b.offer_id) AS alternatives, min(b.price_vnd) AS alternative_min_price
FROM offers a LEFT JOIN offers b ON a.session_key = b.session_key AND a.route = b.route AND a.flight_date = b.flight_date
AND b.departure_minute BETWEEN a.departure_minute - 60 AND a.departure_minute + 60 AND a.offer_id <> b.offer_id GROUP BY 1""",
)
def choice_set(p):
    return pairs.choice_set(p.offers, 60).select("offer_id", "alternatives", "alternative_min_price")


BOUNDARY = f"{BLOCKS[1][1]} 00:00:00"


@query(
    "temporal_isolation",
    f"""WITH q AS (SELECT b.*, q.query_id FROM blocked b JOIN (SELECT offer_id, query_id FROM queried) q USING (offer_id)),
a AS (SELECT * FROM q WHERE block_id = 'TEST_1'), b AS (SELECT * FROM q WHERE block_id = 'TEST_2')
SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT max(session_date) FROM a) AS last_a,
(SELECT count(*) FROM b) AS rows_b, (SELECT min(session_date) FROM b) AS first_b,
(SELECT count(*) FROM b WHERE label_time < TIMESTAMP '{BOUNDARY}') AS labels_before_boundary_b,
(SELECT count(*) FROM (SELECT offer_id FROM a INTERSECT SELECT offer_id FROM b)) AS row_overlap,
(SELECT count(*) FROM (SELECT query_id FROM a INTERSECT SELECT query_id FROM b)) AS query_overlap,
(SELECT count(*) FROM (SELECT offer_id FROM a INTERSECT SELECT offer_id FROM b)) = 0
 AND (SELECT count(*) FROM (SELECT query_id FROM a INTERSECT SELECT query_id FROM b)) = 0 AS isolated""",
)
def temporal_isolation(p):
    df = serving.query_ids(p.blocks)
    return quality.isolation_audit(df.where("block_id = 'TEST_1'"), df.where("block_id = 'TEST_2'"), BOUNDARY)


@query(
    "parity_diff",
    """WITH b AS (SELECT offer_id, CASE WHEN schedule_slot_id % 317 = 0 THEN price_vnd + 1 ELSE price_vnd END AS price_vnd,
CASE WHEN schedule_slot_id % 11 = 0 THEN p_drop + 1e-6 ELSE p_drop + 1e-10 END AS p_drop,
CASE WHEN schedule_slot_id % 13 = 0 THEN NULL ELSE flight_no END AS flight_no FROM offers WHERE NOT (session_label = 'PM' AND days_until_departure = 60))
SELECT count(*) FILTER (b.offer_id IS NOT NULL) AS matched_rows, count(*) FILTER (b.offer_id IS NULL) AS left_only, 0 AS right_only,
count(*) FILTER (b.offer_id IS NOT NULL AND a.price_vnd <> b.price_vnd) AS diff_price_vnd,
count(*) FILTER (b.offer_id IS NOT NULL AND abs(a.p_drop - b.p_drop) > 1e-8) AS diff_p_drop,
count(*) FILTER (b.offer_id IS NOT NULL AND a.flight_no IS DISTINCT FROM b.flight_no) AS diff_flight_no
FROM offers a LEFT JOIN b USING (offer_id)""",
)
def parity_diff(p):
    k = F.col("schedule_slot_id")
    other = p.offers.where("not (session_label = 'PM' and days_until_departure = 60)").select(
        "offer_id",
        F.when(k % 317 == 0, F.col("price_vnd") + 1).otherwise(F.col("price_vnd")).alias("price_vnd"),
        F.when(k % 11 == 0, F.col("p_drop") + 1e-6).otherwise(F.col("p_drop") + 1e-10).alias("p_drop"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("flight_no")).alias("flight_no"),
    )
    return quality.parity(p.offers, other, "offer_id", ["price_vnd", "p_drop", "flight_no"])


@query(
    "registry_check",
    """SELECT route, airline, count(*) AS rows FROM offers
WHERE (route, airline) NOT IN (SELECT route, airline FROM offers WHERE airline <> '9G') GROUP BY ALL""",
)
def registry_check(p):
    known = quality.registry(p.offers.where("airline <> '9G'"))
    return quality.unknown_pairs(p.offers, known)


@query(
    "seed_alignment",
    """SELECT offer_id, round((p_drop + p_drop * 0.5e0 + (p_drop * 0.5e0 + 0.25e0)) / 3e0, 9) AS p_drop, TRUE AS aligned
FROM offers WHERE flight_no IS NOT NULL
UNION ALL SELECT offer_id, round((p_drop + (p_drop * 0.5e0 + 0.25e0)) / 2e0, 9), FALSE FROM offers WHERE flight_no IS NULL""",
)
def seed_alignment(p):
    prob = F.col("p_drop")
    members = [
        p.offers.select("offer_id", prob),
        p.offers.where("flight_no is not null").select("offer_id", (prob * 0.5).alias("p_drop")),
        p.offers.select("offer_id", (prob * 0.5 + 0.25).alias("p_drop")),
    ]
    return quality.ensemble_mean(members, "offer_id", ["p_drop"]).withColumn("p_drop", F.round("p_drop", 9))
