"""DuckDB text of the derived panel and of its stages, the counterpart of ``sources.panel``."""

from farepanel import config as C
from farepanel.plans.registry import view
from farepanel.sources.panel import BLOCKS, EPOCH, ERA_SWITCH, FOLDS

ROUTES = ", ".join(f"'{r}'" for r in C.ROUTE_CEILINGS)
AIRLINES = ", ".join(f"'{a}'" for a in C.AIRLINES)
DUDS = ", ".join(f"({d})" for d in C.BOOKING_WINDOWS)
NEXT = "CASE {c} " + " ".join(
    f"WHEN {a} THEN {b}" for a, b in zip(C.BOOKING_WINDOWS[:-1], C.BOOKING_WINDOWS[1:])
) + " END"


def next_dud(column: str) -> str:
    return NEXT.format(c=column)


def band(column: str, spec) -> str:
    labels, edges = spec
    chain = " ".join(f"WHEN {column} <= {e} THEN '{l}'" for e, l in zip(edges, labels[:-1]))
    return f"CASE {chain} WHEN {column} IS NOT NULL THEN '{labels[-1]}' END"


def hours(a: str, b: str) -> str:
    return f"((epoch({b}) - epoch({a})) / 3600e0)"


def folds(column: str) -> str:
    chain = " ".join(f"WHEN {column} BETWEEN DATE '{s}' AND DATE '{e}' THEN '{n}'" for n, _, s, e in FOLDS)
    return f"CASE {chain} END"


def fold_sets(column: str) -> str:
    chain = " ".join(f"WHEN {column} BETWEEN DATE '{s}' AND DATE '{e}' THEN '{r}'" for _, r, s, e in FOLDS)
    return f"CASE {chain} END"


def blocks(column: str) -> str:
    chain = " ".join(f"WHEN {column} BETWEEN DATE '{s}' AND DATE '{e}' THEN '{n}'" for n, s, e in BLOCKS)
    return f"CASE {chain} END"


view(
    "slots",
    """SELECT o_custkey % 20 AS rid, (o_custkey + o_orderkey // 40) % 5 AS aid, o_orderkey % 40 AS fd,
       ((o_orderkey // 40) * 37) % 1440 AS dmin, min(o_orderkey) AS k
FROM orders GROUP BY ALL""",
)
view(
    "grid0",
    f"""SELECT s.*, CAST(d.dud AS INTEGER) AS dud, CAST(p.pm AS INTEGER) AS pm
FROM slots s, (VALUES {DUDS}) d(dud), (VALUES (0), (1)) p(pm)
WHERE (k * 13 + dud * 7 + pm * 3) % 10 < 7""",
)
view(
    "grid1",
    f"""SELECT *, DATE '{EPOCH}' + CAST(fd AS INTEGER) AS flight_date,
       DATE '{EPOCH}' + CAST(fd - dud AS INTEGER) AS session_date,
       list_extract([{ROUTES}], rid + 1) AS route, list_extract([{AIRLINES}], aid + 1) AS airline,
       CAST(dmin AS INTEGER) AS departure_minute, CAST(dmin // 60 * 100 + dmin % 60 AS INTEGER) AS departure_hhmm,
       CASE WHEN pm = 0 THEN 8 WHEN k % 4 = 0 THEN 25 ELSE 19 END AS start_hour
FROM grid0""",
)
view(
    "offers",
    f"""SELECT k * 1000 + dud * 10 + pm AS offer_id, k AS schedule_slot_id,
       CAST(session_date AS TIMESTAMP) + to_hours(start_hour) AS session_id,
       CAST(session_date AS TIMESTAMP) + to_hours(start_hour) + to_minutes((k * 7 + dud) % 90) AS scraped_at,
       session_date, CASE WHEN pm = 1 THEN 'PM' ELSE 'AM' END AS session_label,
       CAST(date_diff('day', DATE '1970-01-01', session_date) * 2 + pm AS INTEGER) AS session_key,
       route, airline, flight_date, dud AS days_until_departure,
       CAST(flight_date AS TIMESTAMP) + to_minutes(dmin) AS departure_time, departure_minute, departure_hhmm,
       ((500000 + (k * 7919) % 2500000) * (80 + (k * 31 + dud * 17 + pm * 13) % 41)) // 100 AS price_vnd,
       CASE WHEN session_date < DATE '{ERA_SWITCH}' THEN '{C.FLI_ERA}' ELSE '{C.TRIP_ERA}' END AS collection_era,
       CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || CAST(100 + k % 900 AS VARCHAR) || '.0'
            WHEN 2 THEN airline || '-' || lpad(CAST(departure_hhmm AS VARCHAR), 4, '0')
            ELSE airline || CAST(100 + k % 900 AS VARCHAR) END AS flight_no,
       ((k * 37 + dud * 11 + pm * 5) % 97 + 1) / 100e0 AS p_drop,
       (((500000 + (k * 7919) % 2500000) * (80 + (k * 31 + dud * 17 + pm * 13) % 41)) // 100
         * (200 + (k * 53 + dud * 29 + pm * 7) % 41 - 20)) // 200 AS pred_vnd
FROM grid1""",
)
view(
    "raw_offers",
    """SELECT * FROM offers
UNION ALL SELECT * REPLACE (scraped_at + INTERVAL 30 MINUTE AS scraped_at, price_vnd + 50000 AS price_vnd)
FROM offers WHERE (schedule_slot_id + days_until_departure) % 23 = 0
UNION ALL SELECT * FROM offers WHERE (schedule_slot_id + days_until_departure) % 29 = 0""",
)
view(
    "timed",
    """SELECT o.*, b.feature_time, b.batch_offer_count FROM offers o
JOIN (SELECT session_key, max(scraped_at) AS feature_time, count(*) AS batch_offer_count
      FROM offers GROUP BY session_key) b USING (session_key)""",
)
view(
    "mkt_batches",
    f"""SELECT route, airline, days_until_departure, session_key, median(price_vnd) AS market_price,
       count(*) AS market_support, max(feature_time) AS market_time,
       CASE WHEN count(*) FILTER (collection_era = '{C.FLI_ERA}') > count(*) FILTER (collection_era = '{C.TRIP_ERA}')
            THEN '{C.FLI_ERA}'
            WHEN count(*) FILTER (collection_era = '{C.FLI_ERA}') < count(*) FILTER (collection_era = '{C.TRIP_ERA}')
            THEN '{C.TRIP_ERA}' ELSE 'MIXED' END AS market_era
FROM timed GROUP BY ALL""",
)
MARKET_LAGS = """lag(market_price) OVER w AS temporal_market_median_price,
       lag(market_support) OVER w AS temporal_market_support,
       lag(market_time) OVER w AS temporal_market_time,
       lag(market_era) OVER w AS temporal_market_collection_era,
       lag(market_price, 2) OVER w AS p2, lag(market_time, 2) OVER w AS t2"""
CHANGE = f"""CASE WHEN t2 < temporal_market_time AND p2 > 0
       THEN 100e0 * (temporal_market_median_price / p2 - 1) / ({hours('t2', 'temporal_market_time')} / 24e0) END
       AS prior_market_change_pct_per_day"""
view(
    "mkt_cross",
    f"""SELECT *, {CHANGE} FROM (SELECT route, airline, days_until_departure, session_key, {MARKET_LAGS}
FROM mkt_batches WINDOW w AS (PARTITION BY route, airline, days_until_departure ORDER BY market_time, session_key))""",
)
view(
    "mkt_joined",
    f"""SELECT t.*, m.temporal_market_median_price, m.temporal_market_support, m.temporal_market_time,
       m.temporal_market_collection_era, m.prior_market_change_pct_per_day,
       {hours('m.temporal_market_time', 't.feature_time')} AS temporal_market_age_hours
FROM timed t LEFT JOIN mkt_cross m USING (route, airline, days_until_departure, session_key)""",
)
view(
    "loo_ranked",
    """SELECT *, row_number() OVER c AS rk, count(*) OVER (PARTITION BY session_key, route, flight_date) AS n
FROM mkt_joined WINDOW c AS (PARTITION BY session_key, route, flight_date ORDER BY price_vnd, offer_id)""",
)
view(
    "loo_stats",
    """SELECT session_key, route, flight_date,
       max(CASE WHEN rk = (n - 1) // 2 THEN price_vnd END) AS s0,
       max(CASE WHEN rk = (n - 1) // 2 + 1 THEN price_vnd END) AS s1,
       max(CASE WHEN rk = (n - 1) // 2 + 2 THEN price_vnd END) AS s2
FROM loo_ranked GROUP BY ALL""",
)
view(
    "loo",
    """SELECT r.* EXCLUDE (rk, n), n - 1 AS peer_anchor_support,
       CASE WHEN n < 2 THEN NULL
            WHEN n % 2 = 0 THEN CAST(CASE WHEN rk <= (n - 1) // 2 + 1 THEN s2 ELSE s1 END AS DOUBLE)
            ELSE ((CASE WHEN rk <= (n - 1) // 2 THEN s1 ELSE s0 END)
                + (CASE WHEN rk <= (n - 1) // 2 + 1 THEN s2 ELSE s1 END)) / 2e0 END AS peer_anchor_vnd
FROM loo_ranked r JOIN loo_stats USING (session_key, route, flight_date)""",
)
view(
    "anchored0",
    """SELECT *, CASE WHEN peer_anchor_support >= 3 AND peer_anchor_vnd > 0 THEN 'CURRENT_PEER'
       WHEN temporal_market_median_price > 0 AND temporal_market_time < feature_time
            AND temporal_market_collection_era = collection_era THEN 'PRIOR_HISTORICAL'
       WHEN peer_anchor_support >= 1 AND peer_anchor_vnd > 0 THEN 'CURRENT_PEER_LOW_SUPPORT'
       ELSE 'UNAVAILABLE' END AS anchor_source FROM loo""",
)
view(
    "anchored",
    """SELECT *, ln(price_vnd / anchor_vnd) AS current_relative_log FROM (
SELECT *, CASE anchor_source WHEN 'PRIOR_HISTORICAL' THEN temporal_market_median_price
       WHEN 'UNAVAILABLE' THEN NULL ELSE peer_anchor_vnd END AS anchor_vnd FROM anchored0)""",
)
view(
    "featured",
    f"""SELECT *, {hours('previous_schedule_time', 'feature_time')} AS lag_age_hours,
       ln(anchor_vnd) - ln(previous_anchor_vnd) AS market_shift_log FROM (
SELECT *, row_number() OVER w - 1 AS prior_observation_count,
       lag(price_vnd) OVER w AS previous_price_same_schedule,
       lag(feature_time) OVER w AS previous_schedule_time,
       lag(session_key) OVER w AS previous_schedule_session_key,
       lag(session_label) OVER w AS previous_schedule_session_label,
       lag(collection_era) OVER w AS previous_schedule_collection_era,
       CASE WHEN row_number() OVER w > 2 THEN stddev_pop(price_vnd) OVER p END AS prior_price_volatility_vnd,
       CASE WHEN row_number() OVER w > 2 AND min(days_until_departure) OVER p < max(days_until_departure) OVER p
            THEN regr_slope(price_vnd, days_until_departure) OVER p END AS prior_price_trend_vnd_per_dud_day,
       count(current_relative_log) OVER p AS prior_relative_count,
       lag(current_relative_log) OVER w AS previous_relative_log,
       lag(anchor_vnd) OVER w AS previous_anchor_vnd,
       CASE WHEN count(current_relative_log) OVER p >= 2 THEN stddev_pop(current_relative_log) OVER p END
            AS prior_relative_volatility,
       CASE WHEN count(current_relative_log) OVER p >= 2
                 AND min(CASE WHEN current_relative_log IS NOT NULL THEN days_until_departure END) OVER p
                   < max(CASE WHEN current_relative_log IS NOT NULL THEN days_until_departure END) OVER p
            THEN regr_slope(current_relative_log, days_until_departure) OVER p END AS prior_relative_trend_per_dud_day,
       CAST(count(current_relative_log) OVER p >= 3 AS INTEGER) AS relative_history_eligible
FROM anchored
WINDOW w AS (PARTITION BY schedule_slot_id ORDER BY feature_time, session_key),
       p AS (PARTITION BY schedule_slot_id ORDER BY feature_time, session_key
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
view(
    "exact_pairs",
    f"""SELECT c.* EXCLUDE (wanted_dud), c.days_until_departure AS current_dud, t.days_until_departure AS target_dud,
       c.days_until_departure - t.days_until_departure AS horizon_gap_days,
       CAST(c.days_until_departure AS VARCHAR) || '->' || CAST(t.days_until_departure AS VARCHAR) AS transition,
       t.offer_id AS target_offer_id, t.price_vnd AS target_price_vnd, t.feature_time AS label_time,
       t.session_date AS target_session_date, t.session_key AS target_session_key,
       t.collection_era AS target_collection_era,
       t.price_vnd - c.price_vnd AS price_change_vnd,
       100e0 * (t.price_vnd - c.price_vnd) / c.price_vnd AS price_change_pct,
       CAST(t.price_vnd <= 0.95e0 * c.price_vnd AS INTEGER) AS drop_5pct,
       c.collection_era || '->' || t.collection_era AS source_target_era_transition
FROM (SELECT *, {next_dud('days_until_departure')} AS wanted_dud FROM timed) c JOIN timed t
  ON c.schedule_slot_id = t.schedule_slot_id AND c.session_label = t.session_label
 AND t.days_until_departure = c.wanted_dud
WHERE t.feature_time > c.feature_time AND t.session_date = c.flight_date - t.days_until_departure""",
)
view(
    "multi_pairs",
    f"""SELECT c.*, c.days_until_departure AS current_dud, t.days_until_departure AS target_dud,
       c.days_until_departure - t.days_until_departure AS horizon_gap_days,
       t.offer_id AS target_offer_id, t.price_vnd AS target_price_vnd, t.feature_time AS label_time,
       t.session_date AS target_session_date,
       coalesce(t.days_until_departure = {next_dud('c.days_until_departure')}, FALSE) AS is_exact_next,
       t.price_vnd - c.price_vnd AS price_change_vnd,
       100e0 * (t.price_vnd - c.price_vnd) / c.price_vnd AS price_change_pct
FROM timed c JOIN timed t
  ON c.schedule_slot_id = t.schedule_slot_id AND c.session_label = t.session_label
 AND c.collection_era = t.collection_era AND t.days_until_departure < c.days_until_departure
WHERE t.feature_time > c.feature_time AND t.session_date = c.flight_date - t.days_until_departure""",
)
QUANTILE_OFFSETS = ("-0.30e0 * flip", "-0.22e0", "-0.10e0", "0e0", "0.10e0", "0.22e0", "0.30e0 * flip")
WITH_Q = (
    "SELECT *, ln(target_price_vnd / price_vnd) AS y_log, "
    + ", ".join(f"centre + {o} AS q{i}" for i, o in enumerate(QUANTILE_OFFSETS))
    + ", [" + ", ".join(f"centre + {o}" for o in QUANTILE_OFFSETS) + "] AS quantiles"
    + " FROM (SELECT *, ((schedule_slot_id * 17 + days_until_departure) % 21 - 10) / 100e0 AS centre,"
    " CASE WHEN schedule_slot_id % 10 = 0 THEN -1e0 ELSE 1e0 END AS flip FROM {source})"
)
view(
    "scored",
    WITH_Q.format(
        source=f"(SELECT *, {folds('session_date')} AS fold, {fold_sets('session_date')} AS fold_set FROM exact_pairs)"
    )
    + " WHERE fold IS NOT NULL",
)
view(
    "blocked",
    WITH_Q.format(source=f"(SELECT *, {blocks('session_date')} AS block_id FROM exact_pairs)")
    + " WHERE block_id IS NOT NULL",
)
