"""Queries over row-level projections: types, sessions, bands, labels and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import pairs, quality, serving
from farepanel.plans.panel_views import band, hours, next_dud
from farepanel.plans.registry import query, view
from farepanel.sources.panel import CUTOFF

view(
    "raw_text",
    """SELECT offer_id,
CASE WHEN (schedule_slot_id + days_until_departure * 5) % 107 = 0 THEN 'unknown' ELSE CAST(scraped_at AS VARCHAR) END AS scraped_at,
CAST(session_id AS VARCHAR) AS session_id, route, airline, CAST(flight_date AS VARCHAR) AS flight_date,
CAST(departure_time AS VARCHAR) AS departure_time,
CASE WHEN (schedule_slot_id + days_until_departure) % 109 = 0 THEN NULL ELSE CAST(days_until_departure AS VARCHAR) END AS days_until_departure,
CASE WHEN (schedule_slot_id + days_until_departure * 3) % 101 = 0 THEN 'n/a'
     WHEN (schedule_slot_id + days_until_departure * 3) % 103 = 0 THEN '-5' ELSE CAST(price_vnd AS VARCHAR) END AS price_vnd
FROM offers""",
)


@query(
    "normalise_offers",
    """WITH t AS (SELECT offer_id, TRY_CAST(scraped_at AS TIMESTAMP) AS scraped_at, TRY_CAST(session_id AS TIMESTAMP) AS session_id,
TRY_CAST(flight_date AS DATE) AS flight_date, TRY_CAST(departure_time AS TIMESTAMP) AS departure_time,
TRY_CAST(price_vnd AS DOUBLE) AS price_vnd, TRY_CAST(days_until_departure AS INTEGER) AS days_until_departure FROM raw_text)
SELECT offer_id, scraped_at, days_until_departure, price_vnd,
CASE WHEN hour(session_id) BETWEEN 6 AND 17 THEN 'AM' ELSE 'PM' END AS session_label,
CAST(hour(departure_time) * 100 + minute(departure_time) AS INTEGER) AS departure_hhmm
FROM t WHERE scraped_at IS NOT NULL AND days_until_departure IS NOT NULL AND price_vnd > 0""",
)
def normalise_offers(p):
    return quality.normalise(p.raw_text).select(
        "offer_id", "scraped_at", "days_until_departure", "price_vnd", "session_label", "departure_hhmm"
    )


@query("session_label", "SELECT offer_id, session_label FROM offers")
def session_label(p):
    return p.offers.select("offer_id", K.session_label("session_id").alias("session_label"))


@query("session_date", "SELECT offer_id, session_date FROM offers")
def session_date(p):
    return p.offers.select("offer_id", K.session_date("session_id").alias("session_date"))


@query(
    "session_key",
    "SELECT offer_id, session_key, session_key + 719163 * 2 AS ordinal_session_key FROM offers",
)
def session_key(p):
    key = K.session_key(K.session_date("session_id"), K.session_label("session_id"))
    return p.offers.select("offer_id", key.alias("session_key"), (key + 719163 * 2).alias("ordinal_session_key"))


@query("ui_daypart", "SELECT offer_id, CASE WHEN hour(session_id) < 12 THEN 'AM' ELSE 'PM' END AS daypart FROM offers")
def ui_daypart(p):
    return p.offers.select("offer_id", K.ui_daypart("session_id").alias("daypart"))


CEILINGS = "CASE route " + " ".join(f"WHEN '{r}' THEN {c}" for r, c in C.ROUTE_CEILINGS.items()) + " END"
view(
    "tier_input",
    """SELECT offer_id, CASE WHEN schedule_slot_id % 211 = 0 THEN 'XXX-YYY' ELSE route END AS route,
CASE WHEN schedule_slot_id % 199 = 0 THEN NULL WHEN schedule_slot_id % 197 = 0 THEN price_vnd * 10 ELSE price_vnd END AS price_vnd
FROM offers""",
)
view(
    "tiered",
    f"""SELECT offer_id, CASE WHEN price_vnd IS NULL THEN 'soldout' WHEN {CEILINGS} IS NULL THEN 'unknown'
WHEN price_vnd <= {CEILINGS} THEN 'standard' WHEN price_vnd <= {C.EXTREME_FARE} THEN 'high' ELSE 'extreme' END AS price_tier
FROM tier_input""",
)


def tier_input(p):
    k, price = F.col("schedule_slot_id"), F.col("price_vnd")
    return p.offers.select(
        "offer_id",
        F.when(k % 211 == 0, "XXX-YYY").otherwise(F.col("route")).alias("route"),
        F.when(k % 199 == 0, F.lit(None)).when(k % 197 == 0, price * 10).otherwise(price).alias("price_vnd"),
    )


@query("price_tier", "SELECT * FROM tiered")
def price_tier(p):
    return tier_input(p).select("offer_id", K.price_tier("price_vnd", "route").alias("price_tier"))


@query(
    "source_taxonomy",
    f"""SELECT count(*) AS rows,
count(*) FILTER (collection_era NOT IN ('{C.FLI_ERA}', '{C.TRIP_ERA}')) AS unknown_eras,
count(*) FILTER (transition NOT IN ('{C.FLI_ERA}->{C.FLI_ERA}', '{C.FLI_ERA}->{C.TRIP_ERA}',
  '{C.TRIP_ERA}->{C.FLI_ERA}', '{C.TRIP_ERA}->{C.TRIP_ERA}')) AS bad_transitions
FROM (SELECT CASE WHEN schedule_slot_id % 301 = 0 THEN 'UNKNOWN' ELSE collection_era END AS collection_era,
CASE WHEN schedule_slot_id % 307 = 0 THEN collection_era ELSE collection_era || '->{C.TRIP_ERA}' END AS transition FROM offers)""",
)
def source_taxonomy(p):
    era, k = F.col("collection_era"), F.col("schedule_slot_id")
    return quality.era_violations(
        p.offers.select(
            F.when(k % 301 == 0, "UNKNOWN").otherwise(era).alias("collection_era"),
            F.when(k % 307 == 0, era).otherwise(F.concat(era, F.lit(f"->{C.TRIP_ERA}"))).alias("transition"),
        )
    )


CLEAN = r"regexp_replace(trim(flight_no), '\.0$', '')"
FALLBACK = f"coalesce(upper({CLEAN}) = upper(airline || '-' || lpad(CAST(departure_hhmm AS VARCHAR), 4, '0')), FALSE)"
VERIFIED = f"CASE WHEN NOT {FALLBACK} THEN airline || coalesce(regexp_replace({CLEAN}, '\\D', '', 'g'), '') END"


@query(
    "flight_no_clean",
    f"""SELECT offer_id, {CLEAN} AS flight_no_clean, {FALLBACK} AS is_schedule_fallback,
{VERIFIED} AS verified_flight_no FROM offers""",
)
def flight_no_clean(p):
    args = ("flight_no", "airline", "departure_hhmm")
    return p.offers.select(
        "offer_id",
        K.flight_no_clean("flight_no").alias("flight_no_clean"),
        K.schedule_fallback(*args).alias("is_schedule_fallback"),
        K.verified_flight_no(*args).alias("verified_flight_no"),
    )


PEAK = " OR ".join(f"flight_date BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in C.PEAK_PERIODS)


@query(
    "calendar_features",
    f"""SELECT offer_id, CAST(isodow(flight_date) - 1 AS INTEGER) AS flight_day_of_week,
CAST(month(flight_date) AS INTEGER) AS flight_month, CAST({PEAK} AS INTEGER) AS is_peak_period FROM offers""",
)
def calendar_features(p):
    return p.offers.select(
        "offer_id",
        F.weekday("flight_date").alias("flight_day_of_week"),
        F.month("flight_date").alias("flight_month"),
        K.is_peak("flight_date").alias("is_peak_period"),
    )


@query(
    "clock_features",
    f"""SELECT offer_id, departure_minute, round(sin(departure_minute * 2e0 * pi() / 1440e0), 9) + 0e0 AS departure_time_sin,
round(cos(departure_minute * 2e0 * pi() / 1440e0), 9) + 0e0 AS departure_time_cos,
{band('departure_minute', C.DEPARTURE_PERIODS)} AS departure_period FROM offers""",
)
def clock_features(p):
    return p.offers.select(
        "offer_id",
        K.minute_of_day("departure_time").alias("departure_minute"),
        (F.round(K.clock_sin("departure_minute"), 9) + 0.0).alias("departure_time_sin"),
        (F.round(K.clock_cos("departure_minute"), 9) + 0.0).alias("departure_time_cos"),
        K.right_closed_band("departure_minute", C.DEPARTURE_PERIODS).alias("departure_period"),
    )


@query(
    "booking_window_bucket",
    f"SELECT offer_id, {band('days_until_departure', C.DUD_BUCKETS)} AS booking_window_bucket FROM offers",
)
def booking_window_bucket(p):
    return p.offers.select(
        "offer_id", K.right_closed_band("days_until_departure", C.DUD_BUCKETS).alias("booking_window_bucket")
    )


view(
    "band_input",
    f"""SELECT *, {hours("CASE WHEN anchor_source = 'PRIOR_HISTORICAL' THEN temporal_market_time END", 'feature_time')} AS age FROM featured""",
)


@query(
    "support_bands",
    f"""SELECT offer_id, {band('coalesce(prior_relative_count, 0)', C.HISTORY_BANDS)} AS history_support_band,
{band('coalesce(peer_anchor_support, 0)', C.PEER_SUPPORT_BANDS)} AS anchor_support_band,
coalesce({band('age', C.ANCHOR_AGE_BANDS)}, 'STALE_GT_48H') AS anchor_age_band,
{band('lag_age_hours', C.SESSION_GAP_BANDS)} AS session_gap_band,
CASE WHEN prior_relative_count >= 3 THEN 'WARM' ELSE 'COLD' END AS regime FROM band_input""",
)
def support_bands(p):
    return serving.with_bands(p.feature_table).select(
        "offer_id", "history_support_band", "anchor_support_band", "anchor_age_band",
        K.right_closed_band("lag_age_hours", C.SESSION_GAP_BANDS).alias("session_gap_band"), "regime",
    )


TRUNK = ", ".join(f"'{r}'" for r in C.TRUNK_ROUTES)
TOURISM = ", ".join(f"'{r}'" for r in C.TOURISM_ROUTES)
MARKET = f"CASE WHEN route IN ({TRUNK}) THEN 'TRUNK' WHEN route IN ({TOURISM}) THEN 'TOURISM' ELSE 'REGIONAL_ALTERNATIVE' END"


@query("market_group", f"SELECT offer_id, {MARKET} AS market_group FROM offers")
def market_group(p):
    return p.offers.select("offer_id", K.market_group("route").alias("market_group"))


@query(
    "safe_logs",
    """SELECT offer_id, round(CASE WHEN x > 0 THEN ln(x) END, 9) AS log_value,
round(CASE WHEN x IS NOT NULL THEN ln(1 + CASE WHEN x > 0 THEN x ELSE 0 END) END, 9) AS log1p_value,
round(CASE WHEN x IS NOT NULL THEN ln(CASE WHEN x > 1 THEN x ELSE 1 END / price_vnd) END, 9) AS log_ratio
FROM (SELECT offer_id, price_vnd, CAST(CASE WHEN schedule_slot_id % 13 = 0 THEN NULL
ELSE pred_vnd - 900000 END AS DOUBLE) AS x FROM offers)""",
)
def safe_logs(p):
    x = F.when(F.col("schedule_slot_id") % 13 == 0, F.lit(None)).otherwise(F.col("pred_vnd") - 900_000)
    df = p.offers.select("offer_id", "price_vnd", x.cast("double").alias("x"))
    return df.select(
        "offer_id",
        F.round(K.safe_log("x"), 9).alias("log_value"),
        F.round(K.safe_log1p("x"), 9).alias("log1p_value"),
        F.round(K.safe_log_ratio("x", "price_vnd"), 9).alias("log_ratio"),
    )


@query(
    "movement_band",
    """SELECT offer_id, CASE WHEN prev IS NULL THEN 'NO_LEGAL_CARRY' WHEN m <= -0.10e0 THEN 'DROP_GE_10PCT'
WHEN m <= -0.05e0 THEN 'DROP_5_10PCT' WHEN abs(m) <= 0.01e0 THEN 'STABLE_LE_1PCT' WHEN m < 0.05e0 THEN 'MILD_WITHIN_5PCT'
WHEN m < 0.10e0 THEN 'RISE_5_10PCT' ELSE 'RISE_GE_10PCT' END AS actual_movement_band
FROM (SELECT offer_id, previous_price_same_schedule AS prev, price_vnd / previous_price_same_schedule - 1 AS m FROM featured)""",
)
def movement_band(p):
    legal = F.col("previous_price_same_schedule").isNotNull()
    band_ = K.movement_band("price_vnd", "previous_price_same_schedule", legal)
    return p.feature_table.select("offer_id", band_.alias("actual_movement_band"))


@query(
    "row_keys",
    """SELECT offer_id, offer_id || '|' || coalesce(CAST(t AS VARCHAR), '__NA__') AS row_key,
CAST(row_number() OVER (PARTITION BY session_key, schedule_slot_id ORDER BY scraped_at, price_vnd) - 1 AS INTEGER) AS ordinal
FROM (SELECT *, CASE WHEN schedule_slot_id % 7 = 0 THEN NULL ELSE session_key + 2 END AS t FROM raw_offers)""",
)
def row_keys(p):
    target = F.when(F.col("schedule_slot_id") % 7 == 0, F.lit(None)).otherwise(F.col("session_key") + 2)
    df = serving.duplicate_ordinal(p.raw, ["session_key", "schedule_slot_id"], ["scraped_at", "price_vnd"])
    return df.select("offer_id", K.token("offer_id", target).alias("row_key"), "ordinal")


@query(
    "next_window",
    f"""SELECT offer_id, t AS target_dud, days_until_departure - t AS horizon_gap_days,
days_until_departure || '->' || t AS transition, flight_date - t AS expected_label_date,
session_key + 2 * (days_until_departure - t) AS expected_session_key
FROM (SELECT *, {next_dud('days_until_departure')} AS t FROM offers) WHERE t IS NOT NULL""",
)
def next_window(p):
    return pairs.next_window(p.offers).select(
        "offer_id", "target_dud", "horizon_gap_days", "transition", "expected_label_date", "expected_session_key"
    )


view(
    "queried",
    """SELECT *, strftime(session_date, '%Y-%m-%d') || '|' || session_label || '|' || route || '|' || strftime(flight_date, '%Y-%m-%d') AS query_id,
route || '|' || airline || '|' || strftime(flight_date, '%Y-%m-%d') || '|' || lpad(CAST(departure_hhmm AS VARCHAR), 4, '0') AS schedule_slot_key,
route || '|' || airline || '|' || lpad(CAST(departure_hhmm AS VARCHAR), 4, '0') AS schedule_template_id FROM timed""",
)


@query("query_ids", "SELECT offer_id, query_id, schedule_slot_key, schedule_template_id FROM queried")
def query_ids(p):
    return serving.query_ids(p.offers).select("offer_id", "query_id", "schedule_slot_key", "schedule_template_id")


@query(
    "bridge_stability",
    f"""SELECT offer_id, CASE WHEN source_target_era_transition <> '{C.BRIDGE_TRANSITION}' THEN 'NOT_BRIDGE'
WHEN target_price_vnd <= 0.95e0 * 0.95e0 * price_vnd THEN 'ROBUST_DROP'
WHEN target_price_vnd > 0.95e0 * 1.05e0 * price_vnd THEN 'ROBUST_NO_DROP'
ELSE 'AMBIGUOUS_WITHIN_SOURCE_5PCT' END AS bridge_label_stability FROM exact_pairs""",
)
def bridge_stability(p):
    return p.exact_pairs.select("offer_id", "bridge_label_stability")


def event_sql(definitions) -> str:
    def one(kind, fraction, amount):
        if kind == "PCT" and fraction == 0:
            return "s > 0"
        relative, absolute = f"CAST(price_vnd AS DOUBLE) * {fraction}e0", f"{amount}e0"
        return "s >= " + {
            "PCT": relative,
            "VND": absolute,
            "MIN": f"least({relative}, {absolute})",
            "MAX": f"greatest({relative}, {absolute})",
        }[kind]

    flags = ", ".join(f"CAST({one(*d)} AS INTEGER) AS event_{n}" for n, d in definitions.items())
    return f"SELECT offer_id, {flags} FROM (SELECT *, CAST(price_vnd - target_price_vnd AS DOUBLE) AS s FROM exact_pairs)"


@query("event_labels_min", event_sql(C.EVENT_DEFINITIONS_MIN))
def event_labels_min(p):
    return pairs.attach_events(p.exact_pairs, C.EVENT_DEFINITIONS_MIN).select(
        "offer_id", *[f"event_{n}" for n in C.EVENT_DEFINITIONS_MIN]
    )


@query("event_labels_max", event_sql(C.EVENT_DEFINITIONS_MAX))
def event_labels_max(p):
    return pairs.attach_events(p.exact_pairs, C.EVENT_DEFINITIONS_MAX).select(
        "offer_id", *[f"event_{n}" for n in C.EVENT_DEFINITIONS_MAX]
    )


@query(
    "signed_directions",
    """SELECT offer_id, CAST(CASE WHEN price_change_pct < -0.01e0 THEN -1 WHEN price_change_pct > 0.01e0 THEN 1 ELSE 0 END AS INTEGER) AS direction,
round(ln(target_price_vnd / price_vnd), 9) + 0e0 AS log_return FROM exact_pairs""",
)
def signed_directions(p):
    ratio = F.ln(F.col("target_price_vnd") / F.col("price_vnd"))
    return p.exact_pairs.select(
        "offer_id", K.direction3("price_change_pct").alias("direction"), (F.round(ratio, 9) + 0.0).alias("log_return")
    )


@query(
    "residual_to_price",
    """WITH b AS (SELECT quantile_cont(y_log, 0.005) AS lo, quantile_cont(y_log, 0.995) AS hi FROM scored WHERE fold_set = 'SCREEN')
SELECT offer_id, round(price_vnd * exp(greatest(least(centre * 8, hi), lo)), 3) AS predicted_vnd
FROM scored, b WHERE fold_set = 'LATE'""",
)
def residual_to_price(p):
    train = p.scored.where("fold_set = 'SCREEN'")
    valid = p.scored.where("fold_set = 'LATE'").withColumn("residual", F.col("quantiles")[3] * 8)
    out = serving.residual_to_price(valid, train, "price_vnd", "residual", "y_log")
    return out.select("offer_id", F.round("predicted_vnd", 3).alias("predicted_vnd"))


@query(
    "quantile_rearrange",
    "SELECT offer_id, round(q0, 9) + 0e0 AS q1, "
    + ", ".join(f"round(greatest({', '.join(f'q{j}' for j in range(i + 1))}), 9) + 0e0 AS q{i + 1}" for i in range(1, 7))
    + " FROM scored",
)
def quantile_rearrange(p):
    out = p.scored.withColumn("r", K.rearrange("quantiles"))
    return out.select("offer_id", *[(F.round(F.col("r")[i], 9) + 0.0).alias(f"q{i + 1}") for i in range(7)])


@query(
    "leakage_guard",
    """SELECT count(*) AS rows, 1 AS missing_predictors, 1 AS forbidden_predictors,
count(*) FILTER (NOT feature_time < label_time) AS time_violations FROM exact_pairs""",
)
def leakage_guard(p):
    predictors = ["route", "airline", "price_vnd", "target_price_vnd", "seat_count"]
    return quality.leakage_guard(p.exact_pairs, predictors, ["target_price_vnd", "label_time", "drop_5pct"])


@query(
    "inference_frame",
    f"""SELECT offer_id || '|' || days_until_departure || '|' || t AS row_key, t AS target_dud,
days_until_departure || '->' || t AS transition, session_key + 2 * (days_until_departure - t) AS expected_session_key,
flight_date - t AS expected_label_date, {MARKET} AS market_group,
CASE WHEN prior_relative_count >= 3 THEN 'WARM' ELSE 'COLD' END AS regime,
{band('coalesce(prior_relative_count, 0)', C.HISTORY_BANDS)} AS history_support_band, price_vnd
FROM (SELECT *, {next_dud('days_until_departure')} AS t FROM featured)
WHERE t IS NOT NULL AND session_date = DATE '{CUTOFF}'""",
)
def inference_frame(p):
    return serving.inference_frame(p.feature_table, CUTOFF).select(
        "row_key", "target_dud", "transition", "expected_session_key", "expected_label_date",
        "market_group", "regime", "history_support_band", "price_vnd",
    )


@query(
    "snapshot_gate",
    f"""SELECT count(*) AS rows, count(*) FILTER (session_date IS NULL OR flight_date IS NULL) AS null_dates,
count(*) FILTER (d NOT BETWEEN 1 AND 60) AS horizon_out_of_range,
count(*) FILTER (d NOT IN ({', '.join(map(str, C.BOOKING_WINDOWS))})) AS off_grid,
count(*) FILTER (NOT v > 0) AS non_positive_prices, max(session_date) = DATE '{CUTOFF}' AS ends_at_cutoff
FROM (SELECT session_date, flight_date, CASE WHEN schedule_slot_id % 401 = 0 THEN days_until_departure + 5 ELSE days_until_departure END AS d,
CASE WHEN schedule_slot_id % 403 = 0 THEN 0 ELSE price_vnd END AS v FROM offers WHERE session_date <= DATE '{CUTOFF}')""",
)
def snapshot_gate(p):
    k, dud = F.col("schedule_slot_id"), F.col("days_until_departure")
    df = p.offers.where(F.col("session_date") <= F.lit(CUTOFF).cast("date")).select(
        "session_date", "flight_date",
        F.when(k % 401 == 0, dud + 5).otherwise(dud).alias("days_until_departure"),
        F.when(k % 403 == 0, 0).otherwise(F.col("price_vnd")).alias("price_vnd"),
    )
    return quality.snapshot_gate(df, CUTOFF)
