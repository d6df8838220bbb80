"""Queries over deduplication, coverage, registries and market aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import market, quality, rates
from farepanel.plans.columns_q import tier_input
from farepanel.plans.panel_views import band
from farepanel.plans.registry import query, view

IDENT = ", ".join(quality.IDENTITY)


@query(
    "dedup_latest",
    f"""SELECT {IDENT}, scraped_at, price_vnd FROM (SELECT *, row_number() OVER (PARTITION BY {IDENT}
ORDER BY scraped_at DESC, session_id DESC, schedule_slot_id DESC) AS rn FROM raw_offers) WHERE rn = 1""",
)
def dedup_latest(p):
    keys = list(quality.IDENTITY)
    df = p.raw.select(*keys, "scraped_at", "session_id", "schedule_slot_id", "price_vnd")
    return quality.dedup_latest(df, keys, ["scraped_at", "session_id", "schedule_slot_id"]).select(*keys, "scraped_at", "price_vnd")


view(
    "completed",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_key, schedule_slot_id
ORDER BY scraped_at DESC, session_id DESC, price_vnd DESC) AS rn FROM raw_offers) WHERE rn = 1""",
)


@query("completed_batch_offers", "SELECT session_key, schedule_slot_id, scraped_at, price_vnd FROM completed")
def completed_batch_offers(p):
    return quality.completed_batch_offers(p.raw).select("session_key", "schedule_slot_id", "scraped_at", "price_vnd")


@query(
    "exact_duplicates",
    """SELECT (SELECT count(*) FROM raw_offers) AS raw_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_offers)) AS rows_kept,
(SELECT count(*) FROM raw_offers) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_offers)) AS duplicates_removed""",
)
def exact_duplicates(p):
    return quality.exact_duplicate_counts(p.raw)


DUPE = "scraped_at, session_id, route, days_until_departure, flight_date, airline, flight_no, departure_time, price_vnd"


@query(
    "duplicate_flags",
    f"""SELECT offer_id, scraped_at, count(*) OVER (PARTITION BY {DUPE}) > 1 AS is_exact_duplicate FROM raw_offers""",
)
def duplicate_flags(p):
    return quality.flag_duplicates(p.raw, DUPE.split(", ")).select("offer_id", "scraped_at", "is_exact_duplicate")


@query(
    "tier_split_stats",
    "SELECT count(*) AS all_rows, "
    + ", ".join(
        f"count(*) FILTER (price_tier = '{t}') AS {t}_rows" for t in ("standard", "high", "extreme", "unknown", "soldout")
    )
    + " FROM tiered",
)
def tier_split_stats(p):
    return quality.tier_stats(tier_input(p))


SORTED = ",".join(str(w) for w in sorted(C.BOOKING_WINDOWS))
view(
    "coverage1",
    """SELECT session_date, session_label, count(*) AS rows, count(DISTINCT route) AS routes, count(DISTINCT airline) AS airlines,
array_to_string(list_sort(list(DISTINCT days_until_departure)), ',') AS duds FROM offers GROUP BY ALL""",
)


@query(
    "batch_coverage",
    f"SELECT *, duds = '{SORTED}' AND routes = 20 AND airlines = 5 AS complete FROM coverage1",
)
def batch_coverage(p):
    return quality.batch_coverage(p.offers, ["session_date", "session_label"])


@query(
    "prospective_coverage",
    f"""SELECT session_date, session_label, coalesce(rows, 0) AS rows, routes, airlines, duds,
CASE WHEN rows IS NULL THEN 'ABSENT' WHEN duds = '{SORTED}' AND routes = 20 AND airlines >= 4 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status
FROM (SELECT CAST(d AS DATE) AS session_date, l AS session_label FROM range(DATE '2026-02-25', DATE '2026-06-16', INTERVAL 1 DAY) t(d),
(SELECT unnest(['AM', 'PM']) AS l)) LEFT JOIN coverage1 USING (session_date, session_label)""",
)
def prospective_coverage(p):
    return quality.coverage_matrix(p.offers, "2026-02-25", "2026-06-15")


AIR = ", ".join(f"'{a}'" for a in C.AIRLINES)
view("raw_sub", "SELECT * FROM raw_offers WHERE session_label = 'PM' UNION ALL SELECT * FROM offers WHERE session_label = 'AM'")
view(
    "batch_states",
    f"""SELECT * EXCLUDE (duds), len(duds) AS windows, CASE WHEN routes = 20 AND (airlines = {len(C.AIRLINES)} OR (session_label = 'AM' AND airlines >= 4))
AND unknown_airline_slots = 0 AND duds = {sorted(C.BOOKING_WINDOWS)} THEN 'READY' ELSE 'FAILED' END AS status FROM (
SELECT session_date, session_label, CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT route) AS routes, count(DISTINCT airline) AS airlines,
count(*) FILTER (airline NOT IN ({AIR})) AS unknown_airline_slots,
list_sort(list_distinct(list(days_until_departure))) AS duds, count(*) FILTER (n > 1) AS duplicate_slots
FROM (SELECT session_date, session_label, schedule_slot_id, route, airline, days_until_departure, count(*) AS n
FROM raw_offers GROUP BY ALL) GROUP BY ALL)""",
)


def validated(p):
    """The panel's morning batches are declared ones, which may lack an airline."""
    return quality.validate_batches(p.raw, subset=F.col("session_label") == "AM")


@query("batch_validation", "SELECT * FROM batch_states")
def batch_validation(p):
    return validated(p)


@query(
    "store_status",
    """SELECT count(*) AS batches, count(*) FILTER (status = 'READY') AS ready_batches, count(*) FILTER (status = 'FAILED') AS failed_batches,
count(*) FILTER (status = 'STAGING') AS staging_batches,
CAST(coalesce(sum(CASE WHEN status = 'READY' THEN rows END), 0) AS BIGINT) AS ready_rows,
min(CASE WHEN status = 'READY' THEN session_date END) AS first_ready, max(CASE WHEN status = 'READY' THEN session_date END) AS last_ready
FROM batch_states""",
)
def store_status(p):
    return quality.store_status(validated(p))


@query(
    "registry_upsert",
    """SELECT route, airline, min(session_date) AS first_seen, max(session_date) AS last_seen FROM offers GROUP BY ALL""",
)
def registry_upsert(p):
    prior = quality.registry(p.offers.where("session_date < date '2026-04-20'"))
    return quality.registry(p.offers.where("session_date >= date '2026-04-20'"), prior)


@query(
    "latest_ready",
    """SELECT session_date, session_label, rows FROM batch_states WHERE status = 'READY'
ORDER BY session_date DESC, session_label DESC LIMIT 1""",
)
def latest_ready(p):
    return quality.latest_ready(validated(p)).select("session_date", "session_label", "rows")


view(
    "airline_cells",
    """SELECT session_key, route, flight_date, airline, min(price_vnd) AS mn, median(price_vnd) AS md, count(*) AS n
FROM offers GROUP BY ALL""",
)
view(
    "others",
    """SELECT a.session_key, a.route, a.flight_date, a.airline, min(b.mn) AS competitor_min_price_other_airlines,
max(b.md) - min(b.md) AS competitor_price_spread_other_airlines, count(*) AS competitor_airline_count,
CAST(sum(b.n) AS BIGINT) AS competitor_offer_count FROM airline_cells a JOIN airline_cells b
ON a.session_key = b.session_key AND a.route = b.route AND a.flight_date = b.flight_date AND a.airline <> b.airline GROUP BY ALL""",
)


@query("other_airline_context", "SELECT * FROM others")
def other_airline_context(p):
    return market.leave_group_out(p.offers)


view(
    "alternatives",
    """SELECT offer_id, n - 1 AS same_airline_alternative_count, CASE WHEN n > 1 THEN CASE WHEN price_vnd = m1 AND c1 = 1 THEN m2 ELSE m1 END END
AS same_airline_alternative_min_price FROM (SELECT *, min(CASE WHEN price_vnd > m1 THEN price_vnd END) OVER g AS m2,
count(*) FILTER (price_vnd = m1) OVER g AS c1 FROM (SELECT *, min(price_vnd) OVER g AS m1, count(*) OVER g AS n FROM offers
WINDOW g AS (PARTITION BY session_key, route, flight_date, airline))
WINDOW g AS (PARTITION BY session_key, route, flight_date, airline))""",
)


@query("same_airline_alternative", "SELECT * FROM alternatives")
def same_airline_alternative(p):
    return market.loo_min(p.offers).select("offer_id", "same_airline_alternative_count", "same_airline_alternative_min_price")


@query("loo_median", "SELECT offer_id, peer_anchor_support, peer_anchor_vnd FROM loo")
def loo_median(p):
    return market.loo_median(p.offers).select("offer_id", "peer_anchor_support", "peer_anchor_vnd")


@query(
    "peer_anchor",
    """SELECT offer_id, anchor_source, anchor_vnd, round(current_relative_log, 9) + 0e0 AS current_relative_log,
round(ln(anchor_vnd), 9) AS anchor_log FROM anchored""",
)
def peer_anchor(p):
    return p.anchored.select(
        "offer_id", "anchor_source", "anchor_vnd",
        (F.round("current_relative_log", 9) + 0.0).alias("current_relative_log"),
        F.round("anchor_log", 9).alias("anchor_log"),
    )


view(
    "perioded",
    f"""SELECT t.*, {band('departure_minute', C.DEPARTURE_PERIODS)} AS departure_period, s.source_session_key
FROM timed t JOIN session_links s USING (session_key)""",
)


def backoff_anchor_sql(levels: dict) -> str:
    parts, joins, value, support, label = [], [], "NULL", "NULL", "'UNAVAILABLE'"
    base = f"(SELECT *, {band('departure_minute', C.DEPARTURE_PERIODS)} AS departure_period FROM timed)"
    for i, (name, keys) in enumerate(levels.items()):
        cols = ", ".join(["session_key", *keys])
        parts.append(f"l{i} AS (SELECT {cols}, median(price_vnd) AS v, count(*) AS n FROM {base} GROUP BY ALL)")
        on = " AND ".join([f"l{i}.session_key = t.source_session_key", *[f"l{i}.{k} = t.{k}" for k in keys]])
        joins.append(f"LEFT JOIN l{i} ON {on}")
    cases = lambda column, names=None: "CASE " + " ".join(
        f"WHEN l{i}.v IS NOT NULL THEN " + (f"'{n}'" if names else f"l{i}.{column}") for i, n in enumerate(levels)
    ) + " END"
    return f"""WITH {', '.join(parts)} SELECT offer_id, {cases('v')} AS prior_anchor_vnd, {cases('n')} AS prior_anchor_support,
coalesce({cases('v', True)}, 'UNAVAILABLE') AS anchor_fallback_level FROM perioded t {' '.join(joins)}"""


def with_period(df):
    return df.withColumn("departure_period", K.right_closed_band("departure_minute", C.DEPARTURE_PERIODS))


ANCHOR = ["offer_id", "prior_anchor_vnd", "prior_anchor_support", "anchor_fallback_level"]


@query("hierarchical_anchor", backoff_anchor_sql(market.ANCHOR_LEVELS))
def hierarchical_anchor(p):
    return market.prior_batch_anchor(with_period(p.timed)).select(*ANCHOR)


@query("legacy_anchor", backoff_anchor_sql(market.LEGACY_LEVELS))
def legacy_anchor(p):
    return market.prior_batch_anchor(p.timed, market.LEGACY_LEVELS).select(*ANCHOR)


@query(
    "prior_market_context",
    """WITH s AS (SELECT session_key AS source_session_key, route, days_until_departure, min(price_vnd) AS lo, max(price_vnd) AS hi,
count(DISTINCT airline) AS airlines, count(*) AS n FROM timed GROUP BY ALL)
SELECT t.offer_id, s.lo AS prior_route_min_price, s.hi AS prior_route_max_price, s.airlines AS prior_competitor_airline_count,
s.n AS prior_competitor_offer_count, round(ln(s.lo), 9) AS prior_route_min_log_price,
round(ln(1e0 + s.hi - s.lo), 9) AS prior_route_price_spread_log1p
FROM (SELECT t.*, l.source_session_key FROM timed t LEFT JOIN session_links l USING (session_key)) t
LEFT JOIN s ON s.source_session_key = t.source_session_key AND s.route = t.route AND s.days_until_departure = t.days_until_departure""",
)
def prior_market_context(p):
    return market.prior_market_context(p.timed).select(
        "offer_id", "prior_route_min_price", "prior_route_max_price", "prior_competitor_airline_count",
        "prior_competitor_offer_count",
        F.round("prior_route_min_log_price", 9).alias("prior_route_min_log_price"),
        F.round("prior_route_price_spread_log1p", 9).alias("prior_route_price_spread_log1p"),
    )


view(
    "residual_rows",
    f"""SELECT *, {band('departure_minute', C.DEPARTURE_PERIODS)} AS departure_period FROM scored""",
)


def backoff_quantile_sql(probs: dict, default: str, default_level: str, extra: str = "") -> str:
    parts, joins = [], []
    for i, keys in enumerate(market.RESIDUAL_LEVELS.values()):
        qs = ", ".join(f"quantile_cont(y_log, {q}) AS {n}" for n, q in probs.items())
        parts.append(
            f"l{i} AS (SELECT {', '.join(keys)}, count(*) AS n, {qs} FROM residual_rows WHERE fold_set = 'SCREEN' "
            f"GROUP BY ALL HAVING count(*) >= {C.BACKOFF_MIN_SUPPORT})"
        )
        joins.append(f"LEFT JOIN l{i} ON " + " AND ".join(f"l{i}.{k} = t.{k}" for k in keys))
    pick = lambda c: "CASE " + " ".join(f"WHEN l{i}.n IS NOT NULL THEN l{i}.{c}" for i in range(len(joins))) + " END"
    label = "CASE " + " ".join(f"WHEN l{i}.n IS NOT NULL THEN '{n}'" for i, n in enumerate(market.RESIDUAL_LEVELS)) + f" ELSE '{default_level}' END"
    values = ", ".join(f"round(coalesce({pick(n)}, {default}), 9) + 0e0 AS {n}" for n in probs)
    return f"""WITH {', '.join(parts)} SELECT offer_id, {values}, coalesce({pick('n')}, 0) AS backoff_support, {label} AS backoff_level
FROM (SELECT * FROM residual_rows WHERE fold_set = 'LATE') t {' '.join(joins)}"""


@query("hierarchical_residual", backoff_quantile_sql({"backoff_value": 0.5}, "0e0", "ZERO_RESIDUAL_ANCHOR"))
def hierarchical_residual(p):
    df = with_period(p.scored)
    out = market.backoff_quantiles(df.where("fold_set = 'SCREEN'"), df.where("fold_set = 'LATE'"), "y_log")
    return out.select(
        "offer_id", (F.round("backoff_value", 9) + 0.0).alias("backoff_value"), "backoff_support", "backoff_level"
    )


SHRUNK = """WITH tr AS (SELECT * FROM scored WHERE fold_set = 'SCREEN'), g AS (SELECT (sum(drop_5pct) + 0.5e0) / (count(*) + 1e0) AS g FROM tr),
t AS (SELECT transition, sum(drop_5pct) AS k, count(*) AS n FROM tr GROUP BY 1),
c AS (SELECT route, airline, transition, sum(drop_5pct) AS k, count(*) AS n FROM tr GROUP BY ALL)
SELECT offer_id, round(greatest(least(coalesce((c.k + 1600e0 * parent) / (c.n + 1600e0), parent), 1 - 1e-6), 1e-6), 9) AS shrunk_rate
FROM (SELECT v.*, coalesce((t.k + 3000e0 * g.g) / (t.n + 3000e0), g.g) AS parent FROM scored v CROSS JOIN g LEFT JOIN t USING (transition)
WHERE fold_set = 'LATE') v LEFT JOIN c USING (route, airline, transition)"""


@query("shrunk_rate_fixed", SHRUNK)
def shrunk_rate_fixed(p):
    out = rates.shrunk_rate(p.scored.where("fold_set = 'SCREEN'"), p.scored.where("fold_set = 'LATE'"), "drop_5pct")
    return out.select("offer_id", F.round("shrunk_rate", 9).alias("shrunk_rate"))


@query("shrunk_rate_eb")
def shrunk_rate_eb(p):
    out = rates.shrunk_rate_eb(p.scored.where("fold_set = 'SCREEN'"), p.scored.where("fold_set = 'LATE'"), "drop_5pct")
    return out.select("offer_id", F.round("shrunk_rate", 9).alias("shrunk_rate"))


@query(
    "modal_value",
    """WITH c AS (SELECT route, days_until_departure, a, count(*) AS n FROM (SELECT *, CASE WHEN flight_no IS NOT NULL THEN airline END AS a
FROM offers) GROUP BY ALL),
m AS (SELECT *, max(CASE WHEN a IS NULL THEN -1 ELSE n END) OVER (PARTITION BY route, days_until_departure) AS mx FROM c)
SELECT route, days_until_departure, CASE WHEN max(mx) = -1 THEN 'UNKNOWN' WHEN count(*) FILTER (a IS NOT NULL AND n = mx) > 1 THEN 'MIXED'
ELSE min(CASE WHEN a IS NOT NULL AND n = mx THEN a END) END AS modal FROM m GROUP BY ALL""",
)
def modal_value(p):
    df = p.offers.withColumn("a", F.when(F.col("flight_no").isNotNull(), F.col("airline")))
    return market.modal_value(df, ["route", "days_until_departure"], "a")
