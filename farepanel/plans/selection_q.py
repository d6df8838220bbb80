"""Queries over ordering, top-k, samplers, unions, splits, weights and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.operators import quality, selection, serving, splits
from farepanel.plans.history_q import r
from farepanel.plans.panel_views import band
from farepanel.plans.registry import query, view
from farepanel.sources.panel import BLOCKS, CUTOFF, FOLDS

# --- order, top-k, sampling -----------------------------------------------------------------


@query("canonical_sort", "SELECT offer_id, scraped_at, route, price_vnd FROM raw_offers ORDER BY scraped_at, session_id, route")
def canonical_sort(p):
    return selection.canonical_sort(p.raw).select("offer_id", "scraped_at", "route", "price_vnd")


@query(
    "topk_ranked_offers",
    """SELECT query_id, offer_id, row_number() OVER w AS rank, row_number() OVER w = 1 AS is_cheapest FROM queried
WINDOW w AS (PARTITION BY query_id ORDER BY pred_vnd, departure_hhmm, airline, offer_id)""",
)
def topk_ranked_offers(p):
    return serving.ranked_offers(serving.query_ids(p.offers)).select("query_id", "offer_id", "rank", "is_cheapest")


LIMIT = 5000
EVEN = "(n <= {lim} OR (CAST(ceil(pos * {lim1}e0 / greatest(n - 1, 1)) AS BIGINT) * (n - 1) // {lim1} = pos AND CAST(ceil(pos * {lim1}e0 / greatest(n - 1, 1)) AS BIGINT) <= {lim1}))"


@query(
    "stratified_head",
    f"""WITH g AS (SELECT greatest(8, ceil({LIMIT}e0 / count(*))) AS quota FROM (SELECT DISTINCT session_date, drop_5pct FROM exact_pairs)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_date, drop_5pct ORDER BY offer_id) AS rn FROM exact_pairs), g WHERE rn <= quota),
s AS (SELECT *, row_number() OVER (ORDER BY session_date, drop_5pct, offer_id) - 1 AS pos, count(*) OVER () AS n FROM h)
SELECT offer_id, session_date, drop_5pct FROM s WHERE n <= {LIMIT} OR pos IN (SELECT i * (n - 1) // {LIMIT - 1}
FROM range({LIMIT}) t(i), (SELECT count(*) AS n FROM h))""",
)
def stratified_head(p):
    return selection.stratified_head(p.exact_pairs, "session_date", "drop_5pct", "offer_id", LIMIT).select(
        "offer_id", "session_date", "drop_5pct"
    )


@query(
    "balanced_recent",
    """WITH d AS (SELECT DISTINCT session_date FROM exact_pairs ORDER BY session_date DESC LIMIT 24),
w AS (SELECT * FROM exact_pairs WHERE session_date IN (SELECT session_date FROM d)),
g AS (SELECT greatest(8, 4096 // count(*)) AS quota FROM (SELECT DISTINCT session_date, drop_5pct FROM w))
SELECT offer_id, session_date, drop_5pct FROM (SELECT *, row_number() OVER (PARTITION BY session_date, drop_5pct ORDER BY offer_id) AS rn FROM w), g
WHERE rn <= quota""",
)
def balanced_recent(p):
    return selection.balanced_recent(p.exact_pairs, "session_date", "drop_5pct", "offer_id").select(
        "offer_id", "session_date", "drop_5pct"
    )


@query(
    "balanced_recent_continuous",
    """WITH d AS (SELECT DISTINCT session_date FROM exact_pairs ORDER BY session_date DESC LIMIT 24),
w AS (SELECT *, row_number() OVER (ORDER BY offer_id) - 1 AS pos, count(*) OVER () AS n FROM exact_pairs WHERE session_date IN (SELECT session_date FROM d))
SELECT offer_id, session_date, price_change_vnd FROM w WHERE n <= 4096 OR pos IN (SELECT i * (n - 1) // 4095 FROM range(4096) t(i), (SELECT max(n) AS n FROM w))""",
)
def balanced_recent_continuous(p):
    """A target with more than 20 values has no quotas: evenly spaced rows instead."""
    return selection.balanced_recent(p.exact_pairs, "session_date", "price_change_vnd", "offer_id").select(
        "offer_id", "session_date", "price_change_vnd"
    )


@query(
    "even_sample",
    """WITH s AS (SELECT offer_id, price_vnd, row_number() OVER (ORDER BY offer_id) - 1 AS pos, count(*) OVER () AS n FROM offers)
SELECT offer_id, price_vnd FROM s WHERE pos IN (SELECT i * (n - 1) // 255 FROM range(256) t(i), (SELECT count(*) AS n FROM offers))""",
)
def even_sample(p):
    return selection.even_sample(p.offers.select("offer_id", "price_vnd"), "offer_id", 256)


view(
    "screen_scores",
    """SELECT fold_set AS task, transition AS candidate_id, avg(s) AS score, stddev_pop(s) AS std FROM (SELECT fold_set, fold, transition,
avg((p_drop - drop_5pct) * (p_drop - drop_5pct)) AS s FROM scored GROUP BY ALL) GROUP BY ALL""",
)


@query(
    "recipe_ranking",
    """SELECT task, candidate_id, round(score, 9) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY task
ORDER BY round(score, 9), round(std, 9), candidate_id) AS INTEGER) AS rank FROM screen_scores) WHERE rank <= 2""",
)
def recipe_ranking(p):
    loss = F.pow(F.col("p_drop") - F.col("drop_5pct"), 2)
    folds = p.scored.groupBy("fold_set", "fold", "transition").agg(F.avg(loss).alias("s"))
    table = folds.groupBy(F.col("fold_set").alias("task"), F.col("transition").alias("candidate_id")).agg(
        F.round(F.avg("s"), 9).alias("score"), F.round(F.stddev_pop("s"), 9).alias("std")
    )
    return selection.topk_per_group(table, ["task"], ["score", "std", "candidate_id"], 2).drop("std")


@query(
    "observed_query",
    f"""SELECT route, flight_date, airline, departure_hhmm, feature_time, session_key, offer_id, price_vnd, days_until_departure
FROM (SELECT *, row_number() OVER (PARTITION BY route, flight_date, airline, departure_hhmm ORDER BY feature_time DESC, session_key DESC, offer_id DESC) AS rn
FROM timed WHERE (route, flight_date) IN (SELECT route, flight_date FROM orders_asked)) WHERE rn = 1""".replace(
        "orders_asked", "(SELECT route, flight_date FROM offers WHERE days_until_departure = 7)"
    ),
)
def observed_query(p):
    asked = p.offers.where("days_until_departure = 7").select("route", "flight_date")
    return serving.observed_query(p.timed, asked)


# --- set operations -------------------------------------------------------------------------

IDENT = ", ".join(quality.IDENTITY)


@query(
    "union_sources",
    f"""SELECT {IDENT}, scraped_at, price_vnd, remark FROM (SELECT *, row_number() OVER (PARTITION BY {IDENT}
ORDER BY scraped_at DESC, price_vnd DESC, remark DESC NULLS LAST) AS rn FROM (
SELECT {IDENT}, scraped_at, price_vnd, NULL AS remark FROM offers
UNION ALL SELECT {IDENT}, scraped_at + INTERVAL 10 MINUTE, price_vnd + 1000, 'manual' FROM offers WHERE airline = '9G')) WHERE rn = 1""",
)
def union_sources(p):
    base = p.offers.select(*quality.IDENTITY, "scraped_at", "price_vnd")
    manual = (
        base.where("airline = '9G'")
        .withColumn("scraped_at", F.col("scraped_at") + F.expr("INTERVAL '10' MINUTE"))
        .withColumn("price_vnd", F.col("price_vnd") + 1000)
        .withColumn("remark", F.lit("manual"))
    )
    return quality.union_sources([base, manual]).select(*quality.IDENTITY, "scraped_at", "price_vnd", "remark")


@query(
    "expanding_refit",
    f"""SELECT offer_id, session_date FROM offers WHERE session_date <= DATE '{BLOCKS[0][2]}'""",
)
def expanding_refit(p):
    cols = p.offers.select("offer_id", "session_date")
    start = BLOCKS[0][1]
    return quality.union_strict(
        cols.where(f"session_date < date '{start}'"),
        cols.where(f"session_date between date '{start}' and date '{BLOCKS[0][2]}'"),
    )


@query(
    "key_intersect",
    """SELECT DISTINCT schedule_slot_id FROM offers WHERE days_until_departure = 60 AND schedule_slot_id IN
(SELECT schedule_slot_id FROM offers WHERE days_until_departure = 1)""",
)
def key_intersect(p):
    a = p.offers.where("days_until_departure = 60").select("schedule_slot_id")
    return a.intersect(p.offers.where("days_until_departure = 1").select("schedule_slot_id"))


@query(
    "key_except",
    """SELECT DISTINCT schedule_slot_id FROM offers WHERE schedule_slot_id NOT IN (SELECT schedule_slot_id FROM offers WHERE days_until_departure = 1 AND session_label = 'AM')""",
)
def key_except(p):
    keys = p.offers.select("schedule_slot_id").distinct()
    return keys.join(p.offers.where("days_until_departure = 1 and session_label = 'AM'").select("schedule_slot_id"), "schedule_slot_id", "left_anti")


# --- splits ---------------------------------------------------------------------------------

FOLD_VALUES = ", ".join(
    f"('{n}', '{role}', TIMESTAMP '{a} 00:00:00', CAST(DATE '{b}' + 1 AS TIMESTAMP))" for n, role, a, b in FOLDS
)
view("fold_table", f"SELECT * FROM (VALUES {FOLD_VALUES}) f(fold, fold_role, fold_start, fold_end)")
view(
    "split_rows",
    """SELECT * FROM (SELECT *, CASE WHEN feature_time < fold_start AND label_time < fold_start THEN 'TRAIN'
WHEN feature_time >= fold_start AND feature_time < fold_end THEN 'VALID' END AS role FROM exact_pairs, fold_table) WHERE role IS NOT NULL""",
)
view(
    "split_rows_label",
    """SELECT * FROM (SELECT *, CASE WHEN label_time < fold_start THEN 'TRAIN'
WHEN label_time >= fold_start AND label_time < fold_end THEN 'VALID' END AS role FROM exact_pairs, fold_table) WHERE role IS NOT NULL""",
)


def split(p, mode="CLASSIFICATION"):
    return splits.outer_split(p.exact_pairs, FOLDS, mode)


def role_counts(df, *extra):
    return df.groupBy("fold", *extra).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("drop_5pct").alias("drops"),
        F.max("label_time").alias("last_label"),
        F.sum(F.col("offer_id") % 1000003).alias("id_sum"),
    )


ROLE_SQL = """count(*) AS rows, CAST(sum(drop_5pct) AS BIGINT) AS drops, max(label_time) AS last_label,
CAST(sum(offer_id % 1000003) AS BIGINT) AS id_sum"""


@query(
    "outer_split",
    f"""SELECT 'CLASSIFICATION' AS mode, fold, role, {ROLE_SQL} FROM split_rows GROUP BY ALL
UNION ALL SELECT 'REGRESSION', fold, role, {ROLE_SQL} FROM split_rows_label GROUP BY ALL""",
)
def outer_split(p):
    a = role_counts(split(p), "role").withColumn("mode", F.lit("CLASSIFICATION"))
    return a.unionByName(role_counts(split(p, "REGRESSION"), "role").withColumn("mode", F.lit("REGRESSION")))


@query(
    "apply_window",
    f"SELECT fold, {ROLE_SQL} FROM split_rows WHERE role = 'TRAIN' AND feature_time >= fold_start - INTERVAL 28 DAY GROUP BY ALL",
)
def apply_window(p):
    return role_counts(splits.apply_window(split(p).where("role = 'TRAIN'"), 28))


def tail_sql(time: str, reserve: str, minimum: str, source: str, parts: str) -> str:
    return f"""WITH tr AS (SELECT * FROM {source} WHERE role = 'TRAIN'),
d AS (SELECT fold, CAST({time} AS DATE) AS d FROM tr GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY d DESC) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM d),
o AS (SELECT fold, CAST(d AS TIMESTAMP) AS origin FROM dr WHERE {minimum} AND rn = {reserve})
SELECT fold, part, {ROLE_SQL} FROM (SELECT *, {parts} AS part FROM tr JOIN o USING (fold)) WHERE part IS NOT NULL GROUP BY ALL"""


@query(
    "inner_split",
    tail_sql(
        "feature_time", "least(greatest(6, CAST(ceil(n * 0.15e0) AS BIGINT)), n - 10)", "n >= 16", "split_rows",
        "CASE WHEN feature_time < origin AND label_time < origin THEN 'FIT' WHEN feature_time >= origin THEN 'HEAD' END",
    ),
)
def inner_split(p):
    return role_counts(splits.inner_split(split(p).where("role = 'TRAIN'")), "part")


@query(
    "calibration_split",
    tail_sql(
        "feature_time", "greatest(3, CAST(ceil(n * 0.2e0) AS BIGINT))", "n > greatest(3, CAST(ceil(n * 0.2e0) AS BIGINT)) + 3",
        "split_rows",
        "CASE WHEN feature_time < origin AND label_time < origin THEN 'FIT' WHEN feature_time >= origin THEN 'CALIBRATION' END",
    ),
)
def calibration_split(p):
    return role_counts(splits.calibration_split(split(p).where("role = 'TRAIN'"), target="drop_5pct"), "part")


@query(
    "event_split",
    f"""SELECT fold, role, count(*) AS rows, CAST(sum(reobserved) AS BIGINT) AS reobserved, max(outcome_time) AS last_outcome FROM (
SELECT *, CASE WHEN feature_time < fold_start AND outcome_time < fold_start THEN 'TRAIN'
WHEN feature_time >= fold_start AND feature_time < fold_end THEN 'VALID' END AS role FROM (SELECT *,
CAST(target_observation_state = 'OBSERVED' AS INTEGER) AS reobserved, CAST(expected_label_date + 1 AS TIMESTAMP) AS outcome_time FROM ledger
WHERE target_observation_state <> 'IMMATURE_RIGHT_CENSORED'), fold_table WHERE feature_time < outcome_time) WHERE role IS NOT NULL GROUP BY ALL""",
)
def event_split(p):
    from farepanel.operators import pairs

    frame = pairs.reobservation(p.timed, pairs.observability(p.timed, CUTOFF))
    out = splits.outer_split(frame, FOLDS, "CLASSIFICATION", "feature_time", "outcome_time")
    return out.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("reobserved").alias("reobserved"), F.max("outcome_time").alias("last_outcome")
    )


@query(
    "bridge_policy",
    f"""SELECT fold, role, {ROLE_SQL} FROM split_rows WHERE NOT (role = 'TRAIN' AND source_target_era_transition = '{C.BRIDGE_TRANSITION}') GROUP BY ALL""",
)
def bridge_policy(p):
    return role_counts(splits.bridge_filter(split(p)), "role")


@query(
    "fold_tags",
    f"""WITH c AS (SELECT fold, route, airline, count(*) AS n FROM split_rows WHERE role = 'TRAIN' GROUP BY ALL),
rt AS (SELECT fold, route, count(*) AS a, sum(n) AS s FROM c GROUP BY ALL),
q AS (SELECT fold, route, a, row_number() OVER (PARTITION BY fold ORDER BY s, route) / CAST(count(*) OVER (PARTITION BY fold) AS DOUBLE) AS sh FROM rt)
SELECT fold, offer_id, coalesce(c.n, 0) AS train_route_airline_support, {band('coalesce(c.n, 0)', C.ANCHOR_SUPPORT_BANDS)} AS route_airline_support_band,
CASE WHEN a >= 5 THEN 'UNIVERSAL_5' WHEN a = 4 THEN 'BROAD_4_5' WHEN a >= 2 THEN 'MID_2_3' WHEN a = 1 THEN 'SINGLE_1' ELSE 'UNOBSERVED_0' END AS coverage_band,
CASE WHEN a >= 4 THEN 'HIGH_SUPPORT' ELSE 'LOWER_SUPPORT' END AS support_tier,
CASE WHEN sh <= 0.25 THEN 'Q1_LOW' WHEN sh <= 0.5 THEN 'Q2' WHEN sh <= 0.75 THEN 'Q3' WHEN sh IS NOT NULL THEN 'Q4_HIGH' ELSE 'UNSEEN' END AS route_support_quartile
FROM (SELECT * FROM split_rows WHERE role = 'VALID') v LEFT JOIN c USING (fold, route, airline) LEFT JOIN q USING (fold, route)""",
)
def fold_tags(p):
    return splits.fold_tags(split(p)).select(
        "fold", "offer_id", "train_route_airline_support", "route_airline_support_band", "coverage_band", "support_tier",
        "route_support_quartile",
    )


# --- weights and encoders -------------------------------------------------------------------


@query(
    "balanced_weights",
    """SELECT offer_id, round(w / avg(w) OVER (), 7) AS weight FROM (SELECT offer_id, count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY drop_5pct)) AS w FROM exact_pairs)""",
)
def balanced_weights(p):
    return splits.balanced_weights(p.exact_pairs, "drop_5pct").select("offer_id", r("weight", 7))


@query(
    "market_weights",
    """SELECT offer_id, round(w / avg(w) OVER (), 7) AS weight FROM (SELECT offer_id, w1 * greatest(least(m / avg(m) OVER (), 3e0), 0.35e0) AS w FROM (
SELECT offer_id, m, w0 / avg(w0) OVER () AS w1 FROM (SELECT offer_id, count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY drop_5pct)) AS w0,
1e0 / sqrt(count(*) OVER (PARTITION BY route)) AS m FROM exact_pairs)))""",
)
def market_weights(p):
    return splits.market_weights(p.exact_pairs, "drop_5pct").select("offer_id", r("weight", 7))


@query(
    "economic_weights",
    """WITH e AS (SELECT *, CASE WHEN drop_5pct = 1 THEN greatest(CAST(price_vnd - target_price_vnd AS DOUBLE), 25000e0) ELSE 25000e0 END AS e FROM exact_pairs),
m AS (SELECT quantile_cont(e, 0.5) AS med, count(DISTINCT transition) AS k FROM e)
SELECT offer_id, round(w / avg(w) OVER (), 7) AS weight FROM (SELECT offer_id, (count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY drop_5pct)))
* greatest(least(e / greatest(med, 1e0), 4e0), 0.25e0) * (count(*) OVER () / (CAST(k AS DOUBLE) * count(*) OVER (PARTITION BY transition))) AS w FROM e, m)""",
)
def economic_weights(p):
    return splits.economic_weights(p.exact_pairs, "drop_5pct").select("offer_id", r("weight", 7))


NUMERIC = ("price_vnd", "days_until_departure", "departure_minute", "prior_relative_volatility", "previous_price_same_schedule")
CATEGORICAL = ("route", "airline", "session_label")


def encoder_rows(p):
    cut = F.lit("2026-05-03").cast("date")
    return p.feature_table.where(F.col("session_date") < cut), p.feature_table.where(F.col("session_date") >= cut)


ENC = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", median, avg(coalesce({c}, median)) AS mean, stddev_pop(coalesce({c}, median)) AS s
FROM (SELECT CAST({c} AS DOUBLE) AS {c}, coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER (), 0) AS median FROM featured WHERE session_date < DATE '2026-05-03') GROUP BY median"""
    for c in NUMERIC
)
view("encoder_state", ENC)


@query(
    "fit_encoder",
    """SELECT "column", round(median, 6) + 0e0 AS median, round(mean, 6) + 0e0 AS mean, round(CASE WHEN s > 1e-8 THEN s ELSE 1 END, 6) AS scale FROM encoder_state""",
)
def fit_encoder(p):
    state = splits.fit_numeric_encoder(encoder_rows(p)[0], NUMERIC)
    return state.select("column", r("median", 6), r("mean", 6), F.round("scale", 6).alias("scale"))


@query(
    "apply_encoder",
    "WITH "
    + ", ".join(
        f"k_{c} AS (SELECT {c}, CAST(row_number() OVER (ORDER BY {c}) AS INTEGER) AS code FROM (SELECT DISTINCT {c} FROM offers WHERE session_date < DATE '2026-05-03'))"
        for c in CATEGORICAL
    )
    + " SELECT f.offer_id, "
    + ", ".join(f"coalesce(k_{c}.code, 0) AS {c}_code" for c in CATEGORICAL)
    + ", "
    + ", ".join(
        f"round((coalesce(f.{c}, e_{c}.median) - e_{c}.mean) / e_{c}.s, 6) + 0e0 AS {c}_z" for c in NUMERIC
    )
    + " FROM featured f "
    + " ".join(f"LEFT JOIN k_{c} ON f.{c} = k_{c}.{c}" for c in CATEGORICAL)
    + " "
    + " ".join(f"""JOIN encoder_state e_{c} ON e_{c}."column" = '{c}'""" for c in NUMERIC)
    + " WHERE f.session_date >= DATE '2026-05-03'",
)
def apply_encoder(p):
    fit, rest = encoder_rows(p)
    codes = splits.fit_category_codes(fit, CATEGORICAL)
    state = splits.fit_numeric_encoder(fit, NUMERIC)
    out = splits.apply_encoder(rest, codes, state, CATEGORICAL, NUMERIC)
    return out.select("offer_id", *[f"{c}_code" for c in CATEGORICAL], *[r(f"{c}_z", 6) for c in NUMERIC])


@query(
    "rank_relevance",
    """SELECT offer_id, CAST(greatest(least(floor((1e0 - rk / n) * 5e0), 4), 0) AS INTEGER) AS relevance FROM (SELECT offer_id,
rank() OVER w + (count(*) OVER (PARTITION BY query_id, price_vnd) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY query_id) AS n
FROM queried WINDOW w AS (PARTITION BY query_id ORDER BY price_vnd)) WHERE n >= 2""",
)
def rank_relevance(p):
    return splits.rank_relevance(serving.query_ids(p.offers), price="price_vnd").select("offer_id", "relevance")


@query(
    "feature_variants",
    """WITH a AS (SELECT DISTINCT airline AS adapter, airline = '9G' AS short FROM offers)
SELECT adapter, 1 AS step, 'STATIC' AS variant, 'route,departure_period,' || adapter AS features FROM a
UNION ALL SELECT adapter, 2, 'STATIC_MARKET', 'route,departure_period,' || adapter || CASE WHEN short THEN '' ELSE ',market_median,market_age' END FROM a
UNION ALL SELECT adapter, 3, 'STATIC_MARKET_DIRECTION', 'route,departure_period,' || adapter || CASE WHEN short THEN '' ELSE ',market_median,market_age' END || ',market_change' FROM a""",
)
def feature_variants(p):
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    adapters = p.offers.select(F.col("airline").alias("adapter")).distinct().select(
        "adapter",
        F.concat(names("route", "departure_period"), F.array("adapter")).alias("static"),
        F.when(F.col("adapter") == "9G", F.array().cast("array<string>"))
        .otherwise(names("market_median", "market_age", "route"))
        .alias("market"),
        names("market_change").alias("direction"),
    )
    return splits.resolve_variants(adapters).withColumn("features", F.array_join("features", ","))
