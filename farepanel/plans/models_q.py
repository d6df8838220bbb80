"""Queries over probability calibration and Spark ML model jobs; checked by rows, since learners are iterative."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.operators import calibration, market, metrics, models, serving, splits
from farepanel.plans.aggregates_q import with_period
from farepanel.plans.metrics_q import rounded
from farepanel.plans.registry import query
from farepanel.operators.pairs import exact_next_pairs
from farepanel.session import materialise
from farepanel.sources.panel import FOLDS, with_folds, with_quantiles

def raw_scores(p):
    """Fold rows with a raw score, the logit of the stand-in probability."""
    columns = ["offer_id", "fold_set", "drop_5pct", calibration.logit(F.col("p_drop")).alias("raw")]
    return materialise(p.scored.select(*columns), "scores")


def head_and_rest(df):
    return df.where("fold_set = 'SCREEN'"), df.where("fold_set = 'LATE'")


def calibrated(p, kind):
    head, rest = head_and_rest(raw_scores(p))
    model = calibration.fit_logistic(head, "drop_5pct", "raw", kind)
    out = calibration.apply_logistic(model, rest, "raw", kind, "calibrated")
    return out.select("offer_id", F.round("calibrated", 5).alias("calibrated"))


@query("platt")
def platt(p):
    return calibrated(p, "PLATT")


@query("beta")
def beta(p):
    return calibrated(p, "BETA")


@query(
    "isotonic",
    """WITH h AS (SELECT p_drop, count(*) AS w, sum(drop_5pct) AS s FROM scored WHERE fold_set = 'SCREEN' GROUP BY 1),
c AS (SELECT p_drop, row_number() OVER (ORDER BY p_drop) AS i, sum(w) OVER u AS cw, sum(s) OVER u AS cs, w, s FROM h WINDOW u AS (ORDER BY p_drop)),
f AS (SELECT a.i, m.i AS j, min((b.cs - m.cs + m.s) / CAST(b.cw - m.cw + m.w AS DOUBLE)) AS g FROM c a JOIN c m ON m.i <= a.i JOIN c b ON b.i >= a.i GROUP BY a.i, m.i),
v AS (SELECT p_drop, max(g) AS g FROM f JOIN c USING (i) GROUP BY ALL)
SELECT offer_id, round(g, 7) + 0e0 AS calibrated FROM scored JOIN v USING (p_drop) WHERE fold_set = 'LATE'""",
)
def isotonic(p):
    """SQL takes the monotone map as the largest of the smallest means of the ranges around a score."""
    head, rest = head_and_rest(raw_scores(p))
    model = calibration.fit_isotonic(head, "drop_5pct", "raw")
    out = calibration.apply_isotonic(model, rest, "raw", "calibrated")
    return out.select("offer_id", (F.round("calibrated", 7) + 0.0).alias("calibrated"))


@query("calibration_choice_p")
def calibration_choice_p(p):
    head, _ = head_and_rest(raw_scores(p))
    out = calibration.with_probability_recipes(head, head, "drop_5pct", "raw")
    return rounded(calibration.choose_probability_recipe(out, "drop_5pct", calibration.recipe_columns(out)), 4)


FRAME = (
    "offer_id", "session_date", "session_label", "flight_date", "departure_hhmm", "route", "airline", *models.NUMERIC,
    "target_price_vnd", "drop_5pct", "fold_set", "y_log",
)


def model_frame(p):
    """Exact pairs with strictly prior features, inside the fold calendar, written once per application for the iterative
    fits, with the columns that these read."""

    def build():
        frame = with_quantiles(with_folds(exact_next_pairs(p.featured_once, targets=p.timed), FOLDS, "session_date"))
        return frame.where(F.col("fold").isNotNull()).select(*dict.fromkeys(FRAME))

    return p.stored("frame", build)


@query("train_drop_classifier")
def train_drop_classifier(p):
    head, rest = head_and_rest(model_frame(p))
    model = models.train_classifier(head, "drop_5pct")
    return rounded(models.predict_probability(model, rest).select("offer_id", "probability"), 5)


@query("train_fare_regressor")
def train_fare_regressor(p):
    head, rest = head_and_rest(model_frame(p))
    model = models.train_regressor(head, "y_log")
    return rounded(models.predict_value(model, rest, "predicted_log").select("offer_id", "predicted_log"), 5)


def surface_sql() -> str:
    parts, joins = [], []
    table = {**market.RESIDUAL_LEVELS, "GLOBAL": ()}
    names = {f"q{int(q * 100):02d}": q for q in C.QUANTILES}
    for i, keys in enumerate(table.values()):
        qs = ", ".join(f"quantile_cont(y_log, {q}) AS {n}" for n, q in names.items())
        group = f"GROUP BY {', '.join(keys)} HAVING count(*) >= {C.BACKOFF_MIN_SUPPORT}" if keys else ""
        select = ", ".join([*keys, "count(*) AS n", qs])
        parts.append(f"l{i} AS (SELECT {select} FROM residual_rows WHERE fold_set = 'SCREEN' {group})")
        joins.append(f"LEFT JOIN l{i} ON " + (" AND ".join(f"l{i}.{k} = t.{k}" for k in keys) or "TRUE"))
    pick = lambda c: "CASE " + " ".join(f"WHEN l{i}.n IS NOT NULL THEN l{i}.{c}" for i in range(len(table))) + " END"
    label = "CASE " + " ".join(f"WHEN l{i}.n IS NOT NULL THEN '{n}'" for i, n in enumerate(table)) + " END"
    values = ", ".join(f"round({pick(n)}, 8) + 0e0 AS {n}" for n in names)
    return f"""WITH {', '.join(parts)} SELECT offer_id, {values}, {label} AS backoff_level
FROM (SELECT * FROM residual_rows WHERE fold_set = 'LATE') t {' '.join(joins)}"""


@query("fit_quantile_surface", surface_sql())
def fit_quantile_surface(p):
    head, rest = head_and_rest(with_period(p.scored))
    out = models.quantile_surface(head, rest, "y_log")
    return rounded(out.select("offer_id", *[f"q{int(q * 100):02d}" for q in C.QUANTILES], "backoff_level"))


@query("rank_scores")
def rank_scores(p):
    head, rest = head_and_rest(serving.query_ids(model_frame(p)))
    scored = models.rank_scores(head, rest).select("query_id", "offer_id", "score", "target_price_vnd")
    scored = materialise(scored, "scored")  # the metrics read it more than once
    return rounded(metrics.ranking_metrics(scored, "score", "target_price_vnd"), 5)


@query("candidate_grid")
def candidate_grid(p):
    frame = materialise(splits.outer_split(exact_next_pairs(p.feature_table), FOLDS), "split")
    candidates = {"GBT_D4": {}, "GBT_D3": {"depth": 3}, "LOGISTIC": {"family": "LOGISTIC"}}
    return rounded(models.candidate_grid(frame, "drop_5pct", candidates, [f[0] for f in FOLDS], [17, 29, 41]), 4)


@query("boosted_quantile_surface")
def boosted_quantile_surface(p):
    head, rest = head_and_rest(model_frame(p))
    model = models.fit_quantile_boost(head, "y_log")
    out = models.predict_quantiles(model, rest.drop("quantiles"))
    names = [f"q{int(q * 100):02d}" for q in C.QUANTILES]
    return rounded(out.select("offer_id", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)]), 5)


@query("score_frames")
def score_frames(p):
    head, rest = head_and_rest(model_frame(p))
    members = [models.train_regressor(head, "y_log", seed=s) for s in (17, 29)]
    out = models.score_frames(members, rest, head, "price_vnd", "y_log")
    return rounded(out.select("offer_id", "predicted_vnd", "aligned"), 1)
