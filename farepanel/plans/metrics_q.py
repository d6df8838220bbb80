"""Queries over scores, rankings, uncertainty, recipes, decisions and conformal calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import calibration, metrics, policy, serving
from farepanel.plans.history_q import r
from farepanel.plans.panel_views import band
from farepanel.operators.scale import join_on
from farepanel.plans.registry import query, view
from farepanel.session import materialise
from farepanel.sources.panel import BLOCKS

Y, P = "drop_5pct", "p_drop"


def rounded(df, digits: int = 8):
    """Every double rounded, without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, t in df.dtypes if t == "double"})


def rsql(expr: str, name: str, digits: int = 8) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


# --- probabilities --------------------------------------------------------------------------

ECE = """SELECT fold, sum(n * abs(rate - mean)) / sum(n) AS ece15 FROM (SELECT fold, least(floor(p_drop * 15), 14) AS b, count(*) AS n,
avg(drop_5pct) AS rate, avg(p_drop) AS mean FROM scored GROUP BY ALL) GROUP BY fold"""
AUC = """SELECT fold, (sum(CASE WHEN drop_5pct = 1 THEN rk END) - max(np) * (max(np) + 1) / 2e0) / (max(np) * max(nn)) AS auc FROM (
SELECT fold, drop_5pct, rank() OVER (PARTITION BY fold ORDER BY p_drop) + (count(*) OVER (PARTITION BY fold, p_drop) - 1) / 2e0 AS rk,
CAST(sum(drop_5pct) OVER (PARTITION BY fold) AS DOUBLE) AS np, CAST(sum(1 - drop_5pct) OVER (PARTITION BY fold) AS DOUBLE) AS nn FROM scored) GROUP BY fold"""
view("ece_fold", ECE)
view("auc_fold", AUC)
view(
    "class_fold",
    """SELECT fold, count(*) AS rows, avg(-CASE WHEN drop_5pct = 1 THEN ln(p_drop) ELSE ln(1 - p_drop) END) AS log_loss,
avg((p_drop - drop_5pct) * (p_drop - drop_5pct)) AS brier FROM scored GROUP BY fold""",
)


@query(
    "classification_metrics",
    f"""SELECT fold, rows, {rsql('log_loss', 'log_loss')}, {rsql('brier', 'brier')}, {rsql('ece15', 'ece15')}, {rsql('auc', 'auc')},
{rsql('log_loss + brier', 'proper_score')} FROM class_fold JOIN ece_fold USING (fold) JOIN auc_fold USING (fold)""",
)
def classification_metrics(p):
    return rounded(metrics.classification_metrics(p.scored, Y, P, ["fold"]))


@query("ece", f"SELECT fold, {rsql('ece15', 'ece15')} FROM ece_fold")
def ece(p):
    return rounded(metrics.ece(p.scored, Y, P, ["fold"]))


@query("roc_auc", f"SELECT fold, {rsql('auc', 'auc')} FROM auc_fold")
def roc_auc(p):
    return rounded(metrics.roc_auc(p.scored, Y, P, ["fold"]))


view(
    "score_points",
    """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS np, sum(neg) OVER (PARTITION BY fold) AS nn
FROM (SELECT fold, p_drop, CAST(sum(drop_5pct) AS DOUBLE) AS pos, CAST(sum(1 - drop_5pct) AS DOUBLE) AS neg FROM scored GROUP BY ALL)
WINDOW w AS (PARTITION BY fold ORDER BY p_drop DESC)""",
)


@query("average_precision", f"SELECT fold, {rsql('sum(pos / np * (tp / (tp + fp)))', 'pr_auc')} FROM score_points GROUP BY fold")
def average_precision(p):
    return rounded(metrics.average_precision(p.scored, Y, P, ["fold"]))


@query(
    "roc_pr_curves",
    f"""SELECT fold, {rsql('p_drop', 'threshold')}, {rsql('tp / np', 'tpr')}, {rsql('fp / nn', 'fpr')}, {rsql('tp / (tp + fp)', 'precision')} FROM score_points""",
)
def roc_pr_curves(p):
    return rounded(metrics.roc_pr_curves(p.scored, Y, P, ["fold"]))


# --- points and quantiles -------------------------------------------------------------------


def point_sql(y: str, q: str, by: str, source: str) -> str:
    e = f"(greatest({q}, 1) - greatest({y}, 1))"
    t = f"CAST(greatest({y}, 1) AS DOUBLE)"
    return f"""SELECT {by}, count(*) AS rows, {rsql(f'avg(abs({e}))', 'mae', 4)}, {rsql(f'sqrt(avg(CAST({e} AS DOUBLE) * {e}))', 'rmse', 4)},
{rsql(f'avg(abs({e}) / {t})', 'mape')}, {rsql(f'avg({e})', 'bias', 4)},
{rsql(f'1 - sum(CAST({e} AS DOUBLE) * {e}) / (var_pop({t}) * count(*))', 'r2')},
{rsql(f'quantile_cont(abs({e}) / {t}, 0.5)', 'median_ape')} FROM {source} GROUP BY {by}"""


@query("point_metrics", point_sql("price_vnd", "pred_vnd", "airline", "offers"))
def point_metrics(p):
    out = metrics.point_metrics(p.offers, "price_vnd", "pred_vnd", ["airline"])
    return out.select("airline", "rows", r("mae", 4), r("rmse", 4), r("mape", 8), r("bias", 4), r("r2", 8), r("median_ape", 8))


LEVELS = C.QUANTILES
view(
    "arranged",
    "SELECT *, " + ", ".join(f"greatest({', '.join(f'q{j}' for j in range(i + 1))}) AS r{i}" for i in range(7)) + " FROM blocked",
)
PIN = "(" + " + ".join(
    f"greatest({l}e0 * (y_log - r{i}), {l - 1:.2f}e0 * (y_log - r{i}))" for i, l in enumerate(LEVELS)
) + ") / 7e0"


@query(
    "distribution_metrics",
    f"""SELECT block_id, count(*) AS rows, {rsql(f'2 * avg({PIN})', 'wis')}, {rsql(f'avg({PIN})', 'pinball_mean')},
{rsql('avg(CAST(y_log >= r2 AND y_log <= r4 AS DOUBLE))', 'coverage50')}, {rsql('avg(CAST(y_log >= r1 AND y_log <= r5 AS DOUBLE))', 'coverage80')},
{rsql('avg(CAST(y_log >= r0 AND y_log <= r6 AS DOUBLE))', 'coverage90')}, {rsql('avg(r4 - r2)', 'width50')}, {rsql('avg(r5 - r1)', 'width80')},
{rsql('avg(r6 - r0)', 'width90')}, {rsql('avg(CAST(y_log < r0 AS DOUBLE))', 'lower_tail90')}, {rsql('avg(CAST(y_log > r6 AS DOUBLE))', 'upper_tail90')},
{rsql('avg(CAST(' + ' OR '.join(f'q{i + 1} < q{i}' for i in range(6)) + ' AS DOUBLE))', 'crossing_rate')} FROM arranged GROUP BY block_id""",
)
def distribution_metrics(p):
    return rounded(metrics.distribution_metrics(p.blocks, "y_log", "quantiles", ["block_id"]))


@query("distribution_row_loss", f"SELECT offer_id, {rsql(f'2 * ({PIN})', 'wis')} FROM arranged")
def distribution_row_loss(p):
    return p.blocks.select("offer_id", (F.round(K.wis("y_log", K.rearrange("quantiles")), 8) + 0.0).alias("wis"))


# --- ranking --------------------------------------------------------------------------------

view(
    "rank_rows",
    """SELECT *, count(*) OVER (PARTITION BY query_id) AS n, -(pred_vnd // 20000) AS score,
count(*) OVER (PARTITION BY query_id) - (rank() OVER (PARTITION BY query_id ORDER BY price_vnd) + (count(*) OVER (PARTITION BY query_id, price_vnd) - 1) / 2e0) + 1 AS rel
FROM queried""",
)
view(
    "ndcg_rows",
    """SELECT query_id, sum(CASE WHEN a <= 5 THEN g / log2(a + 1) ELSE 0 END) / sum(CASE WHEN b <= 5 THEN g / log2(b + 1) ELSE 0 END) AS ndcg5 FROM (
SELECT query_id, pow(2e0, rel - n) - pow(2e0, -n) AS g, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, offer_id) AS a,
row_number() OVER (PARTITION BY query_id ORDER BY price_vnd, offer_id) AS b FROM rank_rows WHERE n >= 2) GROUP BY query_id""",
)
view(
    "concordance_rows",
    """SELECT query_id, coalesce(count(*) FILTER (x.price_vnd <> y.price_vnd), 0) AS informative_pairs,
coalesce(count(*) FILTER (x.price_vnd < y.price_vnd AND x.score > y.score OR x.price_vnd > y.price_vnd AND x.score < y.score)
 / CAST(nullif(count(*) FILTER (x.price_vnd <> y.price_vnd), 0) AS DOUBLE), 0.5e0) AS concordance
FROM rank_rows x JOIN rank_rows y USING (query_id) WHERE x.offer_id < y.offer_id GROUP BY query_id""",
)


def rank_rows(p):
    return serving.query_ids(p.offers).withColumn("score", -F.expr("pred_vnd div 20000"))


@query("ndcg_at_5", f"SELECT query_id, {rsql('ndcg5', 'ndcg5')} FROM ndcg_rows")
def ndcg_at_5(p):
    return rounded(metrics.ndcg(rank_rows(p), "score", "price_vnd"))


@query(
    "pairwise_concordance",
    f"SELECT query_id, CAST(informative_pairs AS DOUBLE) AS informative_pairs, {rsql('concordance', 'concordance')} FROM concordance_rows",
)
def pairwise_concordance(p):
    return rounded(metrics.concordance(rank_rows(p), "score", "price_vnd"))


@query(
    "ranking_metrics",
    f"""SELECT {rsql('avg(ndcg5)', 'ndcg5')}, {rsql('avg(concordance)', 'pairwise_concordance')}, count(*) AS queries
FROM ndcg_rows JOIN concordance_rows USING (query_id)""",
)
def ranking_metrics(p):
    return rounded(metrics.ranking_metrics(rank_rows(p), "score", "price_vnd"))


# --- thresholds -----------------------------------------------------------------------------

COUNTS = """count(*) AS rows, count(*) FILTER (NOT h AND y = 0) AS tn, count(*) FILTER (h AND y = 0) AS fp,
count(*) FILTER (NOT h AND y = 1) AS fn, count(*) FILTER (h AND y = 1) AS tp"""
RATES = ", ".join(
    [
        rsql("(tp + fn) / CAST(rows AS DOUBLE)", "prevalence"),
        rsql("(tp + tn) / CAST(rows AS DOUBLE)", "accuracy"),
        rsql("(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) + coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0)) / 2", "balanced_accuracy"),
        rsql("(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2e0 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2", "macro_f1"),
        rsql("coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)", "drop_precision"),
        rsql("coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)", "drop_recall"),
        rsql("coalesce(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 0)", "no_drop_precision"),
        rsql("coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0)", "no_drop_recall"),
    ]
)


@query(
    "confusion_at_threshold",
    f"SELECT fold, rows, tn, fp, fn, tp, {RATES} FROM (SELECT fold, {COUNTS} FROM (SELECT fold, p_drop >= 0.3e0 AS h, drop_5pct AS y FROM scored) GROUP BY fold)",
)
def confusion_at_threshold(p):
    return rounded(metrics.confusion(p.scored, Y, P, 0.3, ["fold"]))


@query(
    "reliability_bins",
    f"""WITH e AS (SELECT list_distinct([quantile_cont(p_drop, 0), quantile_cont(p_drop, 1/6e0), quantile_cont(p_drop, 2/6e0), quantile_cont(p_drop, 3/6e0),
quantile_cont(p_drop, 4/6e0), quantile_cont(p_drop, 5/6e0), quantile_cont(p_drop, 1)]) AS edges FROM scored),
s AS (SELECT list_sort(edges) AS e FROM e)
SELECT CAST(len(list_filter(e[2:len(e) - 1], lambda x: p_drop > x)) + 1 AS INTEGER) AS bin, {rsql('avg(p_drop)', 'predicted')}, {rsql('avg(drop_5pct)', 'observed')}, count(*) AS rows
FROM scored, s GROUP BY 1""",
)
def reliability_bins(p):
    return rounded(metrics.reliability_bins(p.scored, Y, P))


# --- uncertainty ----------------------------------------------------------------------------

REGRET_SQL = "greatest(CASE WHEN {w} THEN target_price_vnd + {f} ELSE price_vnd END - least(price_vnd, target_price_vnd + {f}), 0)"
FROZEN = REGRET_SQL.format(w="p_drop >= 0.3e0", f="50000e0")
BUY = REGRET_SQL.format(w="FALSE", f="50000e0")
view("daily_deltas", f"SELECT block_id, session_date, avg({FROZEN} - {BUY}) AS delta FROM blocked GROUP BY ALL")


def daily_deltas(p):
    frozen = K.policy_regret("price_vnd", "target_price_vnd", F.col(P) >= C.WAIT_THRESHOLD, C.FRICTION_VND)
    buy = K.policy_regret("price_vnd", "target_price_vnd", F.lit(False), C.FRICTION_VND)
    return metrics.paired_day_delta(p.blocks.withColumn("d", frozen - buy), "d")


@query("paired_day_delta", f"SELECT block_id, session_date, {rsql('delta', 'delta', 5)} FROM daily_deltas")
def paired_day_delta(p):
    return rounded(daily_deltas(p), 5)


@query("block_bootstrap")
def block_bootstrap(p):
    return metrics.block_bootstrap(daily_deltas(p))


@query("day_bootstrap")
def day_bootstrap(p):
    return metrics.block_bootstrap(daily_deltas(p), draws=4_000, strata=())


@query("block_heterogeneity")
def block_heterogeneity(p):
    return metrics.block_heterogeneity(daily_deltas(p), "TEST_1", "TEST_2")


@query(
    "constant_baselines",
    "SELECT fold_set, "
    + rsql("avg(drop_5pct)", "rate")
    + ", "
    + ", ".join(rsql(f"quantile_cont(y_log, {l})", f"q{int(l * 100):02d}") for l in LEVELS)
    + " FROM scored GROUP BY fold_set",
)
def constant_baselines(p):
    return rounded(metrics.constant_baselines(p.scored, Y, "y_log", ["fold_set"]))


view(
    "skill_table",
    """SELECT fold_set, fold, count(*) AS rows, avg((p_drop - drop_5pct) * (p_drop - drop_5pct)) AS model_loss,
avg((0.45e0 - drop_5pct) * (0.45e0 - drop_5pct)) AS base_loss FROM scored GROUP BY ALL""",
)


@query(
    "relative_skill",
    f"""SELECT fold_set, CAST(sum(rows) AS BIGINT) AS rows, {rsql('100e0 * (1 - (sum(model_loss * rows) / sum(rows)) / (sum(base_loss * rows) / sum(rows)))', 'skill_pct')}
FROM skill_table GROUP BY fold_set""",
)
def relative_skill(p):
    loss = lambda x: F.avg(F.pow(x - F.col(Y), 2))
    table = p.scored.groupBy("fold_set", "fold").agg(
        F.count(F.lit(1)).alias("rows"), loss(F.col(P)).alias("model_loss"), loss(F.lit(0.45)).alias("base_loss")
    )
    return rounded(metrics.relative_skill(table, "model_loss", "base_loss", ["fold_set"]))


STARTS = ", ".join(f"('{n}', TIMESTAMP '{a} 00:00:00')" for n, a, _ in BLOCKS)
BASE_PIN = "(" + " + ".join(f"greatest({l}e0 * (y_log - b{i}), {l - 1:.2f}e0 * (y_log - b{i}))" for i, l in enumerate(LEVELS)) + ") / 7e0"
DCG = """(SELECT avg(v) FROM (SELECT query_id, sum(CASE WHEN a <= 5 THEN g / log2(a + 1) ELSE 0 END) / sum(CASE WHEN b <= 5 THEN g / log2(b + 1) ELSE 0 END) AS v FROM (
SELECT query_id, pow(2e0, rel - n) - pow(2e0, -n) AS g, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, offer_id) AS a,
row_number() OVER (PARTITION BY query_id ORDER BY price_vnd, offer_id) AS b FROM ranked WHERE n >= 2) GROUP BY query_id))"""
GATES = ("both_blocks_pass", "proper_score_beats_prior", "mape_beats_anchor", "wis_beats_empirical", "quantiles_coherent", "ndcg5_beats_anchor",
         "regret_beats_buy_all", "cvar_close_to_buy_all", "recipe_unchanged", "blocks_disjoint")
RECIPES = {
    "INCUMBENT": "0.45e0 + 0 * p_drop", "FIRST": "p_drop", "SECOND": "1 - p_drop", "MEAN": "(p_drop + (1 - p_drop)) / 2",
    **{f"BLEND_{int(w * 100)}": f"(p_drop + (1 - p_drop)) / 2 * {w}e0 + 0.45e0 * {1 - w}e0" for w in (0.25, 0.5, 0.75)},
}
view("recipes", " UNION ALL ".join(f"SELECT offer_id, fold, fold_set, drop_5pct, '{n}' AS recipe, {e} AS probability FROM scored" for n, e in RECIPES.items()))
BLOCK_RECIPES = " UNION ALL ".join(
    f"""(SELECT recipe FROM (SELECT recipe, avg(s) AS m FROM (SELECT recipe, fold,
avg(-CASE WHEN drop_5pct = 1 THEN ln(probability) ELSE ln(1 - probability) END) + avg((probability - drop_5pct) * (probability - drop_5pct)) AS s
FROM recipes JOIN (SELECT offer_id, label_time FROM scored) USING (offer_id) WHERE label_time < TIMESTAMP '{start}' GROUP BY ALL) GROUP BY recipe) ORDER BY m, recipe LIMIT 1)"""
    for _, start, _ in BLOCKS
)
GATE_SQL = f"""WITH prior AS (SELECT b.block_id, avg(drop_5pct) AS rate, {', '.join(f'quantile_cont(y, {l}) AS b{i}' for i, l in enumerate(LEVELS))}
FROM (SELECT drop_5pct, label_time, ln(target_price_vnd / price_vnd) AS y FROM exact_pairs) e JOIN (VALUES {STARTS}) b(block_id, start) ON e.label_time < b.start GROUP BY 1),
x AS MATERIALIZED (SELECT a.*, prior.* EXCLUDE (block_id), n.anchor_vnd, d.query_id, {FROZEN} AS regret, {BUY} AS buy_regret FROM arranged a JOIN prior USING (block_id)
JOIN (SELECT offer_id, anchor_vnd FROM anchored WHERE anchor_vnd IS NOT NULL) n USING (offer_id) JOIN (SELECT offer_id, query_id FROM queried) d USING (offer_id)),
ranked AS (SELECT query_id, offer_id, price_vnd, pred_vnd, anchor_vnd, count(*) OVER (PARTITION BY query_id) AS n, count(*) OVER (PARTITION BY query_id)
- (rank() OVER (PARTITION BY query_id ORDER BY price_vnd) + (count(*) OVER (PARTITION BY query_id, price_vnd) - 1) / 2e0) + 1 AS rel FROM x),
s AS (SELECT coalesce(block_id, 'ALL') AS block_id, avg(-CASE WHEN drop_5pct = 1 THEN ln(p_drop) ELSE ln(1 - p_drop) END) + avg((p_drop - drop_5pct) * (p_drop - drop_5pct)) AS proper,
avg(-CASE WHEN drop_5pct = 1 THEN ln(rate) ELSE ln(1 - rate) END) + avg((rate - drop_5pct) * (rate - drop_5pct)) AS base_proper,
avg(abs(pred_vnd - price_vnd) / CAST(price_vnd AS DOUBLE)) AS mape, avg(abs(anchor_vnd - price_vnd) / CAST(price_vnd AS DOUBLE)) AS base_mape,
avg({PIN}) AS wis, avg({BASE_PIN}) AS base_wis, avg(CAST({' OR '.join(f'q{i + 1} < q{i}' for i in range(6))} AS DOUBLE)) AS crossing,
avg(regret) AS regret, avg(buy_regret) AS buy_regret FROM x GROUP BY ROLLUP (block_id)),
g AS (SELECT (SELECT bool_and(proper <= base_proper AND mape <= base_mape) FROM s WHERE block_id <> 'ALL') AS {GATES[0]}, proper <= base_proper AS {GATES[1]}, mape <= base_mape AS {GATES[2]},
wis <= base_wis AS {GATES[3]}, crossing = 0 AS {GATES[4]}, {DCG.format(score='-(pred_vnd // 20000)')} >= {DCG.format(score='-anchor_vnd')} AS {GATES[5]}, regret <= buy_regret AS {GATES[6]},
(SELECT avg(regret) FROM x WHERE regret >= (SELECT quantile_cont(regret, 0.95) FROM x)) <= (SELECT avg(buy_regret) FROM x WHERE buy_regret >= (SELECT quantile_cont(buy_regret, 0.95) FROM x)) * 1.05e0 + 1 AS {GATES[7]},
(SELECT count(DISTINCT recipe) FROM ({BLOCK_RECIPES})) = 1 AS {GATES[8]}, (SELECT count(*) FROM (SELECT offer_id FROM x GROUP BY 1 HAVING count(DISTINCT block_id) > 1)) + (SELECT count(*) FROM (SELECT query_id FROM x GROUP BY 1 HAVING count(DISTINCT block_id) > 1)) = 0 AS {GATES[9]}
FROM s WHERE block_id = 'ALL')
SELECT *, {' + '.join(f'CAST({g} AS INTEGER)' for g in GATES)} AS passed FROM g"""


def gate_rows(p):
    """Block rows with their prior anchor, query, and the rate and residual quantiles of all labels before the block."""
    starts = F.array(*[F.struct(F.lit(n).alias("block_id"), F.lit(a).cast("date").cast("timestamp_ntz").alias("start")) for n, a, _ in BLOCKS])
    past = p.exact_pairs.select("drop_5pct", "label_time", F.ln(F.col("target_price_vnd") / F.col("price_vnd")).alias("y"))
    past = past.withColumn("b", F.explode(F.filter(starts, lambda b: F.col("label_time") < b["start"]))).select("b.block_id", "drop_5pct", "y")
    prior = metrics.constant_baselines(past, Y, "y", ["block_id"])
    prior = prior.select("block_id", "rate", F.array(*[f"q{int(l * 100):02d}" for l in LEVELS]).alias("base_quantiles"))
    anchors = p.anchored.where("anchor_vnd IS NOT NULL").select("offer_id", "anchor_vnd")
    queries = serving.query_ids(p.offers).select("offer_id", "query_id")
    rows = p.blocks.join(prior, "block_id").join(anchors, "offer_id").join(queries, "offer_id")
    return materialise(rows.select(
        "offer_id", "block_id", "query_id", Y, P, "rate", "y_log", "quantiles", "base_quantiles", "price_vnd", "target_price_vnd", "pred_vnd", "anchor_vnd"
    ), "gates")


@query("release_gates", GATE_SQL)
def release_gates(p):
    df = gate_rows(p)

    def scores(by):
        own, base = (metrics.proper_scores(df, Y, c, by).withColumnRenamed("score", n) for c, n in ((P, "proper_score"), ("rate", "base_proper_score")))
        ape = lambda c: F.avg(F.abs(F.col(c) - F.col("price_vnd")) / F.col("price_vnd"))
        points = df.groupBy(*by).agg(ape("pred_vnd").alias("mape"), ape("anchor_vnd").alias("base_mape"))
        return join_on(join_on(own, base, by), points, by)

    failed = scores(["block_id"]).agg(
        F.count_if((F.col("proper_score") > F.col("base_proper_score")) | (F.col("mape") > F.col("base_mape"))).alias("failed_blocks")
    )
    spread = metrics.distribution_metrics(df, "y_log", "quantiles").select("wis", "crossing_rate")
    base_spread = metrics.distribution_metrics(df, "y_log", "base_quantiles").select(F.col("wis").alias("base_wis"))
    regret = lambda wait, mean, tail: policy.policy_metrics(policy.with_regret(df, wait), []).select(
        F.col("mean_regret_vnd").alias(mean), F.col("cvar95_regret_vnd").alias(tail)
    )
    ndcg = lambda score, name: metrics.ndcg(df.withColumn("score", score), "score", "price_vnd").agg(F.avg("ndcg5").alias(name))
    shared = lambda key, name: df.groupBy(key).agg(F.countDistinct("block_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))
    one = scores([])
    for part in (
        failed, spread, base_spread, regret(F.col(P) >= C.WAIT_THRESHOLD, "mean_regret", "cvar95_regret"), regret(F.lit(False), "buy_all_regret", "buy_all_cvar95"),
        ndcg(-F.expr("pred_vnd div 20000"), "ndcg5"), ndcg(-F.col("anchor_vnd"), "base_ndcg5"), shared("offer_id", "row_overlap"), shared("query_id", "query_overlap"),
    ):
        one = one.crossJoin(F.broadcast(part))  # one row each
    return metrics.release_gates(one.crossJoin(F.broadcast(block_recipes(p))))


def block_recipes(p):
    """Distinct recipes frozen for the two blocks: each is chosen on the folds whose labels are known before its start."""
    frozen = []
    for name, start, _ in BLOCKS:
        rows = recipes(p).where(F.col("label_time") < F.lit(start).cast("date").cast("timestamp_ntz"))
        table = metrics.recipe_table(metrics.proper_scores(rows.withColumn("fold_set", F.lit("SCREEN")), Y), "CLASSIFICATION")
        frozen.append(table.agg(F.min_by("recipe", F.struct("selection_score", "recipe")).alias("recipe")))
    return reduce(DataFrame.unionByName, frozen).agg(F.countDistinct("recipe").alias("recipes"))


# --- recipes --------------------------------------------------------------------------------

view(
    "recipe_scores",
    """SELECT recipe, avg(s) FILTER (fold_set = 'SCREEN') AS screen, avg(s) FILTER (fold_set = 'LATE') AS late, avg(s) AS all_folds,
max(s) FILTER (fold_set = 'SCREEN') AS screen_worst_fold, max(s) FILTER (fold_set = 'LATE') AS late_worst_fold FROM (SELECT recipe, fold_set, fold,
avg(-CASE WHEN drop_5pct = 1 THEN ln(probability) ELSE ln(1 - probability) END) + avg((probability - drop_5pct) * (probability - drop_5pct)) AS s
FROM recipes WHERE fold_set IN ('SCREEN', 'LATE') GROUP BY ALL) GROUP BY recipe""",
)


def recipes(p):
    df = p.scored.withColumn("second", 1 - F.col(P)).withColumn("incumbent", F.lit(0.45))
    return metrics.blend_probabilities(df, P, "second", "incumbent")


@query("blend_recipes", f"SELECT offer_id, recipe, {rsql('probability', 'probability')} FROM recipes")
def blend_recipes(p):
    return rounded(recipes(p).select("offer_id", "recipe", "probability"))


def recipe_scores(p):
    return metrics.recipe_table(metrics.proper_scores(recipes(p), Y), "CLASSIFICATION")


@query(
    "recipe_table",
    "SELECT recipe, " + ", ".join(rsql(c, n) for c, n in (("screen", "screen"), ("late", "late"), ("all_folds", "all"), ("screen_worst_fold", "screen_worst_fold"), ("late_worst_fold", "late_worst_fold"), ("screen", "selection_score"))) + " FROM recipe_scores",
)
def recipe_table(p):
    return rounded(recipe_scores(p))


@query(
    "late_gate",
    """SELECT recipe, pass_mean, pass_worst_fold, pass_mean AND pass_worst_fold AS late_pass FROM (SELECT a.recipe, a.late <= b.late * 1.01e0 AS pass_mean,
a.late_worst_fold <= b.late_worst_fold * (1 + 0.01e0 * 1.5e0) AS pass_worst_fold FROM recipe_scores a, recipe_scores b WHERE b.recipe = 'INCUMBENT')""",
)
def late_gate(p):
    return metrics.late_gate(recipe_scores(p), "CLASSIFICATION").select("recipe", "pass_mean", "pass_worst_fold", "late_pass")


def task_recipes(p, task):
    """Members and incumbent of a task: the stand-in prediction, a second one and a plain one."""
    df = serving.query_ids(p.scored)
    if task == "POINT":
        df = df.select("*", (F.col("price_vnd") + F.col("pred_vnd")).alias("a"), (2 * F.col("pred_vnd")).alias("b"), (2 * F.col("price_vnd")).alias("c"))
        df, y = df.withColumns({c: F.col(c) / 2 for c in "abc"}), "target_price_vnd"
    elif task == "DISTRIBUTION":
        shift = lambda d: F.transform("quantiles", lambda q: q + d)
        df, y = df.withColumns({"a": F.col("quantiles"), "b": shift(0.05), "c": shift(-0.04)}), "y_log"
    else:
        score = {"a": -F.col("price_vnd"), "b": -F.expr("pred_vnd div 20000"), "c": F.col("days_until_departure") * 1.0}
        df, y = df.withColumns({n: e.cast("double") for n, e in score.items()}), "target_price_vnd"
    rows = None
    if task == "RANKING":  # read for the ranks of the fares and for every recipe
        rows = df = materialise(df.select("fold_set", "fold", "query_id", "offer_id", y, "a", "b", "c"), "members")
    return metrics.recipe_table(metrics.recipe_scores(metrics.blends(df, "a", "b", "c"), task, y, rows=rows), task)


def folds_sql(task: str, score: str, value: str, worst: str = "max") -> str:
    """Screen and late means per recipe of a metric per fold, from rows with members a, b and incumbent c."""
    mixed = {"INCUMBENT": "{c}", "FIRST": "{a}", "SECOND": "{b}", "MEAN": "({a} + {b}) / 2"}
    mixed |= {f"BLEND_{int(w * 100)}": f"({{a}} + {{b}}) / 2 * {w}e0 + {{c}} * {1 - w}e0" for w in (0.25, 0.5, 0.75)}
    rows = " UNION ALL ".join(f"SELECT *, '{n}' AS recipe, {value.format(m=e)} FROM members" for n, e in mixed.items())
    return f"""f AS (SELECT recipe, fold_set, fold, {score} AS s FROM ({rows}) GROUP BY ALL)
SELECT recipe, {rsql("avg(s) FILTER (fold_set = 'SCREEN')", 'screen')}, {rsql("avg(s) FILTER (fold_set = 'LATE')", 'late')}, {rsql('avg(s)', 'all')},
{rsql(f"{worst}(s) FILTER (fold_set = 'SCREEN')", 'screen_worst_fold')}, {rsql(f"{worst}(s) FILTER (fold_set = 'LATE')", 'late_worst_fold')}, {rsql("avg(s) FILTER (fold_set = 'SCREEN')", 'selection_score')} FROM f GROUP BY recipe"""


def mix_points(text: str) -> str:
    return text.replace("{a}", "((price_vnd + pred_vnd) / 2e0)").replace("{b}", "(pred_vnd * 1e0)").replace("{c}", "(price_vnd * 1e0)")


@query(
    "recipe_table_point",
    mix_points("WITH members AS (SELECT * FROM scored), " + folds_sql("POINT", "avg(abs(v - target_price_vnd) / target_price_vnd)", "{m} AS v")),
)
def recipe_table_point(p):
    return rounded(task_recipes(p, "POINT"))


@query("recipe_table_distribution")
def recipe_table_distribution(p):
    return rounded(task_recipes(p, "DISTRIBUTION"))


@query("recipe_table_ranking")
def recipe_table_ranking(p):
    return rounded(task_recipes(p, "RANKING"))


@query(
    "recipe_choice",
    """WITH g AS (SELECT a.recipe, a.screen, a.late <= b.late * 1.01e0 AND a.late_worst_fold <= b.late_worst_fold * (1 + 0.01e0 * 1.5e0) AS ok FROM recipe_scores a, recipe_scores b WHERE b.recipe = 'INCUMBENT'),
w AS (SELECT * FROM g ORDER BY screen, recipe LIMIT 1)
SELECT recipe AS screen_winner, CASE WHEN ok THEN recipe ELSE 'INCUMBENT' END AS frozen_recipe,
CASE WHEN recipe = 'INCUMBENT' THEN 'INCUMBENT_WON_SCREEN' WHEN ok THEN 'PASS' ELSE 'RETAIN_INCUMBENT' END AS gate_status FROM w""",
)
def recipe_choice(p):
    return metrics.choose_recipe(recipe_scores(p), "CLASSIFICATION")


# --- decisions ------------------------------------------------------------------------------


@query("policy_regret", f"SELECT offer_id, p_drop >= 0.3e0 AS wait, CAST({FROZEN} AS DOUBLE) AS regret FROM scored")
def policy_regret(p):
    return policy.with_regret(p.scored, F.col(P) >= C.WAIT_THRESHOLD).select("offer_id", "wait", "regret")


def policy_sql(by: str, source: str, friction: str) -> str:
    oracle = f"least(price_vnd, target_price_vnd + {friction})"
    return f"""SELECT {by}, count(*) AS rows, {rsql('avg(regret)', 'mean_regret_vnd', 5)}, {rsql('avg(CAST(wait AS DOUBLE))', 'wait_rate')},
{rsql(f'1 - sum(regret) / greatest(sum(greatest(price_vnd - {oracle}, 0)), 1)', 'oracle_savings_capture')}, {rsql('max(p95)', 'p95_regret_vnd', 5)},
{rsql('avg(CASE WHEN regret >= p95 THEN regret END)', 'cvar95_regret_vnd', 5)} FROM {source} GROUP BY {by}"""


view(
    "regrets",
    f"SELECT *, quantile_cont(regret, 0.95) OVER (PARTITION BY fold) AS p95 FROM (SELECT *, p_drop >= 0.3e0 AS wait, {FROZEN} AS regret FROM scored)",
)


@query("policy_metrics", policy_sql("fold", "regrets", "50000e0"))
def policy_metrics(p):
    out = policy.policy_metrics(policy.with_regret(p.scored, F.col(P) >= C.WAIT_THRESHOLD), ["fold"])
    return policy_out(out, ["fold"])


def policy_out(out, by):
    return out.select(
        *by, "rows", r("mean_regret_vnd", 5), r("wait_rate", 8), r("oracle_savings_capture", 8), r("p95_regret_vnd", 5), r("cvar95_regret_vnd", 5)
    )


THR = ", ".join(f"({t}e0)" for t in C.THRESHOLDS)
view(
    "tournament_rows",
    f"""SELECT threshold, fold, avg(regret) AS m, avg(CASE WHEN regret >= p95 THEN regret END) AS c FROM (SELECT *, quantile_cont(regret, 0.95) OVER (PARTITION BY threshold, fold) AS p95
FROM (SELECT threshold, fold, {REGRET_SQL.format(w='p_drop >= threshold', f='50000e0')} AS regret FROM scored, (VALUES {THR}) t(threshold) WHERE fold_set = 'SCREEN')) GROUP BY ALL""",
)


@query(
    "threshold_tournament",
    f"""SELECT threshold, {rsql('avg(m)', 'screen_mean_regret_vnd', 5)}, {rsql('avg(c)', 'screen_cvar95_regret_vnd', 5)}, {rsql('max(m)', 'screen_worst_fold_regret_vnd', 5)},
{rsql('avg(m) + 0.2e0 * avg(c) + 0.1e0 * max(m)', 'selection_score', 5)} FROM tournament_rows GROUP BY threshold""",
)
def threshold_tournament(p):
    out = policy.tournament(p.scored.where("fold_set = 'SCREEN'"))
    return out.select("threshold", *[r(c, 5) for c in out.columns if c != "threshold"])


@query(
    "best_threshold",
    """SELECT threshold FROM (SELECT threshold, avg(m) + 0.2e0 * avg(c) + 0.1e0 * max(m) AS s FROM tournament_rows GROUP BY threshold)
ORDER BY s, abs(threshold - 0.5), threshold LIMIT 1""",
)
def best_threshold(p):
    return policy.best_threshold(policy.tournament(p.scored.where("fold_set = 'SCREEN'")))


view(
    "stress_rows",
    f"""SELECT *, quantile_cont(regret, 0.95) OVER (PARTITION BY fold_set, friction_vnd, policy) AS p95 FROM (
SELECT *, {REGRET_SQL.format(w='wait', f='friction_vnd')} AS regret FROM (SELECT *, CASE policy WHEN 'BUY_ALL' THEN FALSE WHEN 'WAIT_ALL' THEN TRUE ELSE p_drop >= 0.3e0 END AS wait
FROM scored, (VALUES (0e0), (25000e0), (50000e0), (100000e0)) f(friction_vnd), (VALUES ('FROZEN'), ('BUY_ALL'), ('WAIT_ALL')) q(policy)))""",
)


@query("friction_stress", policy_sql("fold_set, friction_vnd, policy", "stress_rows", "friction_vnd"))
def friction_stress(p):
    return policy_out(policy.stress(p.scored, C.WAIT_THRESHOLD), ["fold_set", "friction_vnd", "policy"])


COST = "CASE WHEN {w} THEN greatest(target_price_vnd - price_vnd, 0) + 50000e0 ELSE 2e0 * greatest(price_vnd - target_price_vnd, 0) END"


@query("asymmetric_cost", f"SELECT fold, {rsql('avg(' + COST.format(w='p_drop >= 0.3e0') + ')', 'mean_vnd_cost', 5)} FROM scored GROUP BY fold")
def asymmetric_cost(p):
    cost = K.asymmetric_cost("price_vnd", "target_price_vnd", F.col(P) >= C.WAIT_THRESHOLD, C.UNSAFE_BUY_WEIGHT, C.FRICTION_VND)
    return p.scored.groupBy("fold").agg((F.round(F.avg(cost), 5) + 0.0).alias("mean_vnd_cost"))


@query(
    "tune_threshold",
    f"""WITH g AS (SELECT 0.01e0 + i * (0.98e0 / 196e0) AS threshold FROM range(197) t(i)),
s AS (SELECT threshold, count(*) FILTER (p_drop >= threshold AND drop_5pct = 1) / CAST(count(*) FILTER (drop_5pct = 1) AS DOUBLE) AS dr,
count(*) FILTER (p_drop < threshold AND drop_5pct = 0) / CAST(count(*) FILTER (drop_5pct = 0) AS DOUBLE) AS kr,
avg({COST.format(w='p_drop >= threshold')}) AS cost FROM scored, g GROUP BY threshold),
o AS (SELECT *, dr >= 0.4e0 AND kr >= 0.4e0 AS ok FROM s)
SELECT {rsql('threshold', 'threshold')}, {rsql('cost', 'mean_vnd_cost', 5)}, {rsql('least(dr, kr)', 'min_class_recall')}, {rsql('dr', 'drop_recall')},
{rsql('kr', 'no_drop_recall')}, ok AS tuning_feasible FROM o ORDER BY ok DESC, CASE WHEN ok THEN cost ELSE -least(dr, kr) END,
CASE WHEN ok THEN -least(dr, kr) ELSE cost END, abs(threshold - 0.5) LIMIT 1""",
)
def tune_threshold(p):
    out = policy.tune_threshold(p.scored, Y, P, 0.4, 0.4)
    return out.select(
        r("threshold", 8), r("mean_vnd_cost", 5), r("min_class_recall", 8), r("drop_recall", 8), r("no_drop_recall", 8), "tuning_feasible"
    )


Z = "1.959963984540054e0"


@query(
    "wilson_safety",
    f"""WITH c AS (SELECT fold, count(*) AS rows, count(*) FILTER (drop_5pct = 1) AS drops, count(*) FILTER (p_drop < 0.3e0) AS buys, count(*) FILTER (p_drop < 0.3e0 AND drop_5pct = 1) AS unsafe_buys FROM scored GROUP BY fold),
w AS (SELECT *, unsafe_buys / CAST(buys AS DOUBLE) AS s FROM c),
x AS (SELECT *, (s + {Z} * {Z} / (2e0 * buys) + {Z} * sqrt(s * (1 - s) / buys + {Z} * {Z} / (4e0 * buys * buys))) / (1 + {Z} * {Z} / buys) AS u FROM w)
SELECT fold, rows, buys, unsafe_buys, {rsql('s', 'unsafe_rate')}, {rsql('u', 'wilson_upper')}, {rsql('buys / CAST(rows AS DOUBLE)', 'buy_coverage')},
{rsql('(drops - unsafe_buys) / CAST(drops AS DOUBLE)', 'wait_recall')},
coalesce(u <= 0.15e0 AND buys / CAST(rows AS DOUBLE) >= 0.2e0 AND (drops - unsafe_buys) / CAST(drops AS DOUBLE) >= 0.75e0, false) AS safe FROM x""",
)
def wilson_safety(p):
    return rounded(policy.wilson_safety(p.scored.withColumn("wait", F.col(P) >= C.WAIT_THRESHOLD), ["fold"]))


@query("safety_thresholds")
def safety_thresholds(p):
    """Tuned on the screen folds; the actions on the late ones by horizon."""
    head, rest = p.scored.where("fold_set = 'SCREEN'"), p.scored.where("fold_set = 'LATE'")
    table = policy.safety_thresholds(head, Y, P)
    done = policy.with_actions(rest, table, P).groupBy("days_until_departure", "threshold_source").pivot("action", ["BUY", "UNCERTAIN", "WAIT"]).count().na.fill(0)
    return rounded(join_on(done, table.drop("threshold_source"), ["days_until_departure"], "left"), 5)


# --- conformal calibration ------------------------------------------------------------------

view(
    "conformal_rows",
    "SELECT *, CASE WHEN p_drop >= 0.5e0 THEN 'WARM' ELSE 'COLD' END AS regime, CASE WHEN p_drop >= 0.5e0 THEN 'WARM' ELSE 'COLD' END || '|' || "
    + band("days_until_departure", C.CONFORMAL_DUD_BANDS)
    + " AS conformal_group, "
    + ", ".join(f"greatest({', '.join(f'q{j}' for j in range(i + 1))}) AS r{i}" for i in range(7))
    + " FROM scored",
)


def higher(i: int, level: float) -> str:
    return f"list_extract(list_sort(list(y_log - r{i})), CAST(ceil((count(*) - 1) * {level}e0) AS BIGINT) + 1) AS o{i}"


HIGHER = ", ".join(higher(i, l) for i, l in enumerate(LEVELS))
view("global_offsets", f"SELECT count(*) AS support, {HIGHER} FROM conformal_rows WHERE fold_set = 'SCREEN'")
view("group_offsets", f"SELECT conformal_group, count(*) AS support, {HIGHER} FROM conformal_rows WHERE fold_set = 'SCREEN' GROUP BY 1 HAVING count(*) >= 100")
SHIFT = lambda a: ", ".join(f"greatest({', '.join(f'r{j} + {a}{j}' for j in range(i + 1))}) AS c{i}" for i in range(7))
OFF = [f"o{i}" for i in range(7)]
view(
    "calibrated_rows",
    f"SELECT *, {SHIFT('u')} FROM (SELECT v.*, "
    + ", ".join(f"coalesce(g.o{i}, a.o{i}) AS u{i}" for i in range(7))
    + " FROM conformal_rows v LEFT JOIN group_offsets g USING (conformal_group) CROSS JOIN global_offsets a)",
)


def conformal_rows(p):
    df = p.scored.withColumn("regime", F.when(F.col(P) >= 0.5, "WARM").otherwise("COLD"))
    return calibration.conformal_groups(df)


def quantile_columns(df, name, prefix):
    return [(F.round(F.col(name)[i], 8) + 0.0).alias(f"{prefix}{i}") for i in range(7)]


@query("conformal_offsets", "SELECT conformal_group, support, " + ", ".join(rsql(f"o{i}", f"o{i}") for i in range(7)) + " FROM group_offsets")
def conformal_offsets(p):
    head = conformal_rows(p).where("fold_set = 'SCREEN'")
    out = calibration.conformal_offsets(head, "y_log", "quantiles", ["conformal_group"]).where("support >= 100")
    return out.select("conformal_group", "support", *quantile_columns(out, "offsets", "o"))


@query(
    "conformal_global",
    f"SELECT offer_id, {', '.join(rsql(f'c{i}', f'c{i}') for i in range(7))} FROM (SELECT v.offer_id, {SHIFT('o')} FROM conformal_rows v CROSS JOIN global_offsets WHERE fold_set = 'LATE')",
)
def conformal_global(p):
    df = conformal_rows(p)
    offsets = calibration.conformal_offsets(df.where("fold_set = 'SCREEN'"), "y_log", "quantiles")
    out = calibration.conformal_global(df.where("fold_set = 'LATE'"), offsets, "quantiles")
    return out.select("offer_id", *quantile_columns(out, "calibrated", "c"))


@query("conformal_mondrian", f"SELECT offer_id, {', '.join(rsql(f'c{i}', f'c{i}') for i in range(7))} FROM calibrated_rows WHERE fold_set = 'LATE'")
def conformal_mondrian(p):
    df = conformal_rows(p)
    out = calibration.conformal_mondrian(df.where("fold_set = 'SCREEN'"), df.where("fold_set = 'LATE'"), "y_log", "quantiles")
    return out.select("offer_id", *quantile_columns(out, "calibrated", "c"))


def wis_sql(prefix: str) -> str:
    return "2 * avg((" + " + ".join(
        f"greatest({l}e0 * (y_log - {prefix}{i}), {l - 1:.2f}e0 * (y_log - {prefix}{i}))" for i, l in enumerate(LEVELS)
    ) + ") / 7e0)"


def choice_sql() -> str:
    sources = {
        "RAW": ("r", "conformal_rows"),
        "GLOBAL_CONFORMAL": ("c", f"(SELECT v.*, {SHIFT('o')} FROM conformal_rows v CROSS JOIN global_offsets)"),
        "MONDRIAN_CONFORMAL": ("c", "calibrated_rows"),
    }
    parts = " UNION ALL ".join(
        f"""SELECT '{n}' AS recipe, {i} AS complexity, {wis_sql(x)} AS wis, avg(CAST(y_log >= {x}1 AND y_log <= {x}5 AS DOUBLE)) AS coverage80,
avg(CAST(y_log >= {x}0 AND y_log <= {x}6 AS DOUBLE)) AS coverage90 FROM {s} WHERE fold_set = 'SCREEN'"""
        for i, (n, (x, s)) in enumerate(sources.items())
    )
    return f"""WITH t AS ({parts}), s AS (SELECT *, wis + complexity * 1e-7 + 0.25e0 * abs(coverage90 - 0.9e0) + 0.15e0 * abs(coverage80 - 0.8e0) AS score FROM t)
SELECT recipe, complexity, {rsql('wis', 'wis')}, {rsql('coverage80', 'coverage80')}, {rsql('coverage90', 'coverage90')}, {rsql('score', 'score')},
row_number() OVER (ORDER BY score, complexity) = 1 AS chosen FROM s"""


@query("calibration_choice_q", choice_sql())
def calibration_choice_q(p):
    head = conformal_rows(p).where("fold_set = 'SCREEN'")
    return rounded(calibration.choose_quantile_recipe(head, "y_log", "quantiles"))
