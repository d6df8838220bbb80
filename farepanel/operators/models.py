"""Model jobs on Spark ML: tabular pipelines, candidate screens and batch scoring."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators import market, metrics, splits
from farepanel.operators.quality import ensemble_mean
from farepanel.operators.scale import exact_quantiles, histogram, join_on, quantiles_of_totals, running_totals
from farepanel.operators.serving import residual_to_price
from farepanel.session import materialise

CATEGORICAL = ("route", "airline", "session_label")
ACCURACY = 1000  # of the sketch that brackets the quantiles of a leaf
NUMERIC = (
    "days_until_departure", "departure_minute", "price_vnd", "batch_offer_count",
    "temporal_market_median_price", "previous_price_same_schedule", "prior_relative_volatility",
)


def feature_stages(categorical: Sequence[str] = CATEGORICAL, numeric: Sequence[str] = NUMERIC) -> list:
    """Indexing with unseen values kept, median imputation with a missing flag left to trees, assembly."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep")
    impute = Imputer(strategy="median", inputCols=[f"{c}_d" for c in numeric], outputCols=[f"{c}_im" for c in numeric])
    assemble = VectorAssembler(inputCols=[f"{c}_ix" for c in categorical] + [f"{c}_im" for c in numeric], outputCol="features")
    return [index, impute, assemble]


def as_doubles(df: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    return df.withColumns({f"{c}_d": F.col(c).cast("double") for c in numeric})


def train_classifier(
    train: DataFrame, y: str, weights: str | None = "BALANCED", seed: int = 17, trees: int = 20, depth: int = 4, family: str = "GBT"
) -> PipelineModel:
    """Drop probability from boosted trees or a logistic model, with optional balanced weights."""
    data = splits.balanced_weights(train, y) if weights == "BALANCED" else train.withColumn("weight", F.lit(1.0))
    data = as_doubles(data).withColumn("__y", F.col(y).cast("double"))
    return Pipeline(stages=[*feature_stages(), learner(seed, trees, depth, family)]).fit(data)


def predict_probability(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    out = model.transform(as_doubles(df)).withColumn("__p", vector_to_array("probability")[1])
    return out.select(*[c for c in df.columns if c != name], F.col("__p").alias(name))


def train_regressor(train: DataFrame, y: str, seed: int = 17, trees: int = 20, depth: int = 4, loss: str = "squared") -> PipelineModel:
    data = as_doubles(train).withColumn("__y", F.col(y).cast("double"))
    learner = GBTRegressor(
        featuresCol="features", labelCol="__y", maxIter=trees, maxDepth=depth, stepSize=0.1, lossType=loss, maxBins=64, subsamplingRate=0.8, seed=seed
    )
    return Pipeline(stages=[*feature_stages(), learner]).fit(data)


def predict_value(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(as_doubles(df))
    return out.select(*[c for c in df.columns if c != name], F.col("prediction").alias(name))


def quantile_surface(train: DataFrame, target: DataFrame, value: str, levels: Sequence[float] = C.QUANTILES) -> DataFrame:
    """Conditional quantiles from the backoff table; the last level pools all training rows."""
    table = {**market.RESIDUAL_LEVELS, "GLOBAL": ()}
    names = [f"q{int(level * 100):02d}" for level in levels]
    out = market.backoff_quantiles(
        train, target, value, table, dict(zip(names, levels)), default=None, default_level="UNAVAILABLE", pooled_min_support=1
    )
    return out.withColumn("surface", F.array(*names))


def rank_scores(train: DataFrame, target: DataFrame, query: str = "query_id", price: str = "target_price_vnd", **params) -> DataFrame:
    """Pointwise score of the relevance grade; higher means cheaper inside the query. The graded rows are written once,
    since every stage of the fit reads them."""
    graded = splits.rank_relevance(train, query, price).select(*dict.fromkeys([*CATEGORICAL, *NUMERIC, "relevance"]))
    model = train_regressor(materialise(graded, "graded"), "relevance", **params)
    return predict_value(model, target, "score")


def encoded_folds(split: DataFrame, y: str, folds: Sequence[str], weights: str | None = "BALANCED") -> dict[str, DataFrame]:
    """(role, features, __y, weight) of every fold as a written table; indices and medians come from the training rows
    of their own fold."""
    tables = {}
    for fold in folds:
        rows = as_doubles(split.where(F.col("fold") == fold))
        train = rows.where("role = 'TRAIN'")
        weighted = splits.balanced_weights(train, y) if weights == "BALANCED" else train.withColumn("weight", F.lit(1.0))
        both = weighted.unionByName(rows.where("role = 'VALID'").withColumn("weight", F.lit(1.0)))
        encoded = Pipeline(stages=feature_stages()).fit(train).transform(both)
        encoded = encoded.select("role", "features", F.col(y).cast("double").alias("__y"), "weight")
        tables[fold] = materialise(encoded, "encoded")
    return tables


def learner(seed: int = 17, trees: int = 20, depth: int = 4, family: str = "GBT"):
    common = dict(featuresCol="features", labelCol="__y", weightCol="weight")
    if family == "GBT":
        return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, maxBins=64, seed=seed, **common)
    return LogisticRegression(regParam=1e-3, maxIter=50, **common)


def losers(scores: Mapping[str, Sequence[float]], margin: float) -> set[str]:
    """Candidates that were worse than the best mean on every fold so far, by ``margin`` on average; lower is better."""
    means = {name: sum(s) / len(s) for name, s in scores.items()}
    best = min(means, key=lambda name: (means[name], name))
    gaps = {name: [a - b for a, b in zip(s, scores[best])] for name, s in scores.items()}
    return {name for name, g in gaps.items() if min(g) > 0 and sum(g) / len(g) > margin}


def candidate_grid(
    split: DataFrame,
    y: str,
    candidates: Mapping[str, Mapping],
    folds: Sequence[str],
    seeds: Sequence[int],
    pool: int = 4,
    least_folds: int = 2,
    margin: float = 0.01,
) -> DataFrame:
    """Proper score of every candidate, fold and seed.

    Folds follow each other; the fits of a fold run ``pool`` at a time, as Spark jobs over its encoded, written table, in
    a scheduler pool that shares executors fairly where the cluster allows it. A candidate that has lost every fold so
    far by ``margin`` on average, over ``least_folds`` or more, is not fitted again. Decisions wait for the end of a
    fold, so the table does not depend on ``pool``. A learner that draws nothing has one fit for all seeds, which would
    be equal. Only trees and one row per fit reach the driver.
    """
    spark = split.sparkSession
    tables = encoded_folds(split, y, folds)
    drawn = {name: learner(**params).hasParam("seed") for name, params in candidates.items()}
    running, means, rows = dict(candidates), {name: [] for name in candidates}, []

    def fit(fold: str, name: str, seed: int) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "candidates")
        part = tables[fold]
        model = learner(seed=seed, **candidates[name]).fit(part.where("role = 'TRAIN'"))
        scored = model.transform(part.where("role = 'VALID'")).select("__y", vector_to_array("probability")[1].alias("p"))
        row = metrics.proper_scores(scored.withColumn("all", F.lit(1)), "__y", "p", ["all"]).first()
        return fold, name, seed, scored.count(), float(row.score)

    with ThreadPoolExecutor(pool) as workers:
        for at, fold in enumerate(folds):
            jobs = [workers.submit(inheritable_thread_target(spark)(fit), fold, name, seed) for name in running for seed in (seeds if drawn[name] else seeds[:1])]
            done = [job.result() for job in jobs]
            done += [(fold, r[1], seed, *r[3:]) for r in done if not drawn[r[1]] for seed in seeds[1:]]
            rows += done
            for name in running:
                own = [r[4] for r in done if r[1] == name]
                means[name].append(sum(own) / len(own))
            if at + 1 >= least_folds:
                out = losers({name: means[name] for name in running}, margin)
                running = {name: p for name, p in running.items() if name not in out}
    return spark.createDataFrame(rows, "fold string, candidate string, seed int, rows long, proper_score double")


# --- quantiles by boosting ------------------------------------------------------------------


@dataclass(frozen=True)
class QuantileBoost:
    """Encoder, first quantiles, and per stage a tree with the step of every leaf and level."""

    encoder: PipelineModel
    start: list[float]
    stages: list[tuple]


def _stepped(df: DataFrame, tree, steps: Mapping[int, Sequence[float]]) -> DataFrame:
    """Quantiles moved by the step of the row's leaf."""
    table = F.create_map(*[x for leaf, step in steps.items() for x in (F.lit(int(leaf)), F.array(*[F.lit(float(v)) for v in step]))])
    moved = tree.transform(df).withColumn("__q", F.zip_with("__q", F.element_at(table, F.col("__leaf").cast("int")), lambda q, s: q + F.coalesce(s, F.lit(0.0))))
    return moved.drop("__leaf", "prediction")


def _leaf_rests(leaves: DataFrame, levels: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(__leaf, __level, __rest): what the quantiles leave of every row, with all values that cannot be near the level's
    own quantile at minus or plus infinity.

    A sketch per leaf, off by at most 1 / ``accuracy`` of its rows, brackets each quantile by twice that on both sides.
    Ranks are as before, so exact quantiles do not change, but a histogram holds a small share of the values. Leaves of
    few rows keep all. At most 2^depth leaves reach the driver.
    """
    rest = [F.col("__y") - F.col("__q")[i] for i in range(len(levels))]
    reach = 2 / accuracy
    near = [F.percentile_approx(r, [max(0.0, t - reach), min(1.0, t + reach)], accuracy) for r, t in zip(rest, levels)]
    sketch = leaves.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*near).alias("near")).collect()
    found = {int(r["__leaf"]): r["near"] if r["n"] >= 10 * accuracy else [[-math.inf, math.inf]] * len(levels) for r in sketch}
    edges = F.create_map(*[x for leaf, near in found.items() for x in (F.lit(leaf), F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in near]))])
    rows = leaves.withColumn("__edges", F.element_at(edges, F.col("__leaf").cast("int"))) if found else leaves.withColumn("__edges", F.array(F.array(F.lit(0.0))))
    kept = [F.when(r < F.col("__edges")[i][0], -math.inf).when(r > F.col("__edges")[i][1], math.inf).otherwise(r) for i, r in enumerate(rest)]
    return rows.select("__leaf", F.posexplode(F.array(*kept)).alias("__level", "__rest"))


def fit_quantile_boost(
    train: DataFrame, y: str, levels: Sequence[float] = C.QUANTILES, stages: int = 8, rate: float = 0.3, depth: int = 4, seed: int = 17
) -> QuantileBoost:
    """Boosted trees for all quantiles at once, under pinball loss.

    Trees are grown on the mean gradient of the levels, in every second stage on the difference between upper and lower
    ones, which finds where the spread changes. A leaf's step is, for every level, the exact quantile of what is left,
    shrunk by ``rate``; it comes from spread histograms of the values near it, so a leaf may hold any share of the rows.
    At most 2^depth leaves of a stage reach the driver.
    """
    encoder = Pipeline(stages=feature_stages()).fit(as_doubles(train))
    rows = encoder.transform(as_doubles(train)).select("features", F.col(y).cast("double").alias("__y")).where(F.col("__y").isNotNull())
    names = {f"l{i}": float(level) for i, level in enumerate(levels)}
    rows = materialise(rows, "boost")
    first = exact_quantiles(rows, [], "__y", names).first()
    start = [float(first[n]) for n in names]
    now, grown = rows.withColumn("__q", F.array(*[F.lit(v) for v in start])), []
    weights = [[1.0] * len(levels), [1.0 if t > 0.5 else -1.0 if t < 0.5 else 0.0 for t in levels]]
    for stage in range(stages):
        parts = [F.lit(w) * (F.lit(float(t)) - (F.col("__y") < F.col("__q")[i]).cast("double")) for i, (t, w) in enumerate(zip(levels, weights[stage % 2])) if w]
        target = now.withColumn("__g", reduce(lambda a, b: a + b, parts))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="__g", maxDepth=depth, maxBins=64, minInstancesPerNode=20, seed=seed + stage).setLeafCol("__leaf").fit(target)
        left = _leaf_rests(tree.transform(now).select("__leaf", "__q", "__y"), levels)
        share = K.lookup("__level", {i: float(t) for i, t in enumerate(levels)})
        totals = running_totals(histogram(left, ["__leaf", "__level"], "__rest"), ["__leaf", "__level"], "__rest", ["n"])
        found = quantiles_of_totals(totals, ["__leaf", "__level"], "__rest", {"step": share}).collect()
        steps = {int(leaf): [0.0] * len(levels) for leaf in {r["__leaf"] for r in found}}
        for r in found:
            steps[int(r["__leaf"])][r["__level"]] = rate * r["step"]
        grown.append((tree, steps))
        now = materialise(_stepped(now, tree, steps), "boost")
    return QuantileBoost(encoder, start, grown)


def predict_quantiles(model: QuantileBoost, df: DataFrame, name: str = "quantiles") -> DataFrame:
    """Rows with an array of quantiles in ascending order."""
    out = model.encoder.transform(as_doubles(df)).withColumn("__q", F.array(*[F.lit(v) for v in model.start]))
    for tree, steps in model.stages:
        out = _stepped(out, tree, steps)
    return out.select(*[c for c in df.columns if c != name], K.rearrange("__q").alias(name))


def score_frames(models: Sequence[PipelineModel], frame: DataFrame, train: DataFrame, anchor: str, residual: str, key: str = "offer_id") -> DataFrame:
    """Mean residual of all members, clipped to training, turned back into a fare at the anchor."""
    parts = [predict_value(m, frame, "prediction_log").select(key, "prediction_log") for m in models]
    mean = ensemble_mean(parts, key, ["prediction_log"])
    out = join_on(frame, mean, [key])
    return residual_to_price(out, train, anchor, "prediction_log", residual)
