"""Conformal quantile offsets and probability calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farepanel import config as C
from farepanel.functions import columns as K
from farepanel.operators.metrics import EPS, clip_probability, log_loss
from farepanel.operators.scale import histogram, join_on, neighbours, quantiles_of_totals, running_totals, with_scalars
from farepanel.session import materialise

def residual_histogram(head: DataFrame, y: str, quantiles: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of distinct residuals per group and level; every level travels in one shuffle."""
    levels = F.posexplode(K.rearrange(quantiles)).alias("level", "q")
    long = head.select(*by, F.col(y).alias("__y"), levels).withColumn("residual", F.col("__y") - F.col("q"))
    return histogram(long, [*by, "level"], "residual")


def offsets_of_histogram(hist: DataFrame, by: Sequence[str] = (), name: str = "offsets") -> DataFrame:
    by = list(by)
    keys = [*by, "level"]
    share = K.lookup("level", {i: float(q) for i, q in enumerate(C.QUANTILES)})
    merged = hist.groupBy(*keys, "residual").agg(F.sum("n").alias("n"))
    totals = running_totals(merged, keys, "residual", ["n"])
    table = quantiles_of_totals(totals, keys, "residual", {"offset": share}, "higher", "support")
    array = F.array(*[F.max(F.when(F.col("level") == i, F.col("offset"))) for i in range(len(C.QUANTILES))])
    return table.groupBy(*by).agg(array.alias(name), F.max("support").alias("support"))


def conformal_offsets(head: DataFrame, y: str, quantiles: str, by: Sequence[str] = (), name: str = "offsets") -> DataFrame:
    """Per level, the ``higher`` order statistic of the residuals, as one array per group."""
    return offsets_of_histogram(residual_histogram(head, y, quantiles, by), by, name)


def shifted(quantiles: str, offsets: str) -> Column:
    return K.rearrange(F.zip_with(K.rearrange(quantiles), F.col(offsets), lambda q, o: q + o))


def conformal_global(df: DataFrame, offsets: DataFrame, quantiles: str, name: str = "calibrated") -> DataFrame:
    row = offsets.select(F.col("offsets").alias("__global"))
    return with_scalars(df, row).withColumn(name, shifted(quantiles, "__global")).drop("__global")


def conformal_groups(df: DataFrame, regime: str = "regime", dud: str = "days_until_departure") -> DataFrame:
    band = K.right_closed_band(dud, C.CONFORMAL_DUD_BANDS)
    return df.withColumn("conformal_group", F.concat_ws("|", F.coalesce(F.col(regime), F.lit("__NA__")), band))


def conformal_mondrian(
    head: DataFrame, valid: DataFrame, y: str, quantiles: str, group: str = "conformal_group", min_support: int = C.CONFORMAL_MIN_SUPPORT, name: str = "calibrated", keep_global: str | None = None
) -> DataFrame:
    """Offsets of the row's group when it has enough head rows, else the global offsets.

    ``keep_global`` names a column for the globally shifted quantiles of the same row.
    """
    hist = materialise(residual_histogram(head, y, quantiles, [group]), "residuals")  # read for groups and for all rows
    groups = offsets_of_histogram(hist, [group], "__group").where(F.col("support") >= min_support).drop("support")
    row = offsets_of_histogram(hist).select(F.col("offsets").alias("__global"))
    out = with_scalars(join_on(valid, groups, [group], "left"), row)
    out = out.withColumn("__used", F.coalesce("__group", "__global"))
    if keep_global:
        out = out.withColumn(keep_global, shifted(quantiles, "__global"))
    return out.withColumn(name, shifted(quantiles, "__used")).drop("__group", "__global", "__used")


def choose_quantile_recipe(head: DataFrame, y: str, quantiles: str, group: str = "conformal_group", coverage_penalty: bool = True) -> DataFrame:
    """Score of RAW, GLOBAL and MONDRIAN on the head, and the chosen one (simplest on a tie)."""
    both = conformal_mondrian(head, head, y, quantiles, group, name="__mondrian_q", keep_global="__global_q")
    recipes = [("RAW", 0, K.rearrange(quantiles)), ("GLOBAL_CONFORMAL", 1, F.col("__global_q")), ("MONDRIAN_CONFORMAL", 2, F.col("__mondrian_q"))]
    structs = [F.struct(F.lit(n).alias("recipe"), F.lit(c).alias("complexity"), q.alias("q")) for n, c, q in recipes]
    long = both.select(F.col(y).alias("y"), F.explode(F.array(*structs)).alias("x")).select("y", "x.*")
    inside = lambda a, b: F.avg(((F.col("y") >= F.col("q")[a]) & (F.col("y") <= F.col("q")[b])).cast("double"))
    table = long.groupBy("recipe", "complexity").agg(
        F.avg(K.wis("y", "q")).alias("wis"), inside(1, 5).alias("coverage80"), inside(0, 6).alias("coverage90")
    )
    score = F.col("wis") + F.col("complexity") * F.lit(1e-7)
    if coverage_penalty:
        score = score + F.lit(0.25) * F.abs(F.col("coverage90") - 0.90) + F.lit(0.15) * F.abs(F.col("coverage80") - 0.80)
    table = materialise(table.withColumn("score", score), "recipes")  # one row a recipe, read for the best and for all
    best = table.agg(F.min_by("recipe", F.struct("score", "complexity")).alias("__best"))
    return with_scalars(table, best).withColumn("chosen", F.col("recipe") == F.col("__best")).drop("__best")


# --- probabilities --------------------------------------------------------------------------


def sigmoid(raw: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(raw, F.lit(35.0)), F.lit(-35.0))))


def logit(p: Column) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(clipped / (F.lit(1.0) - clipped))


def calibration_features(df: DataFrame, raw: str, kind: str) -> DataFrame:
    """Score itself (PLATT), or log p and -log(1-p) of its sigmoid (BETA)."""
    value = F.greatest(F.least(F.col(raw), F.lit(20.0)), F.lit(-20.0))
    if kind == "PLATT":
        return VectorAssembler(inputCols=["__a"], outputCol="__x").transform(df.withColumn("__a", value))
    p = F.greatest(F.least(sigmoid(value), F.lit(1 - 1e-6)), F.lit(1e-6))
    both = df.withColumn("__a", F.ln(p)).withColumn("__b", -F.log1p(-p))
    return VectorAssembler(inputCols=["__a", "__b"], outputCol="__x").transform(both)


def fit_logistic(head: DataFrame, y: str, raw: str, kind: str = "PLATT"):
    """L2 logistic map of the score; the penalty acts on standardised features."""
    data = calibration_features(head, raw, kind).withColumn("__y", F.col(y).cast("double"))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1e-3, elasticNetParam=0.0, maxIter=100, tol=1e-10)
    return model.fit(data.select("__x", "__y"))


def apply_logistic(model, df: DataFrame, raw: str, kind: str, name: str) -> DataFrame:
    out = model.transform(calibration_features(df, raw, kind))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("__a", "__b", "__x", "rawPrediction", "probability", "prediction")


BLOCK = "part int, lo double, hi double, w double, s double"


def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators of a sorted partition: a block joins the one before while its mean is not larger."""
    part = TaskContext.get().partitionId()
    lo, hi, w, s = [], [], [], []
    for batch in batches:
        for a, b, weight, total in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "w", "s"))):
            while w and s[-1] * weight >= total * w[-1]:
                a, weight, total = lo.pop(), weight + w.pop(), total + s.pop()
                hi.pop()
            lo.append(a), hi.append(b), w.append(weight), s.append(total)
    columns = [pa.array([part] * len(lo), pa.int32()), *(pa.array(c, pa.float64()) for c in (lo, hi, w, s))]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "lo", "hi", "w", "s"])


def fit_isotonic(head: DataFrame, y: str, raw: str, parts: int | None = None) -> DataFrame:
    """Blocks (lo, hi, w, mean) of the monotone map with least squared error, over the histogram of scores.

    Every range of scores is pooled by itself; as long as the means fall across an edge between two ranges, neighbouring
    ranges are dealt to half as many and their blocks pooled again. Pooling in any order gives the same blocks, and only
    blocks travel after the first round. Rows without score or label are left out.
    """
    spark = head.sparkSession
    data = head.where(F.col(raw).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(raw).cast("double").alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("s")
    )
    blocks = data.select("lo", F.col("lo").alias("hi"), "w", "s")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo")
        blocks = materialise(dealt.mapInArrow(pool, BLOCK), "blocks")
        mean = F.col("s") / F.col("w")
        edges = blocks.groupBy("part").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))  # one row a range
        falls = F.col("first") <= F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part"))
        if parts == 1 or edges.select(falls.alias("f")).where("f").isEmpty():
            return blocks.select("lo", "hi", "w", mean.alias("mean"))
        parts = (parts + 1) // 2


def apply_isotonic(model: DataFrame, df: DataFrame, raw: str, name: str) -> DataFrame:
    """Interpolated between the ends of blocks and constant beyond the outer ones; a null score stays null."""
    ends = model.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("__x"), "mean")
    rows = df.withColumn("__x", F.col(raw).cast("double"))
    near = neighbours(rows, ends, "__x", "mean")
    below, above = F.col("below"), F.col("above")
    share = (F.col("__x") - below["x"]) / (above["x"] - below["x"])
    value = F.when(below.isNull(), above["v"]).when(above.isNull(), below["v"]).otherwise(below["v"] + (above["v"] - below["v"]) * share)
    clipped = F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))
    return join_on(rows, near.select("__x", clipped.alias(name)), ["__x"], "left").drop("__x")


def isotonic_allowed(head: DataFrame, y: str, rows: int = 200, rarer: int = 30) -> bool:
    """Whether a head has enough rows, and enough of its rarer class, for a monotone map."""
    n, positive = head.agg(F.count(F.lit(1)), F.count_if(F.col(y) == 1)).first()
    return n >= rows and min(positive, n - positive) >= rarer


RECIPES = ("SIGMOID", "PLATT", "BETA", "ISOTONIC")  # simplest first; the last only where ``isotonic_allowed``


def recipe_columns(df: DataFrame) -> dict[str, str]:
    """Recipes that a frame holds, with their probability columns."""
    return {n: f"p_{n.lower()}" for n in RECIPES if f"p_{n.lower()}" in df.columns}


def with_probability_recipes(head: DataFrame, df: DataFrame, y: str, raw: str) -> DataFrame:
    """Calibrated probability columns ``p_<recipe>`` of every recipe fitted on the head."""
    out = df.withColumn("p_sigmoid", sigmoid(F.col(raw)))
    for kind in ("PLATT", "BETA"):
        out = apply_logistic(fit_logistic(head, y, raw, kind), out, raw, kind, f"p_{kind.lower()}")
    if not isotonic_allowed(head, y):
        return out
    return apply_isotonic(fit_isotonic(head, y, raw), out, raw, "p_isotonic")


def choose_probability_recipe(df: DataFrame, y: str, recipes: dict[str, str]) -> DataFrame:
    """Proper score per recipe column and the chosen one, simplest first on a tie."""
    structs = [
        F.struct(F.lit(n).alias("recipe"), F.lit(i).alias("complexity"), F.col(c).cast("double").alias("p"))
        for i, (n, c) in enumerate(recipes.items())
    ]
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*structs)).alias("x")).select("y", "x.*")
    p = clip_probability("p", EPS)
    table = long.groupBy("recipe", "complexity").agg(
        (F.avg(log_loss("y", p)) + F.avg(F.pow(p - F.col("y"), 2))).alias("proper_score")
    )
    key = F.struct(F.col("proper_score") + F.col("complexity") * F.lit(1e-6), F.col("complexity"))
    best = table.agg(F.min_by("recipe", key).alias("__best"))
    return with_scalars(table, best).withColumn("chosen", F.col("recipe") == F.col("__best")).drop("__best")
