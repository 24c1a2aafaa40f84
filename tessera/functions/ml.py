"""Learning: thin, named layers over pyspark.ml pipelines, and series models.

`train` functions take a DataFrame and return a fitted PipelineModel; `predict` adds columns; `evaluate` returns a DataFrame of metrics.
Feature encodings: numbers as they are, strings as one-hot of their index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import evaluation as E
from pyspark.ml import regression as R
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, IndexToString, OneHotEncoder, QuantileDiscretizer, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analytic import window
from .registry import add


def features(df: DataFrame, columns, output: str = "features") -> list:
    """Pipeline stages that put columns in one vector."""
    kinds = dict(df.dtypes)
    stages, inputs = [], []
    for c in columns:
        if kinds[c] in ("string", "boolean"):
            stages += [StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__index", outputCol=f"{c}__hot")]
            inputs.append(f"{c}__hot")
        else:
            inputs.append(c)
    return [*stages, VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep")]


def _train(estimator):
    def train(df: DataFrame, label: str, columns, **params) -> PipelineModel:
        return Pipeline(stages=[*features(df, columns), estimator(labelCol=label, featuresCol="features", predictionCol="prediction", **params)]).fit(df)

    return train


def gam(df: DataFrame, label: str, columns, bins: int = 16, **params) -> PipelineModel:
    """Additive model: each feature by its quantile bin, one-hot, in a linear model."""
    cut = [QuantileDiscretizer(inputCol=c, outputCol=f"{c}__bin", numBuckets=bins, handleInvalid="keep") for c in columns]
    hot = [OneHotEncoder(inputCol=f"{c}__bin", outputCol=f"{c}__hot", handleInvalid="keep") for c in columns]
    join = VectorAssembler(inputCols=[f"{c}__hot" for c in columns], outputCol="features")
    return Pipeline(stages=[*cut, *hot, join, R.LinearRegression(labelCol=label, regParam=1e-3, **params)]).fit(df)


TRAINERS = {
    "RegressionFastTreeTrain": _train(R.GBTRegressor), "RegressionGamTrain": gam, "RegressionSdcaTrain": _train(lambda **k: R.LinearRegression(regParam=1e-6, **k)),
    "RegressionFastForestTrain": _train(R.RandomForestRegressor), "RegressionFastTreeTweedieTrain": _train(lambda **k: R.GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, **k)),
    "RegressionLbfgsPoissonTrain": _train(lambda **k: R.GeneralizedLinearRegression(family="poisson", link="log", **k)),
    "RegressionOnlineGradientDescentTrain": _train(lambda **k: R.LinearRegression(solver="l-bfgs", **k)),
}
METRICS = ("mae", "mse", "rmse", "r2")


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    drop = [c for c in model.transform(df).columns if c.endswith(("__index", "__hot", "__bin")) or c in ("features", "rawPrediction", "words", "counts")]
    return model.transform(df).drop(*drop)


def regression_evaluate(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    out = model.transform(df).select(label, "prediction")
    row = {m: float(E.RegressionEvaluator(labelCol=label, metricName=m).evaluate(out)) for m in METRICS}
    return df.sparkSession.createDataFrame([row])


def experiment(df: DataFrame, label: str, columns, trainers=None, fraction: float = 0.8, seed: int = 1) -> DataFrame:
    """Every trainer's metrics on held-out rows, best first."""
    a, b = df.randomSplit([fraction, 1 - fraction], seed)
    rows = []
    for name in trainers or TRAINERS:
        out = TRAINERS[name](a, label, columns).transform(b)
        rows.append({"trainer": name} | {m: float(E.RegressionEvaluator(labelCol=label, metricName=m).evaluate(out)) for m in METRICS})
    return df.sparkSession.createDataFrame(rows).orderBy("rmse")


def experiment_best(df: DataFrame, label: str, columns, trainers=None, **k) -> PipelineModel:
    name = experiment(df, label, columns, trainers, **k).first()["trainer"]
    return TRAINERS[name](df, label, columns)


def kmeans(df: DataFrame, columns, k: int = 3, seed: int = 1) -> PipelineModel:
    return Pipeline(stages=[*features(df, columns), KMeans(k=k, seed=seed)]).fit(df)


def kmeans_evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    row = {"silhouette": float(E.ClusteringEvaluator().evaluate(out)), "cost": float(model.stages[-1].summary.trainingCost if model.stages[-1].hasSummary else float("nan"))}
    return df.sparkSession.createDataFrame([row])


def sdca(df: DataFrame, label: str, columns, **params) -> PipelineModel:
    index = StringIndexer(inputCol=label, outputCol="label__index", handleInvalid="skip").fit(df)
    model = C.LogisticRegression(labelCol="label__index", family="multinomial", regParam=1e-4, **params)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=index.labels)
    return Pipeline(stages=[index, *features(df, columns), model, back]).fit(df)


def sdca_evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    row = {m: float(E.MulticlassClassificationEvaluator(labelCol="label__index", metricName=m).evaluate(out)) for m in ("accuracy", "f1", "logLoss")}
    return df.sparkSession.createDataFrame([row])


def recommend(df: DataFrame, item1: str, item2: str, rank: int = 8, **params) -> PipelineModel:
    """Matrix factorisation of pairs that occur together; pairs count once for each row."""
    pairs = df.groupBy(item1, item2).agg(F.count("*").cast("float").alias("rating"))
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="skip") for c in (item1, item2)]
    als = ALS(userCol=f"{item1}__index", itemCol=f"{item2}__index", ratingCol="rating", implicitPrefs=True, rank=rank, seed=1, coldStartStrategy="drop", **params)
    return Pipeline(stages=[*index, als]).fit(pairs)


def recommend_evaluate(model: PipelineModel, df: DataFrame, item1: str, item2: str) -> DataFrame:
    pairs = df.groupBy(item1, item2).agg(F.lit(1.0).alias("rating"))
    row = {"rmse": float(E.RegressionEvaluator(labelCol="rating").evaluate(model.transform(pairs)))}
    return df.sparkSession.createDataFrame([row])


def sentiment(estimator):
    def train(df: DataFrame, label: str, text: str, size: int = 1 << 14, **params) -> PipelineModel:
        stages = [Tokenizer(inputCol=text, outputCol="words"), HashingTF(inputCol="words", outputCol="counts", numFeatures=size), IDF(inputCol="counts", outputCol="features")]
        return Pipeline(stages=[*stages, estimator(labelCol=label, **params)]).fit(df.withColumn(label, F.col(label).cast("double")))

    return train


def sentiment_evaluate(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    out = model.transform(df.withColumn(label, F.col(label).cast("double")))
    row = {m: float(E.BinaryClassificationEvaluator(labelCol=label, metricName=m).evaluate(out)) for m in ("areaUnderROC", "areaUnderPR")}
    return df.sparkSession.createDataFrame([row])


# --- series ---------------------------------------------------------------------------------------------------------


def spikes(df: DataFrame, series: str, value: str, group=(), history: int = 30, confidence: float = 0.95) -> DataFrame:
    """Adds is_spike, p_value: a point against the mean and spread of its history, two-sided, under a normal law."""
    w = window(list(group), series).rowsBetween(-history, -1)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    # The logistic form of the normal distribution function, good to 1e-4
    a = F.abs(z)
    p = 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))
    return df.withColumn("p_value", F.coalesce(p, F.lit(1.0))).withColumn("is_spike", F.col("p_value") < 1 - confidence)


def spike_model(df: DataFrame, value: str) -> dict:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev")).first().asDict()


def spike_predict(model: dict, x, confidence: float = 0.95):
    a = F.abs((x - model["mean"]) / (model["stddev"] or float("nan")))
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a)) < 1 - confidence


def _curve(kind: str, degree: int, x: np.ndarray, y: np.ndarray, at: np.ndarray):
    if kind == "exponential":
        b, a = np.polyfit(x, np.log(y), 1)
        return np.exp(a + b * at), [float(np.exp(a)), float(b)]
    if kind == "logarithm":
        b, a = np.polyfit(np.log(x + 1), y, 1)
        return a + b * np.log(at + 1), [float(a), float(b)]
    c = np.polyfit(x, y, degree)
    return np.polyval(c, at), [float(v) for v in c[::-1]]


def regression_curve(kind: str = "linear", degree: int = 1):
    """A fit over the numbered points of each group; rows marked as forecast aren't fitted to. Adds fit, coefficients.

    The linear fit is a window expression; the others take a group's points to one task, so a group is one series.
    """

    def build(df: DataFrame, series: str, value: str, group=(), forecast: str | None = None) -> DataFrame:
        group = list(group)
        if kind == "linear":
            w = window(group)
            out = df.withColumn("__i", (F.row_number().over(window(group, series)) - 1).cast("double"))
            y = F.col(value).cast("double") if forecast is None else F.when(~F.col(forecast), F.col(value).cast("double"))
            slope, cut = F.regr_slope(y, "__i").over(w), F.regr_intercept(y, "__i").over(w)
            return out.withColumn("coefficients", F.array(cut, slope)).withColumn("fit", cut + slope * F.col("__i")).drop("__i")

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", fit double, coefficients array<double>"

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values(series)
            at = np.arange(len(p), dtype=float)
            y = p[value].to_numpy(float)
            use = ~np.isnan(y) if forecast is None else ~p[forecast].to_numpy(bool) & ~np.isnan(y)
            if kind == "exponential":
                use &= y > 0
            if use.sum() <= degree:
                return p.assign(fit=np.nan, coefficients=[[]] * len(p))
            line, c = _curve(kind, degree, at[use], y[use], at)
            return p.assign(fit=line, coefficients=[c] * len(p))

        return df.groupBy(*group).applyInPandas(run, schema)

    return build


def ssa(y: np.ndarray, ahead: int, length: int, rank: int) -> tuple[np.ndarray, float]:
    """Forecast by singular spectrum analysis: the linear recurrence of the leading components; and the fit's spread."""
    n = len(y)
    length = max(2, min(length, n // 2))
    rows = np.lib.stride_tricks.sliding_window_view(y, length).T
    u, s, vt = np.linalg.svd(rows, full_matrices=False)
    r = min(rank, length - 1, int((s > 1e-10 * s[0]).sum()) or 1)
    low = (u[:, :r] * s[:r]) @ vt[:r]
    smooth = np.array([np.mean(np.diag(low[::-1], k)) for k in range(-length + 1, n - length + 1)])
    pi = u[-1, :r]
    nu = float(pi @ pi)
    if nu >= 1 - 1e-9:
        return np.full(ahead, smooth[-1]), float(np.std(y - smooth))
    coef = (u[:-1, :r] @ pi) / (1 - nu)
    out = list(smooth)
    for _ in range(ahead):
        out.append(float(np.dot(coef, out[-(length - 1) :])))
    return np.array(out[n:]), float(np.std(y - smooth))


def forecast(df: DataFrame, series: str, value: str, group=(), is_forecast: str = "is_forecast", length: int = 8, rank: int = 4, confidence: float = 0.95) -> DataFrame:
    """Adds forecast, lower, upper to the rows marked as forecast, from the group's other rows; a group is one series."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf((1 + confidence) / 2)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", forecast double, lower double, upper double"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(series)
        ahead = p[is_forecast].to_numpy(bool)
        y = p.loc[~ahead, value].to_numpy(float)
        out = np.full(len(p), np.nan)
        spread = np.nan
        if len(y) >= 4 and ahead.any():
            out[ahead], spread = ssa(y, int(ahead.sum()), length, rank)
        return p.assign(forecast=out, lower=out - z * spread, upper=out + z * spread)

    return df.groupBy(*group).applyInPandas(run, schema)


add("ml", "estimator", SpikeDetection=spikes, SpikeDetectionModel=spike_model, ClusteringKMeansTrain=kmeans, ClusteringKMeansEvaluate=kmeans_evaluate, ClusteringKMeansPredict=predict,
    ClusteringKMeansRun=lambda df, columns, k=3: predict(kmeans(df, columns, k), df), ClusteringSdcaTrain=sdca, ClusteringSdcaEvaluate=sdca_evaluate, ClusteringSdcaPredict=predict,
    ForecastTimeSeries=forecast, RecommendationTrain=recommend, RecommendationEvaluate=recommend_evaluate, RecommendationPredict=predict, RegressionExperimentBest=experiment_best,
    RegressionExperimentSeries=experiment, RegressionEvaluate=regression_evaluate, RegressionPredict=predict, SentimentFastTreeTrain=sentiment(C.GBTClassifier),
    SentimentSdcaRegressionTrain=sentiment(C.LogisticRegression), SentimentEvaluate=sentiment_evaluate, SentimentPrediction=predict, **TRAINERS)
add("ml", "map", SpikePredict=spike_predict)
add("curve", "series", LinearRegression=regression_curve("linear"), PolynomialRegression=lambda df, series, value, degree=2, **k: regression_curve("polynomial", degree)(df, series, value, **k),
    ExponentialRegression=regression_curve("exponential"), LogarithmRegression=regression_curve("logarithm"))
