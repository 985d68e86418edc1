"""Fits on pyspark.ml: reduction, clusters, linear and boosted models, calibration, stacking, selection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import clip, safe
from riskloom.operators import dealt
from riskloom.operators.evaluate import average_precision, best_f1

SEED = 17


def principal(df: DataFrame, vec: str, train: Column, k: int, out: str = "pc") -> DataFrame:
    """Components fitted on centred training rows; the transform does not centre, so rows are centred for it too."""
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False)
    rows = df.withColumn("_v", array_to_vector(vec))
    model = Pipeline(stages=[scaler, PCA(k=k, inputCol="_c", outputCol="_p")]).fit(rows.where(train))
    return model.transform(rows).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")


def clustered(df: DataFrame, vec: str, train: Column, k: int) -> DataFrame:
    """Distances to each centroid (k small vectors, as a literal), the least and the mean of them."""
    rows = df.withColumn("_v", array_to_vector(vec))
    centres = KMeans(k=k, featuresCol="_v", seed=SEED).fit(rows.where(train)).clusterCenters()
    lists = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with(F.col(vec), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    out = rows.drop("_v").withColumn("distances", F.transform(lists, gap))
    return out.withColumns({"nearest": F.array_min("distances"), "mean_distance": F.aggregate("distances", F.lit(0.0), lambda s, x: s + x) / k})


def class_weight(df: DataFrame, y: str, most: float = 20.0) -> float:
    """(1 - p) / p of the positives' share, at most ``most``."""
    p = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    return min((1 - p) / p, most) if p else most


def skewed(df: DataFrame, features: Sequence[str], bound: float = 5.0) -> list[str]:
    """Features with a long tail and no negatives."""
    row = df.agg(*[F.struct(F.skewness(c).alias("s"), F.min(c).alias("m")).alias(c) for c in features]).first()
    return [c for c in features if row[c].s is not None and row[c].s > bound and row[c].m >= 0]


def preprocessing(df: DataFrame, features: Sequence[str], category: str | None = None) -> tuple[DataFrame, list]:
    """Logs of skewed features, and stages: median, mean and spread, one-hot category, one vector ``x``."""
    df = df.withColumns({c: F.log1p(c) for c in skewed(df, features)}) if features else df
    df = df.withColumns({c: F.col(c).cast("double") for c in features})
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=[f"_i_{c}" for c in features]), VectorAssembler(inputCols=[f"_i_{c}" for c in features], outputCol="_f"), StandardScaler(inputCol="_f", outputCol="_z", withMean=True)]
    inputs = ["_z"]
    if category:
        stages += [StringIndexer(inputCol=category, outputCol="_k", handleInvalid="keep"), OneHotEncoder(inputCols=["_k"], outputCols=["_o"])]
        inputs.append("_o")
    return df, [*stages, VectorAssembler(inputCols=inputs, outputCol="x")]


def _scored(model, df: DataFrame, out: str) -> DataFrame:
    new = [c for c in model.transform(df).columns if c not in df.columns]
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop(*[c for c in new if c != out])


def logistic_fit(train: DataFrame, features: Sequence[str], y: str, category: str | None = None, reg: float = 0.01, mix: float = 0.0, balanced: bool = True):
    w = class_weight(train, y) if balanced else 1.0
    df, stages = preprocessing(train.withColumn("_w", F.when(F.col(y) == 1, F.lit(w)).otherwise(F.lit(1.0))), features, category)
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="x", labelCol=y, weightCol="_w", regParam=reg, elasticNetParam=mix, maxIter=50)]).fit(df)


def apply(model, df: DataFrame, out: str = "p") -> DataFrame:
    return _scored(model, df, out)


def chosen_linear(train: DataFrame, val: DataFrame, features: Sequence[str], y: str, family: Sequence[tuple[float, float]] = ((0.01, 0.0), (0.01, 1.0), (0.01, 0.5)), by: str = "f1"):
    """The (strength, mix) of a family with the best validation F1 at its best cut-off (``by="ap"``: average precision), the first on ties, and its model."""
    metric = {"f1": lambda df: best_f1(df, "p", y).first().f1, "ap": lambda df: average_precision(df, "p", y).first().ap}[by]
    tried = [(metric(apply(m, val)) or 0.0, i, m) for i, m in enumerate(logistic_fit(train, features, y, reg=r, mix=x) for r, x in family)]
    best = max(tried, key=lambda t: (t[0], -t[1]))
    return family[best[1]], best[2]


def boosted(train: DataFrame, features: Sequence[str], y: str, rounds: int = 10, depth: int = 3):
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), GBTClassifier(featuresCol="_x", labelCol=y, maxIter=rounds, maxDepth=depth, seed=SEED)]).fit(train)


def folds_by_time(df: DataFrame, day: str, folds: int, out: str = "fold") -> DataFrame:
    """``df`` with a fold number from 0 to ``folds``: the years of ``day`` in order, the earliest ones together so that ``folds`` are left to be predicted."""
    years = sorted(r[0] for r in df.select(F.year(day)).distinct().collect() if r[0] is not None)
    first = max(1, len(years) - folds)
    table = [(y, max(0, k - first + 1)) for k, y in enumerate(years)]
    known = df.sparkSession.createDataFrame(table, f"`year of fold` int, `{out}` int")
    rows = df.drop(out)
    return rows.join(F.broadcast(known), F.year(day) == F.col("year of fold")).select(*rows.columns, out)


def kept(path: str | None, fit: Callable):
    """The model written at ``path`` if it is there, else a fitted one, written there."""
    if path is None:
        return fit()
    try:
        return PipelineModel.load(path)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
    model = fit()
    model.write().overwrite().save(path)
    return model


def out_of_fold(df: DataFrame, fold: str, features: Sequence[str], y: str, models: str | None = None, fit: Callable | None = None) -> DataFrame:
    """Every row after the first fold with p, predicted by a model of all folds before its own.  With ``models`` each fold's model is written there, and a
    run that goes on after a failure fits only the folds that lack one.  ``fit`` takes the past rows and gives a model."""
    learn = fit or (lambda past: boosted(past, features, y))
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)
    parts = []
    for f in folds[1:]:
        model = kept(models and f"{models}/fold={f}", lambda f=f: learn(df.where(F.col(fold) < f)))
        parts.append(_scored(model, df.where(F.col(fold) == f), "p"))
    if not parts:
        return df.withColumn("p", F.lit(None).cast("double")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def stacked(oof: DataFrame, val: DataFrame, columns: Sequence[str], y: str, grid: Sequence[float] = (0.001, 0.01, 0.1)):
    """A logistic model of base predictions; its strength is the one with the best validation average precision."""
    return chosen_linear(oof, val, columns, y, [(g, 0.0) for g in grid], "ap")


def forward_selection(df: DataFrame, models: Sequence[str], y: str, fold: str, most: int = 3) -> list[str]:
    """Adds the model that lifts the mean of folds' average precision most, while any does."""
    picked: list[str] = []
    best = -1.0
    while len(picked) < most:
        names = [m for m in models if m not in picked]
        if not names:
            break
        blends = {m: sum((F.col(c) for c in [*picked, m]), F.lit(0.0)) / (len(picked) + 1) for m in names}
        found = {m: average_precision(df.withColumn("_b", b), "_b", y, [fold]).agg(F.avg("ap")).first()[0] or 0.0 for m, b in blends.items()}
        m = max(found, key=lambda k: (found[k], k))
        if found[m] <= best:
            break
        best, picked = found[m], [*picked, m]
    return picked


def ablation(train: DataFrame, val: DataFrame, blocks: Mapping[str, Sequence[str]], y: str) -> DataFrame:
    """Average precision with all feature blocks, and without each of them, under one configuration."""
    whole = [c for b in blocks.values() for c in b]
    runs = {"all": whole} | {f"without {k}": [c for c in whole if c not in b] for k, b in blocks.items()}
    rows = [(k, len(f), float(average_precision(apply(logistic_fit(train, f, y), val), "p", y).first().ap or 0.0)) for k, f in runs.items() if f]
    return train.sparkSession.createDataFrame(rows, "run string, features int, ap double")


def scaled_per_key(df: DataFrame, values: Sequence[str], train: Column, key: str = "country") -> DataFrame:
    """Standardised with each key's training mean and population spread; keys without training rows keep 0."""
    fit = df.where(train).groupBy(key).agg(*[F.avg(v).alias(f"_m_{v}") for v in values], *[F.stddev_pop(v).alias(f"_s_{v}") for v in values])
    out = df.join(fit, key, "left")
    return out.withColumns({f"{v}_z": safe(F.col(v) - F.col(f"_m_{v}"), f"_s_{v}") for v in values}).select(*df.columns, *[f"{v}_z" for v in values])


def normal_days(df: DataFrame, value: str, cases: DataFrame, q: float = 0.75, cut_days: int = 240, key: str = "country", day: str = "day") -> DataFrame:
    """Days with less than the key's quantile; keys with a case end ``cut_days`` before its date."""
    limit = dealt.percentiles(df, value, {"_q": q}, [key])
    j = df.join(limit, key).join(cases.select(key, F.col("case_day").alias("_case")), key, "left")
    return j.where((F.col(value) <= F.col("_q")) & (F.col("_case").isNull() | (F.col(day) < F.date_sub("_case", cut_days)))).drop("_q", "_case")


def platt(val: DataFrame, score: str, y: str):
    """A logistic model of one score, without penalty."""
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="_s"), LogisticRegression(featuresCol="_s", labelCol=y, regParam=0.0)]).fit(val)


def isotonic(val: DataFrame, score: str, y: str, df: DataFrame, out: str = "calibrated") -> DataFrame:
    model = IsotonicRegression(featuresCol=score, labelCol=y, predictionCol="_iso").fit(val.withColumn(y, F.col(y).cast("double")))
    return model.transform(df).withColumn(out, clip("_iso", 0, 1)).drop("_iso")


def calm_fit(train: DataFrame, val: DataFrame, features: Sequence[str], y: str):
    """A model of calm, and the validation quantile that leaves the observed share of calm days."""
    model = logistic_fit(train, features, y, balanced=False)
    share = val.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    cut = dealt.percentiles(apply(model, val), "p", {"cut": max(0.0, min(1.0, 1 - share))}, ()).first()[0]
    return model, cut
