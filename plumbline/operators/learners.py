"""S- and T-learners: potential outcomes by L2 logistic regression.

Numbers are imputed by the exact median and standardised by the population
deviation, texts one-hot coded with unknown ones as all zeros. The penalty is
that of C = 1: the regularisation parameter is one over the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UpliftError
from ..functions.ordered import MIDDLE, middle, values_at
from ..sources.sinks import write_atomic
from ..sources.staging import staged
from . import uplift

TREATMENT = "__treatment__"
UNKNOWN = "unknown"
#: Rows whose medians are found in one aggregate at most.
GATHERED = 1_000_000


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    temporal: tuple[str, ...]


def feature_spec(df: DataFrame, features: Sequence[str]) -> FeatureSpec:
    numeric, categorical, temporal = [], [], []
    for c in features:
        kind = df.schema[c].dataType
        if isinstance(kind, T.NumericType):
            numeric.append(c)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            temporal.append(c)
        elif isinstance(kind, (T.StringType, T.BooleanType, T.NullType)):
            categorical.append(c)
        else:
            raise UpliftError(f"{c} is {kind.simpleString()}, which can't be a feature")
    return FeatureSpec(tuple(numeric), tuple(categorical), tuple(temporal))


def _number(c: str, spec: FeatureSpec, df: DataFrame) -> Column:
    if c not in spec.temporal:
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)
    if isinstance(df.schema[c].dataType, T.DateType):
        return F.unix_date(F.col(f"`{c}`")).cast("double")
    return F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double")


@dataclass
class Preprocessor:
    """Fitted on training rows alone."""

    spec: FeatureSpec
    extra: tuple[str, ...] = ()
    scales: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    coder: PipelineModel | None = None

    def _prepared(self, df: DataFrame) -> DataFrame:
        numbers = {f"__n{k}": _number(c, self.spec, df) for k, c in enumerate(self._numbers())}
        texts = {f"__c{k}": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(UNKNOWN)) for k, c in enumerate(self.spec.categorical)}
        return df.withColumns(numbers | texts) if numbers or texts else df

    def _numbers(self) -> list[str]:
        return [*self.spec.numeric, *self.spec.temporal, *self.extra]

    def fit(self, df: DataFrame) -> Preprocessor:
        rows, names = self._prepared(df), [f"__n{k}" for k in range(len(self._numbers()))]
        if names:
            medians = _medians(rows, names)
            medians = {c: 0.0 if v is None else v for c, v in medians.items()}
            filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in medians.items()}
            moments = rows.agg(*[f(filled[c]).alias(f"{c}{n}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
            self.scales = {c: (medians[c], moments[f"{c}m"], moments[f"{c}s"] or 1.0) for c in names}
        if self.spec.categorical:
            texts = [f"__c{k}" for k in range(len(self.spec.categorical))]
            index = StringIndexer(inputCols=texts, outputCols=[f"{c}i" for c in texts], handleInvalid="keep", stringOrderType="alphabetAsc")
            hot = OneHotEncoder(inputCols=[f"{c}i" for c in texts], outputCols=[f"{c}v" for c in texts], dropLast=True)  # the last is the unknown one
            self.coder = Pipeline(stages=[index, hot]).fit(rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self._prepared(df)
        rows = rows.withColumns({c: (F.coalesce(F.col(c), F.lit(m)) - F.lit(a)) / F.lit(s) for c, (m, a, s) in self.scales.items()}) if self.scales else rows
        if self.coder:
            rows = self.coder.transform(rows)
        parts = [*self.scales, *[f"__c{k}v" for k in range(len(self.spec.categorical))]]
        rows = VectorAssembler(inputCols=parts, outputCol="__features").transform(rows)
        return rows.select(*[f"`{c}`" for c in df.columns], "__features")


def _medians(rows: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Exact medians: gathered in one aggregate while there are few rows, by places in a distributed order beyond."""
    if rows.count() <= GATHERED:
        return rows.agg(*[F.median(c).alias(c) for c in names]).first().asDict()
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])).alias("x")).select("x.*")
    found = {r["column"]: r["median"] for r in values_at(long, MIDDLE).select("column", middle().alias("median")).collect()}
    return {c: found.get(c) for c in names}


def _fitted(df: DataFrame, pre: Preprocessor, target: str, what: str, estimator=None):
    n, kinds = df.agg(F.count(F.lit(1)), F.count_distinct(target)).first()
    if kinds < 2:
        raise UpliftError(f"{what} must have both outcomes")
    if estimator is None:
        estimator = LogisticRegression(maxIter=1000, tol=1e-8, regParam=1 / n, elasticNetParam=0.0, standardization=False)
    estimator = estimator.copy({estimator.featuresCol: "__features", estimator.labelCol: "__label"})
    rows = pre.transform(df).select("__features", F.col(target).cast("double").alias("__label"))
    return estimator.fit(rows)


def _probability(df: DataFrame, pre: Preprocessor, model, name: str) -> DataFrame:
    model = model.copy({model.featuresCol: "__features", model.predictionCol: "__p", model.probabilityCol: "__probability", model.rawPredictionCol: "__raw"})
    scored = model.transform(pre.transform(df))
    return scored.select(*[f"`{c}`" for c in df.columns], vector_to_array("__probability")[1].alias(name))


def _with_uplift(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_uplift", F.col("probability_treatment") - F.col("probability_control"))


@dataclass
class SLearner:
    """One model, the treatment being one of its numbers."""

    estimator: object = None

    def fit(self, df: DataFrame, features: Sequence[str], treatment: str = "treatment", target: str = "target", checked: bool = False) -> SLearner:
        """``checked``: the rows are known to be modelable."""
        if TREATMENT in df.columns:
            raise UpliftError(f"{TREATMENT} is reserved")
        if not checked:
            uplift.require_modelable(df, features, treatment, target)
        rows = df.withColumn(TREATMENT, F.col(treatment).cast("double"))
        self.pre = Preprocessor(feature_spec(df, features), (TREATMENT,)).fit(rows)
        self.model = _fitted(rows, self.pre, target, "the sample", self.estimator)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        for t, name in ((0.0, "probability_control"), (1.0, "probability_treatment")):
            df = _probability(df.withColumn(TREATMENT, F.lit(t)), self.pre, self.model, name).drop(TREATMENT)
        return _with_uplift(df)


@dataclass
class TLearner:
    """A model for each arm, each with its own preprocessing."""

    estimator: object = None

    def fit(self, df: DataFrame, features: Sequence[str], treatment: str = "treatment", target: str = "target", checked: bool = False) -> TLearner:
        """``checked``: the rows are known to be modelable."""
        if not checked:
            uplift.require_modelable(df, features, treatment, target)
        self.arms = []
        for arm, name in ((0, "probability_control"), (1, "probability_treatment")):
            rows = df.filter(F.col(treatment) == arm)
            pre = Preprocessor(feature_spec(df, features)).fit(rows)
            self.arms.append((name, pre, _fitted(rows, pre, target, f"arm {arm}", self.estimator)))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        for name, pre, model in self.arms:
            df = _probability(df, pre, model, name)
        return _with_uplift(df)


LEARNERS = {"s_learner": SLearner, "t_learner": TLearner}


@dataclass
class Modeling:
    """``customer_scores`` are those of a fit on all rows, which is made when they are first asked for."""

    predictions: DataFrame
    comparison: DataFrame
    curves: DataFrame
    deciles: DataFrame
    refit: Callable[[], DataFrame]

    @cached_property
    def customer_scores(self) -> DataFrame:
        return self.refit()


def _scored(df: DataFrame, learners: dict, keep: Sequence[str]) -> DataFrame:
    """Both learners' predictions as columns of the same row."""
    for name, learner in learners.items():
        own = [c for c in ("probability_control", "probability_treatment", "predicted_uplift")]
        df = learner.predict(df).withColumnsRenamed({c: f"{name}_{c}" for c in own})
        keep = [*keep, *[f"{name}_{c}" for c in own]]
    return df.select(*keep)


def train_and_evaluate(df: DataFrame, features: Sequence[str] | None = None, id_col: str = "client_id", share: float = 0.3, bins: int = 10, seed: int = 42, treatment: str = "treatment", target: str = "target") -> Modeling:
    """Fit on the training part, evaluate both learners on the same holdout, refit on all rows, score all."""
    features = list(features or uplift.infer_features(df, (id_col,), treatment, target))
    uplift.require_modelable(df, features, treatment, target)
    parts = staged(uplift.split(df, id_col, share, seed, treatment, target), "split")
    train, holdout = parts.filter("NOT is_holdout").drop("is_holdout"), parts.filter("is_holdout").drop("is_holdout")
    # the split has both outcomes in both arms if the table has, as far as there are rows for it; what lacks one fails in its fit
    fitted = {n: kind().fit(train, features, treatment, target, checked=True) for n, kind in LEARNERS.items()}
    predictions = staged(_scored(holdout, fitted, [id_col, treatment, target]), "holdout")
    n_train, n_holdout = train.count(), holdout.count()
    rows, curves, deciles = [], [], []
    for name in LEARNERS:
        found = uplift.evaluate(predictions, id_col, f"{name}_predicted_uplift", bins, treatment, target)
        rows.append(found.summary.select(F.lit(name).alias("model"), F.lit(n_train).cast("long").alias("train_customers"), F.lit(n_holdout).cast("long").alias("holdout_customers"), "*", F.lit(seed).alias("random_state")))
        curves.append(found.curve.withColumn("model", F.lit(name)))
        deciles.append(found.deciles.withColumn("model", F.lit(name)))

    def refit() -> DataFrame:
        return _scored(df, {n: kind().fit(df, features, treatment, target, checked=True) for n, kind in LEARNERS.items()}, [id_col])

    return Modeling(predictions, rows[0].unionByName(rows[1]), curves[0].unionByName(curves[1]), deciles[0].unionByName(deciles[1]), refit)


def materialize(result: Modeling, folder: str) -> dict[str, str]:
    names = {"predictions": "uplift_predictions_holdout", "customer_scores": "uplift_customer_scores", "comparison": "uplift_model_comparison", "curves": "uplift_curves", "deciles": "uplift_deciles"}
    return {k: write_atomic(getattr(result, k), f"{folder}/{v}.parquet", small=k in ("comparison", "deciles")) for k, v in names.items()}
