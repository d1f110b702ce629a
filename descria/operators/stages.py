"""The operators as ``pyspark.ml`` stages, to be chained with ``Pipeline`` and saved.

Transformers are stateless; estimators learn column lists or fill values and
return a model that only projects, so a fitted chain also runs on streams.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from descria.columns import CLASS_PROTECTED, is_numeric, quoted, remaining_columns, require_columns
from descria.operators import clean, impute, moments, prune, select


def _ranged(low: float, high: float):
    def convert(value):
        number = TypeConverters.toFloat(value)
        if not low <= number <= high:
            raise ValueError(f"{number} is outside [{low}, {high}]")
        return number

    return convert


class _Shared(Params):
    """Parameters common to the stages, with validated ranges."""

    threshold = Param(Params._dummy(), "threshold", "cut-off in [0, 1]", _ranged(0.0, 1.0))
    protected = Param(Params._dummy(), "protected", "columns passed through", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "target column", TypeConverters.toString)
    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    strategy = Param(Params._dummy(), "strategy", "mean, median or most_frequent", TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", "target_based, upper or lower", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "selection method", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "kept columns", TypeConverters.toListString)
    values = Param(Params._dummy(), "values", "fill values", TypeConverters.toListFloat)

    def get(self, param: Param):
        return self.getOrDefault(param)

    def features(self, df: DataFrame) -> list[str]:
        skip = {*self.get(self.protected), self.get(self.target)}
        return [f.name for f in df.schema.fields if is_numeric(f) and f.name not in skip]


class _Stage(_Shared, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(
            threshold=0.5, protected=list(CLASS_PROTECTED), target="Label", task="classification",
            strategy="mean", mode="target_based", method="Lasso",
        )
        self._set(**kwargs)


class ReplaceInfinite(_Stage, Transformer):
    """Infinities and NaN to NULL."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean.replace_inf(dataset)


class DropSparseRows(_Stage, Transformer):
    """Rows with a share of missing cells above ``threshold`` go."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean.drop_high_nan_rows(dataset, self.get(self.threshold))


class KeepColumnsModel(_Stage, Model):
    """Projection to a learnt column list."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.get(self.columns)
        return require_columns(dataset, names).select(*[quoted(c) for c in names])


class FillModel(_Stage, Model):
    """Projection that fills learnt constants."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fills = dict(zip(self.get(self.columns), self.get(self.values), strict=True))
        return impute.apply_fills(require_columns(dataset, fills), fills)


class DropSparseColumns(_Stage, Estimator):
    """Learns which columns have a share of missing cells within ``threshold``."""

    def _fit(self, dataset: DataFrame) -> KeepColumnsModel:
        sparse = clean.sparse_columns(moments.missing_counts(dataset, dataset.columns), self.get(self.threshold))
        order = clean.retained_order(dataset.columns, sparse, self.get(self.protected), self.get(self.task))
        return KeepColumnsModel(columns=order)


class FillMissing(_Stage, Estimator):
    """Learns the mean, exact median or mode of every feature; empty columns are left as they are."""

    def _fit(self, dataset: DataFrame) -> FillModel:
        found = impute.fill_values(dataset, self.features(dataset), self.get(self.strategy))
        known = {c: float(v) for c, v in found.items() if v is not None}
        return FillModel(columns=list(known), values=list(known.values()))


class DropLowVariance(_Stage, Estimator):
    """Learns the features whose population variance is above ``threshold``."""

    def _fit(self, dataset: DataFrame) -> KeepColumnsModel:
        result = prune.low_variance(dataset, self.features(dataset), self.get(self.threshold))
        return KeepColumnsModel(columns=remaining_columns(dataset.columns, result.removed))


class DropCorrelated(_Stage, Estimator):
    """Learns which side of every highly correlated feature pair stays."""

    def _fit(self, dataset: DataFrame) -> KeepColumnsModel:
        result = prune.high_correlation(
            dataset, self.features(dataset), self.get(self.target), self.get(self.threshold),
            self.get(self.mode), self.get(self.task),
        )
        return KeepColumnsModel(columns=remaining_columns(dataset.columns, result.removed))


class SelectByModel(_Stage, Estimator):
    """Learns the features chosen by a fitted model."""

    def _fit(self, dataset: DataFrame) -> KeepColumnsModel:
        protected = [c for c in self.get(self.protected) if c in dataset.columns and c != self.get(self.target)]
        result = select.select_by_model(
            dataset, self.get(self.method), self.get(self.target), self.get(self.task),
            threshold=self.get(self.threshold), protected=protected,
        )
        return KeepColumnsModel(columns=result.table.columns)
