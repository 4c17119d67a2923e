"""Fit and transform as ``pyspark.ml`` objects: fitted once, saved, loaded, and put into a Pipeline.

An estimator fits one model per key; its model holds a table, one row per key, and
transforms rows of any table with the same columns.  ``write().save`` keeps the params
as metadata and the table as Parquet.  Rows of keys that were not fitted stay, with null
results and a status.
"""

from __future__ import annotations

from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasInputCols, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.operators import features as FE
from kymora.operators import logistic, spatial, splits
from kymora.session import stored


class HasKeys(Params):
    keys: Param = Param(Params._dummy(), "keys", "columns that name a model", TypeConverters.toListString)

    def getKeys(self) -> list[str]:
        return self.getOrDefault(self.keys)


class HasSize(Params):
    size: Param = Param(Params._dummy(), "size", "number of features, or of channels", TypeConverters.toInt)

    def getSize(self) -> int:
        return self.getOrDefault(self.size)


class _Table(Model, MLReadable, MLWritable):
    """A model that is a table."""

    def __init__(self, table: DataFrame | None = None) -> None:
        super().__init__()
        self.table = table

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def copy(self, extra: dict | None = None) -> _Table:
        that = super().copy(extra)
        that.table = self.table
        return that


class _Writer(MLWriter):
    def __init__(self, model: _Table) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.table.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, kind: type[_Table]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _Table:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Fit(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Keyword parameters become params; ``fit`` stores the fitted table, so it is fitted once."""

    model: type[_Table] = _Table
    defaults: dict[str, Any] = {}

    def __init__(self, **given: Any) -> None:
        super().__init__()
        self._setDefault(**self.defaults)
        self._set(**given)

    def fitted(self, rows: DataFrame) -> DataFrame:
        raise TypeError(f"{type(self).__name__} names no fit")

    def _fit(self, dataset: DataFrame) -> _Table:
        return self._copyValues(self.model(stored(self.fitted(dataset))))


# --- scaling ---


class _ScalerParams(HasKeys, HasInputCols):
    pass


class KeyedScalerModel(_Table, _ScalerParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return splits.apply_scaling(dataset, self.table, self.getInputCols(), self.getKeys())


class KeyedScaler(_Fit, _ScalerParams):
    """Scales ``inputCols`` by mean and spread per key; adds ``scaling_status``."""

    model = KeyedScalerModel
    defaults = {"keys": []}

    def fitted(self, rows: DataFrame) -> DataFrame:
        return splits.fit_scaling(rows, self.getInputCols(), self.getKeys())


# --- decoders ---


class _DecoderParams(HasKeys, HasFeaturesCol, HasLabelCol, HasSize):
    classes: Param = Param(Params._dummy(), "classes", "entries of a posterior; from the train labels if not given", TypeConverters.toInt)
    c: Param = Param(Params._dummy(), "c", "inverse strength of the penalty", TypeConverters.toFloat)
    shrinkage: Param = Param(Params._dummy(), "shrinkage", "share of a multiple of the identity in the covariance", TypeConverters.toFloat)
    maxSteps: Param = Param(Params._dummy(), "maxSteps", "passes after which a key counts as not converged", TypeConverters.toInt)


class LinearDecoderModel(_Table, _DecoderParams):
    """Posteriors by linear scores; adds ``posterior`` and ``model_status``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.score_linear(dataset, self.table, self.getKeys(), self.getFeaturesCol(), self.getSize(), self.getOrDefault(self.classes))


class _Decoder(_Fit, _DecoderParams):
    model = LinearDecoderModel
    defaults = {"keys": [], "c": 1.0, "shrinkage": 0.1, "maxSteps": 60}

    def _fit(self, dataset: DataFrame) -> LinearDecoderModel:
        model = super()._fit(dataset)
        if not model.isDefined(model.classes):  # all models of a fit speak of the same classes
            top = model.table.agg(F.max(F.array_max("classes"))).first()[0]
            model._set(classes=1 if top is None else int(top) + 1)
        return model


class DiscriminantDecoder(_Decoder):
    """Linear discriminant per key from class moments."""

    def fitted(self, rows: DataFrame) -> DataFrame:
        return FE.fit_discriminant(rows, self.getKeys(), self.getFeaturesCol(), self.getLabelCol(), self.getSize(), self.getOrDefault(self.shrinkage))


class LogisticDecoder(_Decoder):
    """Multinomial logistic model per key, all keys at once."""

    def fitted(self, rows: DataFrame) -> DataFrame:
        first = rows.withColumn("_x", F.slice(F.col(self.getFeaturesCol()), 1, self.getSize()))
        return logistic.fit_logistic(first, self.getKeys(), "_x", self.getLabelCol(), self.getSize(), self.getOrDefault(self.c), max_steps=self.getOrDefault(self.maxSteps))


DECODERS: dict[str, type[_Decoder]] = {"discriminant": DiscriminantDecoder, "logistic": LogisticDecoder}

# --- tangent space ---


class _TangentParams(HasKeys, HasInputCol, HasOutputCol, HasSize):
    pass


class TangentSpaceModel(_Table, _TangentParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return FE.tangent_features(dataset, self.table, self.getKeys(), self.getSize(), self.getInputCol(), self.getOutputCol())


class TangentSpace(_Fit, _TangentParams):
    """Tangent vectors of covariances (upper triangles) at the mean of the train rows per key."""

    model = TangentSpaceModel
    defaults = {"keys": [], "inputCol": "cov", "outputCol": "features"}

    def fitted(self, rows: DataFrame) -> DataFrame:
        return FE.geometric_mean(rows.withColumn("cov", F.col(self.getInputCol())), self.getKeys(), self.getSize())


# --- spatial filters ---


class _SpatialParams(HasKeys, HasInputCol, HasOutputCol, HasLabelCol, HasSize):
    components: Param = Param(Params._dummy(), "components", "filters of each class at most", TypeConverters.toInt)


class SpatialFiltersModel(_Table, _SpatialParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return spatial.spatial_log_power(dataset, self.table, self.getKeys(), self.getLabelCol(), self.getSize(), self.getInputCol(), self.getOutputCol())


class SpatialFilters(_Fit, _SpatialParams):
    """Log variance of windows behind filters of each class against the rest, from covariances (upper triangles)."""

    model = SpatialFiltersModel
    defaults = {"keys": [], "inputCol": "cov", "outputCol": "features", "components": 4}

    def fitted(self, rows: DataFrame) -> DataFrame:
        return spatial.fit_spatial(rows, self.getKeys(), self.getLabelCol(), self.getSize(), self.getOrDefault(self.components), self.getInputCol())
