"""LambdaMART as a stage of Spark ML pipelines, with Spark's own way to store and load it."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.lambdamart import LambdaMART, LambdaMARTModel


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """The columns of judged documents; features are a vector or an array of numbers."""

    queryCol: Param[str] = Param(Params._dummy(), "queryCol", "query of a document", TypeConverters.toString)
    docCol: Param[str] = Param(Params._dummy(), "docCol", "id of a document, breaks ties", TypeConverters.toString)

    def _features(self, df: DataFrame):
        name = self.getOrDefault("featuresCol")
        vectors = isinstance(df.schema[name].dataType, VectorUDT)
        return vector_to_array(F.col(name)) if vectors else F.col(name).cast("array<double>")


#: Parameters of the trainer as (name here, name there, converter, default).
_TRAINING = (
    ("nTrees", "n_trees", TypeConverters.toInt, 100),
    ("learningRate", "learning_rate", TypeConverters.toFloat, 0.1),
    ("maxDepth", "max_depth", TypeConverters.toInt, 0),
    ("numLeaves", "num_leaves", TypeConverters.toInt, 31),
    ("minLeafRows", "min_leaf_rows", TypeConverters.toInt, 20),
    ("minLeafHessian", "min_leaf_hessian", TypeConverters.toFloat, 1e-3),
    ("minGain", "min_gain", TypeConverters.toFloat, 0.0),
    ("maxBins", "max_bins", TypeConverters.toInt, 255),
    ("l1", "l1", TypeConverters.toFloat, 0.0),
    ("l2", "l2", TypeConverters.toFloat, 0.0),
    ("cutoff", "k", TypeConverters.toInt, 0),
    ("objective", "objective", TypeConverters.toString, "lambdarank"),
    ("querySubsample", "query_subsample", TypeConverters.toFloat, 1.0),
    ("featureSubsample", "feature_subsample", TypeConverters.toFloat, 1.0),
    ("categorical", "categorical", TypeConverters.toListInt, []),
    ("evalAt", "eval_at", TypeConverters.toListInt, [10]),
    ("stopAfter", "stop_after", TypeConverters.toInt, 0),
)
#: Parameters of which 0 means that there is no bound.
_UNBOUNDED = {"maxDepth", "cutoff", "stopAfter"}


class LambdaMARTRanker(Estimator, _Columns, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Trains boosted trees; ``maxDepth``, ``cutoff`` and ``stopAfter`` of 0 mean none.

    ``validationCol`` names a boolean column of rows that are watched, not learned from.
    """

    validationCol: Param[str] = Param(
        Params._dummy(), "validationCol", "rows to watch; empty for none", TypeConverters.toString)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="score", queryCol="query_id", docCol="doc_id",
            validationCol="", seed=12, **{name: default for name, _, _, default in _TRAINING})
        self._set(**params)

    def setParams(self, **params) -> LambdaMARTRanker:
        return self._set(**params)

    def _trainer(self) -> LambdaMART:
        values = {}
        for name, inner, _, _ in _TRAINING:
            value = self.getOrDefault(name)
            values[inner] = None if name in _UNBOUNDED and not value else value
        return LambdaMART(seed=self.getOrDefault("seed"), **values)

    def _fit(self, dataset: DataFrame) -> LambdaMARTRankerModel:
        names = {"query_id": "queryCol", "doc_id": "docCol", "label": "labelCol"}
        rows = dataset.select(
            *[F.col(self.getOrDefault(param)).alias(name) for name, param in names.items()],
            self._features(dataset).alias("features"),
            F.coalesce(F.col(self.getOrDefault("validationCol")), F.lit(False)).alias("watched")
            if self.getOrDefault("validationCol") else F.lit(False).alias("watched"))
        valid = rows.where("watched") if self.getOrDefault("validationCol") else None
        model = self._trainer().fit(rows.where("not watched"), valid)
        return self._copyValues(LambdaMARTRankerModel(model))


for _name, _inner, _convert, _ in _TRAINING:
    setattr(LambdaMARTRanker, _name, Param(Params._dummy(), _name, f"the trainer's {_inner}", _convert))


class LambdaMARTRankerModel(Model, _Columns, MLReadable, MLWritable):
    """Adds the score of the trees as ``predictionCol``."""

    def __init__(self, model: LambdaMARTModel | None = None):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="score", queryCol="query_id", docCol="doc_id")
        self.trees = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.trees.scored(dataset, self._features(dataset), self.getOrDefault("predictionCol"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: LambdaMARTRankerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.trees.save(self.sparkSession, f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, kind: type[LambdaMARTRankerModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> LambdaMARTRankerModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(LambdaMARTModel.load(self.sparkSession, f"{path}/trees"))
        model._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(model, about)
        return model
