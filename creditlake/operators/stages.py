"""Preparation and boosted trees as Spark ML stages.

``LabelCodes`` -> ``Preparation`` -> ``Boosting`` in one ``Pipeline``: what is
fitted (classes, bounds, fills, selection, scales, trees) is kept in the
models' parameters as readable JSON, so one saved ``PipelineModel`` carries all that
scoring needs, and is loaded with ``PipelineModel.load`` alone. Everything fitted
is bounded by the number of features, classes or tree nodes.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as K
from . import boost as B
from . import features as FE
from . import model as M
from . import prep as PR


class _State(Params):
    state = Param(Params._dummy(), "state", "what was fitted, as JSON", typeConverter=TypeConverters.toString)

    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class _Label(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label column", typeConverter=TypeConverters.toString)


class _Column(Params):
    inputCol = Param(Params._dummy(), "inputCol", "category column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "code column", typeConverter=TypeConverters.toString)


class LabelCodes(Estimator, _Column, DefaultParamsReadable, DefaultParamsWritable):
    """The sorted classes of a category column (missing counts as 'nan'), as codes 0, 1, ..."""

    @keyword_only
    def __init__(self, *, inputCol: str = "purpose", outputCol: str = "loan_purpose_encoded"):
        super().__init__()
        self._setDefault(inputCol="purpose", outputCol="loan_purpose_encoded")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LabelCodesModel:
        classes = FE.fit_labels(df, self.getOrDefault(self.inputCol))
        return LabelCodesModel(inputCol=self.getOrDefault(self.inputCol), outputCol=self.getOrDefault(self.outputCol), state=json.dumps(classes))


class LabelCodesModel(Transformer, _Column, _State, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted codes; a class that was not there when fitted, and a table without the column, gives NULL."""

    @keyword_only
    def __init__(self, *, inputCol: str = "purpose", outputCol: str = "loan_purpose_encoded", state: str = "[]"):
        super().__init__()
        self._setDefault(state="[]", inputCol="purpose", outputCol="loan_purpose_encoded")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        col, classes = self.getOrDefault(self.inputCol), self.fitted()
        code = F.lit(None).cast("double")
        if col in df.columns and classes:
            codes = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
            code = F.try_element_at(codes, F.coalesce(F.col(col).cast("string"), F.lit("nan")))
        return df.withColumn(self.getOrDefault(self.outputCol), code)


class Preparation(Estimator, _Label, DefaultParamsReadable, DefaultParamsWritable):
    """M2-M6 fitted on catalogue features (a missing one counts as all NULL)."""

    @keyword_only
    def __init__(self, *, labelCol: str = "TARGET"):
        super().__init__()
        self._setDefault(labelCol="TARGET")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PreparationModel:
        label = self.getOrDefault(self.labelCol)
        x = df.filter(F.col(label).isNotNull()).withColumnRenamed(label, "TARGET")
        return PreparationModel(state=json.dumps(PR.fit_prep(x).to_rows(), default=float))


class PreparationModel(Transformer, _State, DefaultParamsReadable, DefaultParamsWritable):
    """All other columns stay; of the catalogue features the selected ones, prepared, and the interactions follow."""

    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._setDefault(state="{}")
        self._set(**self._input_kwargs)

    def features(self) -> list[str]:
        selected = self.fitted()["selected"]
        return selected + list(M.interaction_columns(selected))

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in K.ALL_FEATURES]
        x = df.select(*[F.col(c) for c in keep],
                      *[(F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")).alias(f) for f in K.ALL_FEATURES])
        return M.add_interactions(PR.PrepModel(**self.fitted()).transform(x, keep=keep))


class Boosting(Estimator, _Label, DefaultParamsReadable, DefaultParamsWritable):
    """M10 over the prepared features; rows flagged in ``valCol`` stop the training early."""

    params_ = Param(Params._dummy(), "params_", "BoostParams, as JSON", typeConverter=TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight column (empty: none)", typeConverter=TypeConverters.toString)
    valCol = Param(Params._dummy(), "valCol", "validation flag (empty: none)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = "TARGET", weightCol: str = "", valCol: str = "", params_: str = "{}"):
        super().__init__()
        self._setDefault(labelCol="TARGET", weightCol="", valCol="", params_="{}")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BoostingModel:
        get = self.getOrDefault
        feats = [f for f in [*K.ALL_FEATURES, *[n for n, *_ in K.INTERACTIONS]] if f in df.columns]
        model = B.fit(df, feats, B.BoostParams(**json.loads(get(self.params_))), get(self.labelCol), get(self.weightCol) or None, get(self.valCol) or None)
        return BoostingModel(state=model.to_json())


class BoostingModel(Transformer, _State, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``margin`` and the probability ``p``."""

    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._setDefault(state="{}")
        self._set(**self._input_kwargs)

    def model(self) -> B.BoostModel:
        return B.BoostModel.from_json(self.getOrDefault(self.state))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model().scored(df, df.columns)


def credit_pipeline(params: dict | None = None, weight: str = "", val: str = "", purpose: str | None = None) -> Pipeline:
    """Label codes (if there is a purpose column), preparation and boosted trees."""
    codes = [LabelCodes(inputCol=purpose)] if purpose else []
    return Pipeline(stages=[*codes, Preparation(), Boosting(weightCol=weight, valCol=val, params_=json.dumps(params or {}))])
