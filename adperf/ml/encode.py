"""Feature encoding M1-M3 as pipeline stages that are saved with the model.

``RareLevels`` maps seldom and unseen levels to one level, ``PopulationScaler``
z-scores with the population deviation.  With Spark's indexer, one-hot encoder
and assembler they form one Pipeline, so one saved object scores raw rows.
A fitted stage holds its numbers as params: one mean and deviation per column,
and the levels that get a slot of their own.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INFREQUENT = "__infrequent__"


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Input and output columns, one output for each input."""

    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getInputCols(), self.getOutputCols(), strict=True))


class PopulationScaler(Estimator, _Columns):
    """M1: fits ``(x - mean) / deviation``, the deviation over n; a constant column becomes 0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        row = dataset.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{f.__name__}{k}") for k, c in enumerate(cols) for f in (F.avg, F.stddev_pop)]).collect()[0]
        model = PopulationScalerModel()
        means = [row[f"avg{k}"] or 0.0 for k in range(len(cols))]
        deviations = [row[f"stddev_pop{k}"] or 1.0 for k in range(len(cols))]
        return model._set(inputCols=cols, outputCols=self.getOutputCols(), means=means, deviations=deviations)


class PopulationScalerModel(Model, _Columns):
    means = Param(Params._dummy(), "means", "mean of each input", typeConverter=TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation of each input, 1 for a constant", typeConverter=TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        of = zip(self.pairs(), self.getOrDefault("means"), self.getOrDefault("deviations"), strict=True)
        return dataset.withColumns({o: (F.col(f"`{c}`").cast("double") - m) / d for (c, o), m, d in of})


class RareLevels(Estimator, _Columns):
    """M2: fits the levels with at least ``minFrequency`` rows; the others share one level."""

    minFrequency = Param(Params._dummy(), "minFrequency", "rows of a level with a slot of its own", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, minFrequency=2):
        super().__init__()
        self._setDefault(minFrequency=2)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def level_table(self, dataset: DataFrame) -> DataFrame:
        """(feature, value, n, level): every value of the columns with its rows; one scan."""
        cols = self.getInputCols()
        long = dataset.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot(
            ids=[], values=[f"`{c}`" for c in cols], variableColumnName="feature", valueColumnName="value"
        )
        g = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        return g.withColumn("level", F.when(F.col("n") >= self.getOrDefault("minFrequency"), F.col("value")).otherwise(F.lit(INFREQUENT)))

    def _fit(self, dataset: DataFrame) -> RareLevelsModel:
        table = self.level_table(dataset).where("value IS NOT NULL")
        # what is collected has a slot of the feature vector each, and one mark per column
        rows = table.groupBy("feature").agg(
            F.sort_array(F.collect_list(F.when(F.col("level") != INFREQUENT, F.col("value")))).alias("own"), F.max((F.col("level") == INFREQUENT).cast("int")).alias("rare")
        ).collect()
        of = {r.feature: r for r in rows}
        cols = self.getInputCols()
        return RareLevelsModel()._set(
            inputCols=cols, outputCols=self.getOutputCols(), levels=[list(of[c].own) if c in of else [] for c in cols],
            rare=[bool(of[c].rare) if c in of else False for c in cols],
        )


class RareLevelsModel(Model, _Columns):
    levels = Param(Params._dummy(), "levels", "levels of each input with a slot of their own")
    rare = Param(Params._dummy(), "rare", "whether an input had rarer levels, which unseen ones then join")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        new = {}
        for (c, out), own, rare in zip(self.pairs(), self.getOrDefault("levels"), self.getOrDefault("rare"), strict=True):
            value = F.col(f"`{c}`").cast("string")
            new[out] = F.when(value.isin(own), value).otherwise(F.lit(INFREQUENT) if rare else value)
        return dataset.withColumns(new)


def encoder(numeric: list[str], categorical: list[str], min_frequency: int = 2) -> Pipeline:
    """M3: raw columns -> ``features``, the scaled numbers first, then one slot per level.

    A level that was never seen has no slot set (or the rare one, where there is one).
    """
    scaled, levels, index, hot = ([f"_{p}_{c}" for c in cols] for p, cols in (("z", numeric), ("lvl", categorical), ("idx", categorical), ("hot", categorical)))
    stages = []
    if numeric:
        stages.append(PopulationScaler(inputCols=numeric, outputCols=scaled))
    if categorical:
        stages += [
            RareLevels(inputCols=categorical, outputCols=levels, minFrequency=min_frequency),
            StringIndexer(inputCols=levels, outputCols=index, handleInvalid="keep", stringOrderType="alphabetDesc"),
            # the slot that is dropped is the indexer's own for unseen levels
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=scaled + hot, outputCol="features", handleInvalid="keep")])


def slot_names(model: PipelineModel) -> list[tuple[str, str]]:
    """(slot, raw column) of each place of ``features``; a one-hot slot is ``column=level``."""
    names: list[tuple[str, str]] = []
    for stage in model.stages:
        if isinstance(stage, PopulationScalerModel):
            names += [(c, c) for c in stage.getInputCols()]
        if stage.__class__.__name__ == "StringIndexerModel":
            for c, labels in zip(stage.getInputCols(), stage.labelsArray, strict=True):
                raw = c.removeprefix("_lvl_")
                names += [(f"{raw}={level}", raw) for level in labels]
    return names


def scaled_slots(model: PipelineModel) -> int:
    """How many of the first slots are scaled numbers."""
    return sum(len(s.getInputCols()) for s in model.stages if isinstance(s, PopulationScalerModel))
