"""The input guard as a stage of a machine-learning pipeline, with parameters that are saved with it."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from lendlane.operators.guards import BLOCKED_PHRASES, check_applicants


class InputGuard(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `blocked` and `reason` to a table of applications; with `keepBlocked` off, blocked ones go."""

    phrases = Param(Params._dummy(), "phrases", "phrases that block, as patterns, first ones first", TypeConverters.toListString)
    enabled = Param(Params._dummy(), "enabled", "whether anything is screened", TypeConverters.toBoolean)
    keepBlocked = Param(Params._dummy(), "keepBlocked", "whether blocked applications stay", TypeConverters.toBoolean)

    def __init__(self, phrases=BLOCKED_PHRASES, enabled: bool = True, keepBlocked: bool = True):
        super().__init__()
        self._setDefault(phrases=list(BLOCKED_PHRASES), enabled=True, keepBlocked=True)
        self._set(phrases=list(phrases), enabled=enabled, keepBlocked=keepBlocked)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = self.getOrDefault
        checked = check_applicants(dataset, tuple(value("phrases")), value("enabled"))
        return checked if value("keepBlocked") else checked.where("not blocked")
