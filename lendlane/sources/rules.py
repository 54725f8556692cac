"""The rule configuration file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException

from lendlane.config import DEFAULT_RULES, Rules
from lendlane.schemas import RULES_FILE


def rules_frame(spark: SparkSession, path: str) -> DataFrame:
    """The configuration as a one-row table."""
    return spark.read.schema(RULES_FILE).json(path, multiLine=True)


def load_rules(spark: SparkSession, *paths: str) -> Rules:
    """The first configuration file that exists, else the built-in rules. One small file, read once."""
    for path in paths:
        try:
            return Rules.from_document(json.loads(spark.read.text(path, wholetext=True).first()["value"]))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return DEFAULT_RULES
