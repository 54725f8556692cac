"""Applications as JSON payloads whose fields keep, row by row, the type they were given with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendlane.operators.applicants import FIELD_ORDER


def with_fields(df: DataFrame, payload: str = "customer_data", names=FIELD_ORDER) -> DataFrame:
    """Add a VARIANT column for each field, and `is_payload`: whether the payload is a JSON object.

    A field that is absent, and every field of a payload that is no object, is NULL. A number
    stays a number and a text a text, so the number 0 can be told from the text "0".
    """
    parsed = df.withColumn("d_payload", F.try_parse_json(F.col(f"`{payload}`")))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("d_payload"), F.lit("OBJECT")), F.lit(False))
    kept = parsed.withColumn("is_payload", is_object)
    fields = {n: F.when(F.col("is_payload"), F.try_variant_get(F.col("d_payload"), f"$.{n}", "variant")) for n in names}
    return kept.withColumns(fields).drop("d_payload")
