"""Type tags of values, inferred from their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control tags: a nested namespace, and a deletion. The others are BOOL, JSON, INT, DOUBLE and STRING.
SUB, TOMBSTONE = "SUB", "TOMBSTONE"


def infer_type(value: Column) -> Column:
    """BOOL, JSON, INT, DOUBLE or STRING. JSON is braces at both ends, unchecked; a lone dot is DOUBLE; null stays null."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value.isin("true", "false"), F.lit("BOOL"))
        .when(value.rlike(r"(?s)\A\{.*\}\z"), F.lit("JSON"))
        .when(value.rlike(r"\A-?[0-9]+\z"), F.lit("INT"))
        .when(value.rlike(r"\A(?:-?[0-9]+\.[0-9]*|-?\.[0-9]+|\.)\z"), F.lit("DOUBLE"))
        .otherwise(F.lit("STRING"))
    )
