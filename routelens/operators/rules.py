"""Rule tables: detection and extraction rules are data, not code.

Rules are small literal lists. Operators compile them into column expressions
at plan time; ``rule_table`` turns such a list into a DataFrame for the
operators' general form (broadcast theta join), whose size is bounded by the
literal list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def rule_table(spark: SparkSession, rows, schema: str, ordinal: str | None = None) -> DataFrame:
    """DataFrame from literal rule rows; ``ordinal`` adds the 0-based rule order."""
    rows = list(rows)
    if ordinal:
        rows = [(i, *r) for i, r in enumerate(rows)]
        schema = f"{ordinal} int, {schema}"
    return spark.createDataFrame(rows, schema)
