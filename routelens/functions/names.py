"""Words of a camel-case, Pascal-case or snake-case name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def camel_words(name: Column) -> Column:
    """Distinct lower-cased words: a space is set at every case or digit border, then the name is split."""
    spaced = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    spaced = F.regexp_replace(spaced, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != ""))
