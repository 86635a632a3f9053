"""Names of results joined with '|', for data that comes with such keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column) -> Column:
    """Parts joined with '|'."""
    return F.concat_ws("|", *parts)


def kernel_key(sigma: Column, slide: Column, ct1: Column, ct2: Column) -> Column:
    return key(F.lit("kernel"), F.concat(F.lit("sigma"), sigma.cast("string")), slide, ct1, ct2)


def parsed(name: Column) -> Column:
    """A struct of kind, sigma (null where there is none) and the other parts in order."""
    parts = F.split(name, r"\|")
    sigma = F.get(F.filter(parts, lambda p: p.startswith("sigma")), F.lit(0))
    rest = F.filter(F.slice(parts, 2, 100), lambda p: ~p.startswith("sigma"))
    return F.struct(parts[0].alias("kind"), F.substring(sigma, 6, 100).cast("double").alias("sigma"), rest.alias("parts"))
