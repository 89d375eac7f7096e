"""Registries of datasets as tables: joins, differences, required values and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry_join(entries: DataFrame, registry: DataFrame, key: str = "dataset_name") -> DataFrame:
    """``entries`` with the columns of their registry row; entries that the registry does not
    hold are left out."""
    return entries.join(registry, key, "inner")


def registry_difference(a: DataFrame, b: DataFrame, name: str, only_a: str, only_b: str) -> DataFrame:
    """(name, side): names of ``a`` that ``b`` lacks, and the other way round."""
    left, right = a.select(name).distinct(), b.select(name).distinct()
    return left.join(right, name, "left_anti").withColumn("side", F.lit(only_a)).unionByName(
        right.join(left, name, "left_anti").withColumn("side", F.lit(only_b)))


def missing_values(df: DataFrame, keys: Sequence[str], col: str, required: Sequence[str], name: str = "missing") -> DataFrame:
    """Per key the required values that ``col`` never takes, ascending, joined by commas
    (empty: none).  One flag a required value, so a key's rows meet only as partial maxima."""
    seen = [F.max(F.coalesce(F.col(col) == v, F.lit(False))).alias(f"_has{i}") for i, v in enumerate(sorted(required))]
    flags = df.groupBy(*keys).agg(*seen)
    gaps = [F.when(~F.col(f"_has{i}"), F.lit(v)) for i, v in enumerate(sorted(required))]
    return flags.select(*keys, F.concat_ws(",", *gaps).alias(name))


def union_datasets(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """The rows of all ``frames``, cut to ``columns`` by name; a frame that lacks one has
    nulls there."""
    cut = [f.select(*[c for c in columns if c in f.columns]) for f in frames]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), cut).select(*columns)
