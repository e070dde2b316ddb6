"""Declared dependencies against imports."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import IMPORT_TO_PACKAGE, normal_name, requirement_base
from .joins import related


def _map(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _known(key, values: dict[str, str]):
    """The alias of a name, normalized; null if it has none."""
    return normal_name(F.try_element_at(_map(values), key))


def unused(declared: DataFrame, imports: DataFrame) -> DataFrame:
    """declared: declared. imports: imported (top-level names). Declared dependencies that no import matches.

    Names match if one contains the other; specifiers of versions are part of a
    declared name. Of declared names that are equal when normalized, one counts.
    """
    d = declared.withColumn("norm", normal_name("declared")).groupBy("norm").agg(F.max("declared").alias("declared"))
    package = {v: k for k, v in IMPORT_TO_PACKAGE.items()}
    d = d.withColumn("alias", _known(F.lower(requirement_base("declared")), package))
    i = imports.select(normal_name("imported").alias("imp")).distinct()
    rest = d.join(related(d, i, "norm", "imp"), "norm", "left_anti")
    return rest.join(i.withColumnRenamed("imp", "alias"), "alias", "left_anti").select("declared")


def undeclared(declared: DataFrame, imports: DataFrame, internal: DataFrame) -> DataFrame:
    """Imports that are neither of the standard library, nor of the tree, nor declared. internal: name (in lower case)."""
    d = declared.select(normal_name("declared").alias("norm")).distinct()
    i = imports.select("imported", normal_name("imported").alias("imp")).filter(~F.col("imp").isin(*sys.stdlib_module_names, "__future__"))
    i = i.groupBy("imp").agg(F.max("imported").alias("imported")).join(internal.select(F.col("name").alias("imp")), "imp", "left_anti")
    i = i.withColumn("alias", _known(F.lower("imported"), IMPORT_TO_PACKAGE))
    rest = i.join(related(i, d, "imp", "norm"), "imp", "left_anti")
    packages = rest.filter("alias is not null")
    return rest.join(related(packages, d, "alias", "norm"), "alias", "left_anti").select("imported")
