"""Unions of branches where earlier branches hide later ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(branches: list[DataFrame], keys: list[str], ties: bool = True) -> DataFrame:
    """Rows of the first branch that has any for their keys (D.10, I.16); ties=False keeps one row a key."""
    tagged = None
    for rank, branch in enumerate(branches):
        some = branch.withColumn("priority", F.lit(rank))
        tagged = some if tagged is None else tagged.unionByName(some)
    order = Window.partitionBy(*keys).orderBy("priority", *([] if ties else sorted(set(tagged.columns) - {"priority", *keys})))
    place = (F.dense_rank if ties else F.row_number)().over(order)
    return tagged.withColumn("_place", place).filter("_place = 1").drop("_place")
