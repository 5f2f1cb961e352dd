"""Generated changes: statements (op, e, a, v) that rename, remove and cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure


def _as(rows: DataFrame, op: str) -> DataFrame:
    return rows.select(F.lit(op).alias("op"), "e", "a", "v")


def remove_property(state: DataFrame, e, a) -> DataFrame:
    return _as(state.filter((F.col("e") == F.lit(e)) & (F.col("a") == F.lit(a))), "remove")


def change_attribute(state: DataFrame, e, old: str, new: str) -> DataFrame:
    """Rename an attribute of one entity; e None: of all."""
    rows = state.filter(F.col("a") == old)
    rows = rows if e is None else rows.filter(F.col("e") == F.lit(e))
    return _as(rows, "remove").unionByName(_as(rows.withColumn("a", F.lit(new)), "add"))


def change_reverse_attribute(state: DataFrame, target, old: str, new: str) -> DataFrame:
    """Rename the attribute by which others refer to the target."""
    rows = state.filter((F.col("v") == F.lit(target)) & (F.col("a") == old))
    return _as(rows, "remove").unionByName(_as(rows.withColumn("a", F.lit(new)), "add"))


def remove_properties(state: DataFrame, e) -> DataFrame:
    return _as(state.filter(F.col("e") == F.lit(e)), "remove")


def remove_references(state: DataFrame, e) -> DataFrame:
    return _as(state.filter(F.col("v") == F.lit(e)), "remove")


def remove_sequence_references(arrays: DataFrame, e) -> DataFrame:
    """Array values that hold the entity are rewritten without it."""
    rows = arrays.filter(F.array_contains("v", F.lit(e)))
    return _as(rows, "remove").unionByName(_as(rows.withColumn("v", F.array_remove("v", F.lit(e))), "add"))


def remove_entity(state: DataFrame, e) -> DataFrame:
    """The entity's own properties and references to it."""
    return remove_properties(state, e).unionByName(remove_references(state, e)).distinct()


def subcomponents(state: DataFrame, component_attributes: list[str], roots: DataFrame) -> DataFrame:
    """(root, e): everything below the roots along component attributes."""
    edges = state.filter(F.col("a").isin(component_attributes)).select(F.col("e").alias("parent"), F.col("v").alias("child"))
    return closure(edges, roots.select(F.col("e").alias("node"))).select("root", F.col("node").alias("e"))


def remove_component_tree(state: DataFrame, component_attributes: list[str], roots: DataFrame) -> DataFrame:
    """Properties of the roots and their subcomponents, and references to them, each once."""
    below = subcomponents(state, component_attributes, roots).select("e")
    gone = below.unionByName(roots.select("e")).distinct()
    own = state.join(gone, "e", "left_semi")
    inbound = state.join(gone.withColumnRenamed("e", "v"), "v", "left_semi")
    return _as(own.select("e", "a", "v").unionByName(inbound.select("e", "a", "v")).distinct(), "remove")
