"""Nested records to triples, and temporary ids to dense ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reducers import with_index


def triples_from_columns(df: DataFrame, id_col: str, multivalued: dict[str, str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """(e, a, v) with string values: one row for each non-null column; multivalued names a separator to split at."""
    multivalued, rename = multivalued or {}, rename or {}
    names = [c for c in df.columns if c != id_col]
    parts = [
        F.struct(F.lit(rename.get(c, c)).alias("a"), (F.split(F.col(c).cast("string"), multivalued[c]) if c in multivalued else F.array(F.col(c).cast("string"))).alias("vs"))
        for c in names
    ]
    rows = df.select(F.col(id_col).cast("string").alias("e"), F.explode(F.array(*parts)).alias("p"))
    return rows.select("e", F.col("p.a").alias("a"), F.explode("p.vs").alias("v")).filter(F.col("v").isNotNull())


def shredded(df: DataFrame, id_col: str, op: str = "add") -> DataFrame:
    """(op, e, a, v) from records with nested structs and arrays of structs.

    A nested record's id is its own id_col where it has one, else its parent's
    id and its path. Arrays of structs are sets: a triple for each element. A
    field named "<-a" points back: its record refers to this one by a.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.explode(_triples(record, df.schema, F.col(f"`{id_col}`").cast("string"), id_col)).alias("p"))
    # dealt out before they are compared: few triples repeat, so comparing them where they are made would only hold them all
    dealt = rows.select("p.e", "p.a", "p.v").repartition("e", "a", "v")
    return dealt.distinct().select(F.lit(op).alias("op"), "e", "a", "v")


def _triples(record: Column, schema: T.StructType, own: Column, id_col: str) -> Column:
    """All triples of a record as one array, so that the record is read once."""
    return F.concat(*[_field_triples(record, f, own, id_col) for f in schema.fields if f.name != id_col], F.array().cast("array<struct<e:string,a:string,v:string>>"))


def _field_triples(record: Column, field: T.StructField, own: Column, id_col: str) -> Column:
    kind, column = field.dataType, record.getField(field.name)
    back = field.name.startswith("<-")
    attribute = field.name[2:] if back else field.name
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    items = F.coalesce(column, F.array().cast(T.ArrayType(element))) if isinstance(kind, T.ArrayType) else F.array(column)
    items = F.filter(items, lambda x: x.isNotNull())

    def link(x: Column) -> Column:
        e, v = (x, own) if back else (own, x)
        return F.struct(e.alias("e"), F.lit(attribute).alias("a"), v.alias("v"))

    def nested(x: Column, i: Column) -> Column:
        made = F.concat_ws("/", own, F.lit(attribute), i.cast("string"))
        ident = F.coalesce(x.getField(id_col).cast("string"), made) if id_col in element.fieldNames() else made
        return F.concat(F.array(link(ident)), _triples(x, element, ident, id_col))

    if isinstance(element, T.StructType):
        return F.flatten(F.transform(items, nested))
    return F.transform(items, lambda x: link(x.cast("string")))


def is_temporary(c):
    return c.startswith("tmp/")


def temporary_ids(changes: DataFrame, next_id: int) -> DataFrame:
    """(tmp, id): dense numbers from next_id on, in the order of first appearance (seq, then e before v)."""
    seen = changes.select(F.explode(F.array(F.struct(F.col("seq"), F.lit(0).alias("at"), F.col("e").alias("x")), F.struct(F.col("seq"), F.lit(1).alias("at"), F.col("v").alias("x")))).alias("p"))
    first = seen.filter(is_temporary(F.col("p.x"))).groupBy(F.col("p.x").alias("tmp")).agg(F.min(F.struct("p.seq", "p.at")).alias("first"))
    placed = with_index(first.select("tmp", "first.seq", "first.at"), ["seq", "at"], "place")
    return placed.select("tmp", (F.col("place") + next_id).cast("string").alias("id"))


def resolved(changes: DataFrame, resolution: DataFrame) -> DataFrame:
    """changes with temporary ids replaced, as entities and as values."""
    for c in ("e", "v"):
        ids = resolution.select(F.col("tmp").alias(c), F.col("id").alias("_new"))
        changes = changes.join(ids, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return changes


def first_seen_labels(df: DataFrame, column: str, order: str) -> DataFrame:
    """df with label: 0 for the value seen first, 1 for the next new one, and so on."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    labels = with_index(first, ["_first", column], "label").drop("_first")
    return df.join(labels, column)
