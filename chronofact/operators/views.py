"""Derived indexes in closed form over a state, and their changes at a transaction.

A view is a function from a state (e, a, v) to rows. Its change at t is the
difference of the view over the states at t and t - 1; views that are made
entity by entity are evaluated for the entities of that transaction only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import tokenize
from .index import Index
from .query import projections, query
from .temporal import as_of, propositions

View = Callable[[DataFrame], DataFrame]


FEW = 8  # values of an attribute that are compared as arrays in one row


def tokens(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def full_text(state: DataFrame, text: str = "v") -> DataFrame:
    """(a, token, e)"""
    return _exploded(state, tokens, "token", text).select("a", "token", "e")


def full_text_search(state: DataFrame, test: Callable[[Column], Column], text: str = "v") -> DataFrame:
    """full_text()'s rows whose token meets the test; other tokens are left out before they are exploded."""
    found = F.array_distinct(F.filter(tokenize(F.col(text)), test))
    return state.select("a", F.explode(found).alias("token"), "e").distinct()


def sequence_members(state: DataFrame, sequence: str = "v") -> DataFrame:
    """(element, a, e) for array values."""
    return _exploded(state, F.array_distinct, "element", sequence).select("element", "a", "e")


def _exploded(state: DataFrame, elements: Callable[[Column], Column], name: str, value: str) -> DataFrame:
    """(e, a, name): distinct elements. Only those of an attribute with several values are compared with each other."""
    rows = state.select("e", "a", value).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("e", "a")))
    alone, several = (rows.filter(c).select("e", "a", F.explode(elements(F.col(value))).alias(name)) for c in ("_n = 1", "_n > 1"))
    return alone.unionByName(several.distinct())


def full_text_delta(datoms: DataFrame, t: int) -> DataFrame:
    """(a, token, e, op): full_text()'s changes at transaction t."""
    return _exploded_delta(datoms, t, tokens, "token").select("a", "token", "e", "op")


def sequence_delta(datoms: DataFrame, t: int) -> DataFrame:
    """(element, a, e, op): sequence_members()' changes at transaction t."""
    return _exploded_delta(datoms, t, F.array_distinct, "element").select("element", "a", "e", "op")


def _exploded_delta(datoms: DataFrame, t: int, elements: Callable[[Column], Column], name: str) -> DataFrame:
    """delta() of _exploded(), by entity and attribute: elements are compared where the values are, and not dealt out.

    Up to FEW values are compared as arrays; elements of more of them are rows.
    """
    last = lambda upto: F.max(F.when(F.col("t") <= upto, F.struct("t", "op")))["op"]
    states = as_of(datoms, t).groupBy("e", "a", "v").agg(last(t).alias("now"), last(t - 1).alias("then"))
    live = states.select("e", "a", "v", *[F.coalesce(F.col(c) == "add", F.lit(False)).alias(c) for c in ("now", "then")]).filter("now or then")
    attribute = W.partitionBy("e", "a")
    live = live.withColumn("_changed", F.max(F.col("now") != F.col("then")).over(attribute)).withColumn("_n", F.count(F.lit(1)).over(attribute)).filter("_changed")

    few = live.filter(F.col("_n") <= FEW).groupBy("e", "a").agg(F.collect_list(F.struct("v", "now", "then")).alias("_vs"))
    found = lambda c: F.flatten(F.array_compact(F.transform(F.filter("_vs", lambda x: x[c]), lambda x: elements(x["v"])))).alias(c)
    both = few.select("e", "a", found("now"), found("then"))
    made = lambda x, y, op: F.transform(F.array_except(x, y), lambda v: F.struct(v.alias(name), F.lit(op).alias("op")))
    steps = [made("now", "then", "add"), made("then", "now", "remove")]
    small = both.select("e", "a", F.explode(F.concat(*steps)).alias("_x")).select("e", "a", f"_x.{name}", "_x.op")

    rows = live.filter(F.col("_n") > FEW).select("e", "a", "now", "then", F.explode(elements(F.col("v"))).alias(name))
    held = rows.groupBy("e", "a", name).agg(F.max("now").alias("now"), F.max("then").alias("then")).filter("now != then")
    return small.unionByName(held.select("e", "a", name, F.when(F.col("now"), "add").otherwise("remove").alias("op")))


def composite(state: DataFrame, columns: list[tuple[str, list[str], Callable[[Column], Column] | None]]) -> DataFrame:
    """Per entity the product of its columns' values, and e.

    A column is (name, attributes, function); the function maps a value to an
    array of values.
    """
    frames = []
    for name, attributes, function in columns:
        rows = state.filter(F.col("a").isin(attributes))
        v = F.col("v") if function is None else F.explode(function(F.col("v")))
        frames.append(rows.select("e", v.alias(name)).distinct())
    joined = reduce(lambda x, y: x.join(y, "e"), frames)
    return joined.select(*[c[0] for c in columns], "e").distinct()


def enumeration_counts(datoms: DataFrame, attribute: str) -> DataFrame:
    """(value, t, cnt): the running number of adds less removes of each value."""
    signed = F.when(F.col("op") == "remove", -1).otherwise(1)
    net = datoms.filter(F.col("a") == attribute).groupBy(F.col("v").alias("value"), "t").agg(F.sum(signed).alias("net"))
    upto = W.partitionBy("value").orderBy("t")
    return net.select("value", "t", F.sum("net").over(upto).alias("cnt"))


def enumeration_live(datoms: DataFrame, attribute: str, t: int | None = None) -> DataFrame:
    """Values whose count as of t is above 0."""
    signed = F.when(F.col("op") == "remove", -1).otherwise(1)
    rows = as_of(datoms, t).filter(F.col("a") == attribute)
    return rows.groupBy(F.col("v").alias("value")).agg(F.sum(signed).alias("cnt")).filter("cnt > 0").select("value")


def rule(head: list[str], body: list[list]) -> View:
    """A stored, non-recursive query over the e, a, v state: body patterns, head variables."""

    def view(state: DataFrame) -> DataFrame:
        index = Index("eav", ["e", "a", "v"], state)
        return projections(query([(index, *body)]), head).distinct()

    return view


def delta(view: View, datoms: DataFrame, t: int, by_entity: bool = True) -> DataFrame:
    """The view's changes at transaction t: its columns, and op.

    by_entity: the view's rows of an entity depend on that entity's values
    only, so the others need not be evaluated.
    """
    rows = datoms
    if by_entity:
        touched = datoms.filter(F.col("t") == t).select("e").distinct()
        rows = datoms.join(touched, "e", "left_semi")
    new, old = view(propositions(rows, t)), view(propositions(rows, t - 1))
    return new.subtract(old).withColumn("op", F.lit("add")).unionByName(old.subtract(new).withColumn("op", F.lit("remove")))


def rule_delta(head: list[str], body: list[list], datoms: DataFrame, t: int) -> DataFrame:
    """A rule's changes at t, from the bindings that the transaction touches only.

    For each body pattern, bindings that its touched propositions give seed
    the evaluation of the whole body at t and t - 1.
    """
    touched = datoms.filter(F.col("t") == t).select("e", "a", "v").distinct()
    new, old = propositions(datoms, t), propositions(datoms, t - 1)
    parts = []
    for pattern in body:
        seed = Index("touched", ["e", "a", "v"], touched).substitutions(pattern).distinct()
        evaluated = [projections(query([(Index("eav", ["e", "a", "v"], s), *body)], seed), head).distinct() for s in (new, old)]
        parts.append(evaluated)
    after = reduce(DataFrame.union, [p[0] for p in parts]).distinct()
    before = reduce(DataFrame.union, [p[1] for p in parts]).distinct()
    return after.subtract(before).withColumn("op", F.lit("add")).unionByName(before.subtract(after).withColumn("op", F.lit("remove")))


def caught_up(view: View, stored: DataFrame | None, datoms: DataFrame, by_entity: bool = True) -> DataFrame:
    """A materialised view's rows (with t, op), extended by the transactions after its last one."""
    last = -1 if stored is None else stored.agg(F.coalesce(F.max("t"), F.lit(-1))).first()[0]
    news = changes_after(view, datoms, last, by_entity)
    return news if stored is None else stored.unionByName(news.select(*stored.columns))


def changes_after(view: View, datoms: DataFrame, last: int, by_entity: bool = True) -> DataFrame:
    """The view's changes (its columns, op, t) at all transactions after last, in one plan.

    An entity has a version for each transaction that touches it, and one as of
    last. The view is evaluated over versions as if they were entities, and
    neighbouring versions are compared. Without by_entity, when rows depend on
    several entities, the changes of all transactions are one net change, under
    the last one's number.
    """
    if not by_entity:
        now = datoms.agg(F.max("t")).first()[0]
        new, old = view(propositions(datoms)), view(propositions(datoms, last))
        gone = old.subtract(new).withColumn("op", F.lit("remove"))
        return new.subtract(old).withColumn("op", F.lit("add")).unionByName(gone).withColumn("t", F.lit(now).cast("long"))
    touched = datoms.filter(F.col("t") > last).select("e", F.col("t").cast("long").alias("at")).distinct()
    versions = touched.unionByName(touched.select("e").distinct().withColumn("at", F.lit(last).cast("long")))
    nexts = versions.withColumn("next", F.lead("at").over(W.partitionBy("e").orderBy("at")))
    # a proposition's last operation up to a version decides; operations are first folded by transaction
    ops = datoms.groupBy("e", "a", "v", "t").agg(F.max("op").alias("op"))
    spans = ops.withColumn("until", F.lead("t").over(W.partitionBy("e", "a", "v").orderBy("t"))).filter(F.col("op") == "add")
    live = spans.join(nexts, "e").filter((F.col("t") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    state = live.select(F.struct("e", "at", "next").alias("e"), "a", "v").distinct()
    rows = view(state).distinct()
    names = [c for c in rows.columns if c != "e"]
    flat = rows.select(F.col("e.e").alias("e"), F.col("e.at").alias("at"), F.col("e.next").alias("next"), *names)
    keys = ["e", *names]
    here = flat.select(F.col("at").alias("t"), F.lit(1).alias("step"), *keys).filter(F.col("t") > last)
    before = flat.filter(F.col("next").isNotNull()).select(F.col("next").alias("t"), F.lit(-1).alias("step"), *keys)
    changed = here.unionByName(before).groupBy("t", *keys).agg(F.sum("step").alias("step")).filter("step <> 0")
    return changed.select(*rows.columns, F.when(F.col("step") > 0, "add").otherwise("remove").alias("op"), "t")
