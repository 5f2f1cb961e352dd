"""Transaction logs, datoms and as-of states.

A log has t, op (add, remove, set), e, a, v and, where the order within a
transaction matters, seq. Datoms are the log with sets expanded to adds and
removes. A state is the set of (e, a, v) whose last operation is an add; within
one transaction a remove outranks an add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROPOSITION = ["e", "a", "v"]


def last_transaction(log: DataFrame) -> DataFrame:
    return log.agg(F.max("t").alias("t"))


def as_of(datoms: DataFrame, t: int | None) -> DataFrame:
    return datoms if t is None else datoms.filter(F.col("t") <= t)


def between(datoms: DataFrame, first: int, last: int) -> DataFrame:
    return datoms.filter(F.col("t").between(first, last))


def folded(datoms: DataFrame, keys: list[str]) -> DataFrame:
    """The rows over keys whose last operation is an add."""
    last = datoms.groupBy(*keys).agg(F.max(F.struct("t", "op")).alias("last"))
    return last.filter(F.col("last.op") == "add").select(*keys)


def propositions(datoms: DataFrame, t: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The state as of t, or now."""
    return folded(as_of(datoms, t), keys or PROPOSITION)


def expanded_sets(log: DataFrame) -> DataFrame:
    """Datoms (t, op, e, a, v): a set adds its value and removes what else the attribute had before.

    An event counts for the next set transaction of its entity and attribute
    only: what is live then and not set again is removed. So no event is
    joined with all later sets.
    """
    # backwards, so that the frame only grows and each row costs the same
    later = W.partitionBy("e", "a").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, -1)
    is_set = F.col("op") == "set"
    op = F.when(F.col("op") == "remove", "remove").otherwise("add")
    again = F.coalesce(is_set & F.col("e").isNotNull() & F.col("a").isNotNull() & F.col("v").isNotNull(), F.lit(False))  # nulls are no equal values
    events = log.select("t", "e", "a", "v", op.alias("op"), again.alias("again"), F.min(F.when(is_set, F.col("t"))).over(later).alias("next"))
    # an event stands at its own transaction and before its next set; all that follows stays in the window's partitions
    here = F.struct(F.col("t").alias("at"), F.col("op").alias("own"), F.col("again").alias("again"), F.lit(None).cast(log.schema["t"].dataType).alias("since"), F.lit(None).cast("string").alias("was"))
    before = F.struct(F.col("next").alias("at"), F.lit(None).cast("string").alias("own"), F.lit(False).alias("again"), F.col("t").alias("since"), F.col("op").alias("was"))
    placed = events.select("e", "a", "v", F.explode(F.when(F.col("next").isNull(), F.array(here)).otherwise(F.array(here, before))).alias("p"))
    merged = placed.groupBy("e", "a", "v", F.col("p.at").alias("t")).agg(
        F.max(F.col("p.own") == "add").alias("adds"),
        F.max(F.col("p.own") == "remove").alias("removes"),
        F.max("p.again").alias("again"),
        F.max(F.when(F.col("p.was").isNotNull(), F.struct("p.since", "p.was"))).alias("last"),
    )
    ended = (F.col("last.was") == "add") & ~F.col("again")
    ops = F.array_compact(F.array(F.when(F.col("adds"), "add"), F.when(F.coalesce(F.col("removes"), F.lit(False)) | F.coalesce(ended, F.lit(False)), "remove")))
    return merged.select("t", F.explode(ops).alias("op"), "e", "a", "v")


def permuted(datoms: DataFrame, order: str) -> DataFrame:
    """A covering index: eav, ave, vae, or with t inside (eatcv, avtec, avetc)."""
    names = {"c": "op"}
    columns = [names.get(c, c) for c in order]
    return datoms.select(*columns, *[c for c in ("t", "op") if c not in columns])


def history(datoms: DataFrame, e=None, a=None, t: int | None = None) -> DataFrame:
    out = as_of(datoms, t)
    if e is not None:
        out = out.filter(F.col("e") == F.lit(e))
    return out if a is None else out.filter(F.col("a") == F.lit(a))


def values(datoms: DataFrame, e, a, t: int | None = None) -> DataFrame:
    """Values of an entity's attribute, as of t."""
    return propositions(history(datoms, e, a, t)).select("v")


def value(datoms: DataFrame, e, a, t: int | None = None) -> DataFrame:
    """The first value in value order."""
    return values(datoms, e, a, t).agg(F.min("v").alias("v"))


def entities(datoms: DataFrame, a, test, t: int | None = None) -> DataFrame:
    """Entities with a value of the attribute that equals test or, if it is callable, meets it."""
    rows = as_of(datoms, t).filter(F.col("a") == F.lit(a))
    rows = rows.filter(test(F.col("v"))) if callable(test) else rows.filter(F.col("v") == F.lit(test))
    return propositions(rows).select("e").distinct()


def set_values(log: DataFrame, t: int | None = None) -> DataFrame:
    """Values where a set replaces all before it: those of the last set transaction and after."""
    rows = as_of(log, t)
    last = rows.filter(F.col("op") == "set").groupBy("e", "a").agg(F.max("t").alias("since"))
    op = F.when(F.col("op") == "remove", "remove").otherwise("add")
    after = _beside(rows, last, ["e", "a"]).filter(F.col("since").isNull() | (F.col("t") >= F.col("since")))
    return folded(after.withColumn("op", op), PROPOSITION)


def last_set_value(log: DataFrame, t: int | None = None) -> DataFrame:
    """(e, a, v): the value that the last statement on an attribute set; null if that was no set.

    Within a transaction the last statement is the one with the largest seq.
    """
    last = as_of(log, t).groupBy("e", "a").agg(F.max_by(F.struct("op", "v"), F.struct("t", "seq")).alias("last"))
    return last.select("e", "a", F.when(F.col("last.op") == "set", F.col("last.v")).alias("v"))


def _beside(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what an aggregate found for their keys; nulls are keys like others."""
    named = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, same, "left").drop(*[f"_{k}" for k in keys])


def attributes(state: DataFrame, e) -> DataFrame:
    return state.filter(F.col("e") == F.lit(e)).select("a").distinct()


def referring_attributes(state: DataFrame, e) -> DataFrame:
    """Attributes by which others refer to the entity."""
    return state.filter(F.col("v") == F.lit(e)).select("a").distinct()


def entity_maps(state: DataFrame) -> DataFrame:
    """(e, attributes): a map from each attribute to its sorted values; an entity's values are one row."""
    lists = state.groupBy("e", "a").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    return lists.groupBy("e").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("a", "vs")))).alias("attributes"))


def entity_pivot(state: DataFrame, names: list[str], multivalued: set[str] = frozenset()) -> DataFrame:
    """A row for each entity; single-valued attributes have their first value, the others a sorted array."""
    columns = []
    for n in names:
        v = F.when(F.col("a") == n, F.col("v"))
        columns.append((F.array_sort(F.collect_set(v)) if n in multivalued else F.min(v)).alias(n))
    return state.groupBy("e").agg(*columns)


def squashed(log: DataFrame, t: int | None = None, strict: bool = False) -> DataFrame:
    """The net effect of an ordered log as a minimal set of statements (op, e, a, v).

    An add cancels removes before it; a remove cancels what precedes it, another
    remove included (strict: removes do not cancel each other); a set clears all
    before it on its entity and attribute.
    """
    rows = as_of(log, t).withColumn("pos", F.struct("t", "seq"))
    sets = rows.filter(F.col("op") == "set").groupBy("e", "a").agg(F.max(F.struct("pos", "v")).alias("p"))
    rows = _beside(rows, sets, ["e", "a"])
    start = F.col("p").isNotNull() & (F.col("v") == F.col("p.v"))
    after = rows.withColumn("start", F.coalesce(start, F.lit(False))).filter(F.col("p").isNull() | (F.col("pos") > F.col("p.pos")) | ((F.col("pos") == F.col("p.pos")) & F.col("start")))
    after = after.filter((F.col("op") != "set") | F.col("start"))
    adds = after.filter(F.col("op") == "add").groupBy("e", "a", "v").agg(F.max("pos").alias("q"))
    marked = _beside(after, adds, PROPOSITION)
    later = F.col("q").isNull() | (F.col("pos") > F.col("q"))
    removed = F.col("op") == "remove"
    groups = marked.groupBy("e", "a", "v").agg(
        F.max("start").alias("start"),
        F.max(F.col("op") == "add").alias("added"),
        F.count(F.when(removed & later, 1)).alias("k"),
        F.count(F.when(removed & ~later, 1)).alias("b"),
    )
    k, live = F.col("k"), F.col("added") | F.col("start")
    tail = F.when(k == 0, F.lit(None)).when(F.lit(strict) & ~live, "remove")
    plain = F.when(live & (k > 0), F.when(k % 2 == 0, "remove")).when(~live & (k % 2 == 1), "remove")
    ops = F.array(
        F.when(live & (k == 0) & F.col("added"), "add"),
        F.when(live & (k == 0) & F.col("start") & (~F.col("added") | (F.col("b") == 0)), "set"),
        F.coalesce(tail, plain) if strict else plain,
    )
    return groups.select(F.explode(F.array_compact(ops)).alias("op"), "e", "a", "v")


def property_conflicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(e, a) that both sides touch."""
    return ours.select("e", "a").intersect(theirs.select("e", "a"))


def filtered_map(m: Column, test) -> Column:
    return F.map_filter(m, lambda k, _: test(k))
