"""Conjunctive queries: patterns over one or more indexes, joined on shared variables.

Results are bags with a column for each variable; nulls never join. Of the
participants, those that share a variable with what is joined already come
first, so a cross product remains only where the query asks for one. Where keys
repeat on both sides, a result has the product of their numbers of rows;
spread=True deals such products out to all tasks.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .index import Index

UNIT = "_unit"
BLOCK = 4096  # rows of either side in a block of a spread join
RUN = 1 << 14  # rows that a row is repeated to at once; generated code holds them together
RUNS = 1 << 10  # runs that a row is first cut into at once


def query(participants: list[tuple], seed: dict[str, Any] | DataFrame | None = None, spread: bool = False) -> DataFrame:
    """participants: (index, pattern, ...); seed: bindings that hold from the start; spread: joins are spread_join()."""
    fixed = seed if isinstance(seed, dict) else {}
    flat = [(index, P.substitute(list(pattern), fixed)) for index, *patterns in participants for pattern in patterns]
    if not flat:
        raise ValueError("a query needs a pattern")
    frames = []
    for index, pattern in flat:
        frame = index.matches(pattern)
        keep = P.bindings(index.columns, pattern) or [F.lit(1).alias(UNIT)]
        frames.append(frame.select(*keep))
    if isinstance(seed, DataFrame):
        frames.insert(0, seed)
    out, left = frames[0], frames[1:]
    while left:
        known = set(out.columns) - {UNIT}
        at = next((k for k, f in enumerate(left) if known & set(f.columns)), 0)
        out = (spread_join if spread else joined)(out, left.pop(at))
    for name, value in fixed.items():
        if value is not None and name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out.drop(UNIT)


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all shared variables; a product without any."""
    shared = [c for c in a.columns if c in b.columns and c != UNIT]
    if shared:
        return a.join(b.drop(UNIT), shared)
    return a.crossJoin(b.drop(UNIT) if set(b.columns) - {UNIT} else b.select(F.lit(1).alias(UNIT + "2"))).drop(UNIT + "2")


def spread_join(a: DataFrame, b: DataFrame, hint: str | None = None) -> DataFrame:
    """joined(), for keys that repeat on both sides.

    The pairs of a key with more than BLOCK * BLOCK of them are dealt out in
    blocks of about BLOCK by BLOCK rows, by a hash of the whole row; equal rows
    of a side stay in one block. A side that has shared variables only just
    says how often the other's rows repeat, so it is counted.
    """
    shared = [c for c in a.columns if c in b.columns and c != UNIT]
    if not shared:
        return joined(a, b)
    names = list(dict.fromkeys([*shared, *a.columns, *b.drop(UNIT).columns]))
    count = lambda df, name: df.groupBy(*shared).agg(F.count(F.lit(1)).alias(name))
    alone = [set(df.columns) - {UNIT} == set(shared) for df in (a, b)]
    if any(alone):
        a, b = (count(df, f"_n{i}") if own else df for i, (df, own) in enumerate(zip((a, b), alone)))
        times = reduce(lambda x, y: x * y, [F.col(f"_n{i}") for i, own in enumerate(alone) if own])
        return repeated(a.join(b.drop(UNIT), shared), times).select(*[n for n in names if n != UNIT])
    b = b.drop(UNIT)
    both = count(a, "_na").join(count(b, "_nb"), shared).filter(F.col("_na") * F.col("_nb") > BLOCK * BLOCK)
    # one of a key's two numbers is over BLOCK, so there is at most one such key for each BLOCK rows of input
    heavy = F.broadcast(both.select(*shared, *[F.ceil(F.col(f"_n{x}") / BLOCK).cast("int").alias(f"_k{x}") for x in "ab"]))
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*shared, "_xa", "_xb"]

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        k = {x: F.coalesce(F.col(f"_k{x}"), F.lit(1)) for x in "ab"}
        row = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), k[own]).cast("int")
        out = df.join(heavy, shared, "left").withColumn(f"_x{own}", row)
        out = out.withColumn(f"_x{other}", F.explode(F.sequence(F.lit(0), k[other] - 1)))
        return out.select(*df.columns, "_xa", "_xb").repartition(n, *keys)

    left, right = dealt(a, "a", "b"), dealt(b, "b", "a")
    return left.join(right.hint(hint) if hint else right, keys).select(*names)


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as times says.

    Rows are dealt out over the tasks between the steps, which also ends a step's
    generated code: with several explode() in it, it would hold all their rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn("_left", times)
    for size in (RUN * RUNS, RUN):
        out = out.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_left") - 1) / size))))
        out = out.withColumn("_left", F.least(F.col("_left") - F.col("_at") * size, F.lit(size))).drop("_at").repartition(n)
    return out.select(*df.columns, F.explode(F.array_repeat(F.lit(0), F.col("_left").cast("int"))).alias("_one")).drop("_one")


def loop_join(index: Index, pattern: list, substitutions: DataFrame) -> DataFrame:
    """Substitutions joined to the distinct matching prefixes of an index."""
    return joined(substitutions, index.unique_substitutions(pattern))


def merge_join(participants: list[tuple[Index, list]], spread: bool = False) -> DataFrame:
    """n-way join of named indexes on all their shared variables, by sorting and merging; spread: in blocks, by spread_join()."""
    for index, pattern in participants:
        P.check_pattern(index.columns, pattern)
    frames = [index.substitutions(pattern) for index, pattern in participants]
    if spread:
        return reduce(lambda a, b: spread_join(a, b, "merge"), frames)
    return reduce(lambda a, b: joined(a, b.hint("merge")), frames)


def common_variables(patterns: list[list]) -> list[str]:
    """Variables of all patterns, in the order of the first."""
    shared = set.intersection(*[set(P.variables(p)) for p in patterns])
    return [n for n in P.variables(patterns[0]) if n in shared]


def common_key(patterns: list[list]) -> list[str]:
    """The smallest first run of common variables over the patterns: shorter ones first, then by name."""
    shared, runs = set(common_variables(patterns)), []
    for pattern in patterns:
        run: list[str] = []
        for term in pattern:
            n = P.variable_name(term)
            if n in shared:
                run.append(n)
            elif run:
                break
        runs.append(run)
    return min(runs, key=lambda r: (len(r), r))


def projections(substitutions: DataFrame, names: list[str]) -> DataFrame:
    return substitutions.select(*[n.lstrip("?") for n in names])


def cartesian_product(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(b), frames)


def value_path(triples: DataFrame, entities: DataFrame, attributes: list[str]) -> DataFrame:
    """(start, value): from each entity along a path of attributes, the first value at each step."""
    out = entities.select(F.col("e").alias("start"), F.col("e").alias("value"))
    for a in attributes:
        step = triples.filter(F.col("a") == a).groupBy("e").agg(F.min("v").alias("next"))
        out = out.join(step, out["value"] == step["e"]).select("start", F.col("next").alias("value"))
    return out
