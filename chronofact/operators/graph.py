"""Closures, traversals and orders of graphs held as edge tables.

Rounds of joins run on the driver's loop, each over distributed tables; what
has been reached is kept out by an anti-join, so cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut as _cut

WIDTH = 16  # levels that are read one by one, before they are written as one table


def _all(levels: list[DataFrame]) -> DataFrame:
    if len(levels) > WIDTH:
        levels[:] = [_cut(reduce(DataFrame.unionByName, levels))]
    return reduce(DataFrame.unionByName, levels)


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) for all nodes below each root; roots: node; edges: parent, child.

    Each round writes its new nodes only.
    """
    edges = _cut(edges.select("parent", "child").distinct())
    frontier, levels, depth = roots.select(F.col("node").alias("root"), "node").distinct(), [], 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["parent"]).select("root", F.col("child").alias("node")).distinct()
        step = step.filter(F.col("root") != F.col("node"))
        if levels:
            step = step.join(_all(levels).select("root", "node"), ["root", "node"], "left_anti")
        step = _cut(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            return _all(levels) if levels else step
        levels.append(step)
        frontier = step.select("root", "node")


def pre_order(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, path, depth) of trees; sorting by path visits parents before children.

    Children of a node are visited in the order of edges.position. A node with
    several parents is visited once for each way to it; an edge back to a node
    on the way is not followed, so cycles end.
    """
    level = roots.select("node", F.array(F.lit(0).cast("long")).alias("path"), F.lit(0).alias("depth"), F.array("node").alias("way"))
    level = _cut(level)
    levels = [level]
    while True:
        steps = level.join(edges, level["node"] == edges["parent"]).filter(~F.array_contains("way", F.col("child")))
        level = _cut(
            steps.select(F.col("child").alias("node"), F.concat("path", F.array(F.col("position").cast("long"))).alias("path"), (F.col("depth") + 1).alias("depth"), F.concat("way", F.array("child")).alias("way"))
        )
        if level.isEmpty():
            return _all(levels).drop("way")
        levels.append(level)


def post_order(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Like pre_order; sorting by path visits children before parents."""
    last = F.lit(2**62).cast("long")
    return pre_order(edges, roots).withColumn("path", F.concat("path", F.array(last)))


def leaves(edges: DataFrame, roots: DataFrame) -> DataFrame:
    nodes = pre_order(edges, roots)
    return nodes.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): children have lower levels than their parents; nodes on cycles are left out."""
    left = _cut(edges.select("parent", "child").distinct())
    rest, out, level = _cut(nodes.select("node").distinct()), None, 0
    while True:
        ready = _cut(rest.join(left.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return out if out is not None else ready
        out = ready if out is None else _cut(out.unionByName(ready))
        rest = _cut(rest.join(ready, "node", "left_anti").select("node"))
        left = _cut(left.join(ready.select(F.col("node").alias("child")), "child", "left_anti"))
        level += 1


# Transactions as a graph: a commit has a content hash and parents.


def commit_hash(parents, statements):
    """The content hash of a commit, as a column."""
    return F.sha2(F.to_json(F.struct(parents.alias("parents"), F.array_sort(statements).alias("statements"))), 256)


def parent_edges(commits: DataFrame) -> DataFrame:
    """(parent, child) with a commit as parent of what it is based on, for closures towards the past."""
    return commits.select(F.col("hash").alias("parent"), F.explode("parents").alias("child"))


def ancestors(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(root, node): all commits reachable from each tip, itself included."""
    below = closure(parent_edges(commits), tips.select(F.col("hash").alias("node"))).select("root", "node")
    return below.unionByName(tips.select(F.col("hash").alias("root"), F.col("hash").alias("node"))).distinct()


def novel_commits(commits: DataFrame, spark: SparkSession, common: str, ours: str, theirs: str) -> DataFrame:
    """(side, hash): commits reachable from one side but not from the common ancestor."""
    tips = spark.createDataFrame([(common,), (ours,), (theirs,)], "hash string")
    reach = _cut(ancestors(commits, tips))
    base = reach.filter(F.col("root") == common).select("node")
    sides = F.when(F.col("root") == ours, "ours").otherwise("theirs")
    return reach.filter(F.col("root") != common).join(base, "node", "left_anti").select(sides.alias("side"), F.col("node").alias("hash"))


def committed(commits: DataFrame, references: DataFrame, parents: list[str], statements: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """commits and references with one more commit on top of the named ones, the first of which moves to it.

    commits: hash, parents, statements; references: name, hash. A first name
    that is not known begins a root; other unknown names are an error.
    """
    spark = commits.sparkSession
    known = {r["name"]: r["hash"] for r in references.filter(F.col("name").isin(parents)).collect()}  # the named ones
    missing = [p for p in parents[1:] if p not in known]
    if missing:
        raise ValueError(f"unknown references {missing}")
    kind = commits.schema["statements"].dataType.simpleString()
    made = spark.createDataFrame([([known[p] for p in parents if p in known], statements)], f"parents array<string>, statements {kind}")
    made = _cut(made.select(commit_hash(F.col("parents"), F.col("statements")).alias("hash"), "parents", "statements"))
    moved = made.select(F.lit(parents[0]).alias("name"), "hash")
    return commits.unionByName(made).dropDuplicates(["hash"]), references.filter(F.col("name") != parents[0]).unionByName(moved)


def first_parents(commits: DataFrame, tip: str) -> DataFrame:
    """(hash, place): the commits along first parents, from the oldest (0) to the tip."""
    edges = commits.select(F.col("hash").alias("parent"), F.get("parents", F.lit(0)).alias("child")).filter("child is not null")
    tips = commits.sparkSession.createDataFrame([(tip,)], "node string")
    below = closure(edges, tips).select("node", "depth").unionByName(tips.withColumn("depth", F.lit(0)))
    length = below.agg(F.max("depth").alias("length"))  # one row
    return below.join(F.broadcast(length)).select(F.col("node").alias("hash"), (F.col("length") - F.col("depth")).alias("place"))


def commit_log(commits: DataFrame, tip: str) -> DataFrame:
    """(t, seq, op, e, a, v): the history of all commits that the tip has seen, parents before children.

    t is a commit's level: no parent has a larger or an equal one. Commits of one level do not know each other.
    """
    tips = commits.sparkSession.createDataFrame([(tip,)], "hash string")
    seen = ancestors(commits, tips).select(F.col("node").alias("hash"))
    mine = commits.join(seen, "hash", "left_semi")
    edges = mine.select(F.col("hash").alias("parent"), F.explode("parents").alias("child"))
    levels = topological_levels(edges, mine.select(F.col("hash").alias("node"))).withColumnRenamed("node", "hash")
    rows = mine.join(levels, "hash").select(F.col("level").cast("long").alias("t"), F.posexplode("statements").alias("seq", "s"))
    return rows.select("t", "seq", "s.op", "s.e", "s.a", "s.v")


def forks(commits: DataFrame) -> DataFrame:
    """(hash, children): commits with several first children, each of which but one began a branch."""
    firsts = commits.select(F.get("parents", F.lit(0)).alias("parent"), "hash").filter("parent is not null")
    return firsts.groupBy(F.col("parent").alias("hash")).agg(F.count("*").alias("children")).filter("children > 1")
