"""Mixing sources by temperature: target weights realised as budgeted block permutations.

A source's weight is its token share to the power a, normalised. The exponent
is bisected: to the smallest one at which no source is repeated more often than
max_repeats, or to the one whose weights have a target entropy. The token
budget is the least one that uses every source at least once, so no row is lost.

A source is laid out as whole passes over its rows and a last partial one. Each
pass has an order of its own, by a hash of source, pass and id. The partial pass
takes rows in its order up to its token budget, which is a threshold of the
hash; it is found exactly from sums over all rows.

The mixture is cut into blocks of block_tokens tokens. A source's budget in each
block is its share of the mixture's tokens: its layout is cut at equal running
counts of tokens, and a row belongs to the block in which it begins. So in every
block every source has its budget but for the length of one document at each
end. Within a block, rows of all sources are permuted: mix_key, a hash from 0
to below 1, is their order.

Cuts are places in hash bins: sums by bin give most rows' blocks, and only rows
of bins that hold a cut are summed one by one. Plans use a narrow table (source,
id, tokens), so texts are read twice, and rows are placed where they are read:
texts are not shuffled while the table of bins is small enough to be broadcast,
and a source with a third of all rows is no task of its own.

Cases: a null source is a source. Null and empty texts have no tokens; sources
without tokens are passed once and dealt to blocks by hash. Rows with equal
source and id have equal hashes and share a decision. An empty table gives an
empty result. Columns that clash with the added ones (n_tokens, epoch, mix_key,
block) are replaced. There may be max_sources sources, since their weights are
kept on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, few_rows, own_rows, staged
from .quality_rules import SPACES

MOST_BITS = 16  # of a hash that tell its bin
ADDED = ("n_tokens", "epoch", "mix_key", "block")


def words(text: Column) -> Column:
    """The number of words, as the measure of tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACES}]+")).cast("long")


def weights(shares: list[float], a: float) -> list[float]:
    powers = [s**a if s > 0 else 0.0 for s in shares]
    return [p / sum(powers) for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def bisected(meets, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The smallest exponent at which meets holds, given that it holds from some point on."""
    if meets(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    return high


def planned_repeats(tokens: list[int], max_repeats: float | None, target_entropy: float | None) -> tuple[float, float, list[float], list[float]]:
    """(exponent, budget, weights, repeats) for the sources' token sums."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")
    total = sum(tokens)
    if not total:
        return 1.0, 0.0, [0.0] * len(tokens), [1.0] * len(tokens)
    shares = [t / total for t in tokens]

    def repeats(a: float) -> list[float]:
        rate = [w / t if t else 0.0 for w, t in zip(weights(shares, a), tokens)]
        least = min(r for r in rate if r > 0)
        return [r / least if r > 0 else 1.0 for r in rate]

    if max_repeats is not None:
        a = bisected(lambda x: max(repeats(x)) <= max_repeats * (1 + 1e-12))
    else:
        a = bisected(lambda x: entropy(weights(shares, x)) <= target_entropy)
    found = repeats(a)
    return a, sum(r * t for r, t in zip(found, tokens)), weights(shares, a), found


def _hash(source: Column, epoch, ident: Column, seed: int) -> Column:
    """53 bits, from 0."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), source, epoch, ident), 11)


def _partial_ends(hashed: DataFrame) -> dict[int, int]:
    """The largest hash that a source's partial pass takes: the last one at which its sum is within its room.

    hashed: i (source), room, n, h, bin. Rows with equal hashes go together.
    """
    upto = W.partitionBy("i").orderBy("bin")
    bins = hashed.groupBy("i", "room", "bin").agg(F.sum("n").alias("n"), F.max("h").alias("h")).withColumn("end", F.sum("n").over(upto))
    whole = bins.filter("end <= room").groupBy("i").agg(F.max("h").alias("h"))
    crossing = bins.filter("end > room and end - n < room").select("i", "bin", (F.col("end") - F.col("n")).alias("begin"))
    inner = W.partitionBy("i").orderBy("h").rangeBetween(W.unboundedPreceding, 0)
    within = (
        hashed.join(F.broadcast(crossing), ["i", "bin"])  # one bin of each source
        .groupBy("i", "room", "begin", "h")
        .agg(F.sum("n").alias("n"))
        .withColumn("end", F.col("begin") + F.sum("n").over(inner))
        .filter("end <= room")
        .groupBy("i")
        .agg(F.max("h").alias("h"))
    )
    return {r[0]: r[1] for r in whole.unionByName(within).groupBy("i").agg(F.max("h")).collect()}  # at most a row for each source


def _bin(h: Column, bits: int) -> Column:
    return F.shiftright(h, 53 - bits).cast("int")


def _cuts(laid: DataFrame, blocks: int) -> DataFrame:
    """(i, epoch, bin, first, cuts): the block in which a bin begins, and the hashes at which later blocks begin in it.

    laid: i, total (tokens that the source has in the mixture), epoch, bin, h, n.
    """
    block = lambda begin: F.least(F.lit(blocks - 1), F.floor(begin * F.lit(float(blocks)) / F.col("total"))).cast("int")
    bins = laid.groupBy("i", "total", "epoch", "bin").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    before = F.sum("n").over(W.partitionBy("i").orderBy("epoch", "bin")) - F.col("n")
    bins = bins.withColumn("begin", before).withColumn("first", block(F.col("begin"))).withColumn("last", block(F.col("begin") + F.col("n")))
    split = bins.filter("last > first").select("i", "total", "epoch", "bin", "begin", "first")
    # rows with equal hashes begin together
    rows = laid.join(split.drop("total"), ["i", "epoch", "bin"]).groupBy("i", "total", "epoch", "bin", "begin", "first", "h").agg(F.sum("n").alias("n"))
    inner = F.sum("n").over(W.partitionBy("i", "epoch", "bin").orderBy("h")) - F.col("n")
    placed = rows.withColumn("block", block(F.col("begin") + inner)).filter("block > first").groupBy("i", "epoch", "bin", "block").agg(F.min("h").alias("h"))
    cuts = placed.groupBy("i", "epoch", "bin").agg(F.collect_list(F.struct("h", "block")).alias("cuts"))
    return bins.select("i", "epoch", "bin", "first").join(cuts, ["i", "epoch", "bin"], "left")


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = 1_000_000, seed: int = 11, max_sources: int = 10_000) -> DataFrame:
    """df's rows, as often as the mixture takes them, with n_tokens, epoch, block and mix_key, the order in the block."""
    spark = df.sparkSession
    if tokens is None:
        tokens = words(F.col(f"`{text_col}`"))
    source, ident, kind = F.col(f"`{source_col}`"), F.col(f"`{id_col}`"), df.schema[source_col].dataType
    narrow = cut(df.select(source.alias("source"), ident.alias("id"), tokens.alias("n")))
    sums = narrow.groupBy("source").agg(F.sum("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sums.sort(key=lambda r: (r[0] is not None, r[0]))
    names, totals = [r[0] for r in sums], [r[1] for r in sums]
    _, budget, _, repeats = planned_repeats(totals, max_repeats, target_entropy)
    blocks = max(1, math.ceil(budget / block_tokens))
    bits = min(MOST_BITS, max(4, (blocks * 16).bit_length()))

    def table(last: dict[int, int]) -> DataFrame:
        rows = [(i, s, int(r), int((r - int(r)) * t), last.get(i, -1)) for i, (s, r, t) in enumerate(zip(names, repeats, totals))]
        fields = [("_i", T.IntegerType()), ("_source", kind), ("_whole", T.IntegerType()), ("_room", T.LongType()), ("_last", T.LongType())]
        return F.broadcast(few_rows(spark, rows, T.StructType([T.StructField(*f) for f in fields])))  # at most max_sources rows

    def laid(rows: DataFrame, name: Column, key: Column, last: dict[int, int]) -> DataFrame:
        """rows once for each pass that takes them, with _i, epoch, _h and _bin."""
        whole = F.col("_whole")
        taken = F.sequence(F.lit(0), F.when(_hash(name, whole, key, seed) <= F.col("_last"), whole).otherwise(whole - 1))
        out = rows.join(table(last), name.eqNullSafe(F.col("_source"))).withColumn("epoch", F.explode(taken))
        return out.withColumn("_h", _hash(name, F.col("epoch"), key, seed)).withColumn("_bin", _bin(F.col("_h"), bits)).drop("_source", "_whole", "_room", "_last")

    hashed = narrow.join(table({}), F.col("source").eqNullSafe(F.col("_source"))).filter("_room > 0")
    hashed = hashed.select(F.col("_i").alias("i"), F.col("_room").alias("room"), "n", _hash(F.col("source"), F.col("_whole"), F.col("id"), seed).alias("h"))
    last = _partial_ends(hashed.withColumn("bin", _bin(F.col("h"), MOST_BITS)))
    layout = cut(laid(narrow, F.col("source"), F.col("id"), last).select(F.col("_i").alias("i"), "epoch", F.col("_bin").alias("bin"), F.col("_h").alias("h"), "n"))
    used = layout.groupBy("i").agg(F.sum("n").alias("total")).filter("total > 0")
    # used has at most max_sources rows; cuts is a file table, whose size tells the planner whether to broadcast it
    cuts = staged(_cuts(layout.join(F.broadcast(used), "i"), blocks), "cuts")
    named = cuts.select(F.col("i").alias("_i"), F.col("epoch").alias("_epoch"), F.col("bin").alias("_b"), "first", "cuts")
    placed = laid(own_rows(df, *ADDED).withColumn("n_tokens", tokens), source, ident, last)
    placed = placed.join(named.select(F.col("_i").alias("_j"), "_epoch", "_b", F.col("first").alias("_first"), F.col("cuts").alias("_cuts")), (F.col("_i") == F.col("_j")) & (F.col("epoch") == F.col("_epoch")) & (F.col("_bin") == F.col("_b")), "left")
    passed = F.filter("_cuts", lambda c: c["h"] <= F.col("_h"))
    within = F.greatest(F.col("_first"), F.coalesce(F.array_max(F.transform(passed, lambda c: c["block"])), F.lit(0)))
    dealt = F.floor(F.col("_h") * F.lit(blocks / 2.0**53))  # sources without tokens
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("order"), source, F.col("epoch"), ident), 11) / F.lit(2.0**53)
    return placed.withColumn("block", F.coalesce(within, dealt).cast("int")).withColumn("mix_key", order).drop("_i", "_h", "_bin", "_j", "_epoch", "_b", "_first", "_cuts")
