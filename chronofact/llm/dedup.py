"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its distinct digests, each with the identifier
to retain and the number of rows. In each round, groups of fan_in runs are
merged. A run of level l is cut into fan_in**l digest ranges, so that pieces
stay as large as one run of level 0; a piece is exchanged with those of the
partner runs that hold its range (a butterfly, which is what binomial rounds
are without one task for the root), sorted by digest, and merged in one pass
over equal neighbours. After ceil(log_fan_in(runs)) rounds one run is left,
whose pieces are in digest order. A digest counts as equal only if SHA-256,
length and a second 64-bit hash agree ("verified"), at every level.

A text that a third of all rows share is one row per run before the first
exchange, and on the way back its rows are joined run by run, so no task gets
the whole group.

Cases: a null text counts as the empty text. Null ids sort below all others; a
group of nulls only keeps one of its rows, with keep_id null. Rows that repeat
both id and text are told apart by their position, and one of them is kept. An
empty table gives an empty result. Columns of the input whose names clash with
result columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

KEYS = ["digest", "n_bytes", "check"]


def digest_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalised: Column | None = None) -> DataFrame:
    """(id, rid, run, digest, n_bytes, check) for each row, written to the shared folder."""
    text = F.coalesce(normalised if normalised is not None else F.col(text_col), F.lit(""))
    return cut(
        df.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("rid"),
            F.spark_partition_id().alias("run"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.xxhash64(text).alias("check"),
        )
    )


def merged_runs(runs: DataFrame, keep: str = "smallest", fan_in: int = 16) -> tuple[DataFrame, DataFrame]:
    """(first level, top level) of the merge tree.

    Both hold KEYS, the retained (id, rid) as winner, and n; the first level
    has a row for each run and digest, the top one for each digest.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.min if keep == "smallest" else F.max
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    first = runs.groupBy("run", *KEYS).agg(best(F.struct("id", "rid")).alias("winner"), F.count("*").alias("n"))
    level, ranges = first, 1
    head = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")  # 32 bits
    while n_runs > 1:
        ranges *= fan_in
        piece = F.shiftright(head * min(ranges, 1 << 30), 32)
        exchanged = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).withColumn("piece", piece).repartition("run", "piece")
        merged = exchanged.sortWithinPartitions("run", "piece", *KEYS).groupBy("run", "piece", *KEYS)
        level = merged.agg(best("winner").alias("winner"), F.sum("n").alias("n")).drop("piece")
        n_runs = -(-n_runs // fan_in)
    return first, level


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalised: Column | None = None, fan_in: int = 16) -> DataFrame:
    """A row for each input row: id_col, keep_id, group_size, kept, text_sha256, n_bytes."""
    runs = digest_runs(df, id_col, text_col, normalised)
    first, top = merged_runs(runs, keep, fan_in)
    top = top.select(*KEYS, F.col("winner"), F.col("n").alias("group_size"))
    decided = first.select("run", *KEYS).join(top, KEYS)
    same = (F.col("winner.rid") == F.col("rid"))
    return runs.join(decided, ["run", *KEYS]).select(
        F.col("id").alias(id_col),
        F.col("winner.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        same.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """The rows of df that exact_dedup keeps, with df's columns.

    Rows that repeat id and text come out once.
    """
    # plain keys for join and grouping, so that both use one exchange of the rows; a null is no id's text
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit("")).alias("_id")
    kept = exact_dedup(df, id_col, text_col, keep, None, fan_in).filter("kept").select(key, F.unhex("text_sha256").alias("_digest"))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        key,
        F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)).alias("_digest"),
    )
    one = rows.join(kept, ["_id", "_digest"], "left_semi").groupBy("_id", "_digest").agg(F.first("_row").alias("_row"))
    return one.select("_row.*")
